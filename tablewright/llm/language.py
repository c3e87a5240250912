"""Language identification: multinomial naive Bayes over hashed character n-grams.

The training pass counts hashed bigrams and trigrams (within and across words, A-Z folded
by Unicode lower case) of every training document per language; the log-probability
matrix (buckets x languages) is broadcast and a document's score is the sum of the rows
of its n-grams, added up in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_batches, pieces

BUCKETS = 1 << 16
MOST_LANGUAGES = 1000  # bounds the matrix; more is refused, not cut
UNKNOWN = "und"
GRAM_CHARS = 500_000  # characters turned into n-grams at once
_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def char_grams(text: str) -> np.ndarray:
    """Buckets of the character bigrams and trigrams of `` text ``, white space as one blank."""
    chars = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), np.uint32)
    pair = chars[:-1] * _A + chars[1:] * _B
    triple = pair[:-1] * _C + chars[2:] * _A + np.uint32(0x27D4EB2F)
    both = np.concatenate([pair, triple])
    both ^= both >> np.uint32(15)
    both *= np.uint32(0x2C1B3C6D)
    return (both >> np.uint32(16)).astype(np.int64)


def _parts(text: str) -> list[str]:
    """The text in parts of bounded size, cut between words where there are any."""
    out, at = [], 0
    while len(text) - at > GRAM_CHARS:
        cut = text.rfind(" ", at + 1, at + GRAM_CHARS)
        cut = cut if cut > at else at + GRAM_CHARS
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def count_languages(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in code point order and the n-gram counts (language x bucket).

    BUCKETS sums per language reach the driver."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in _parts(text):
                    total += np.bincount(char_grams(part), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield {"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": total[at]}

    rows = docs.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = map_batches(rows, run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    place = {lang: k for k, lang in enumerate(langs)}
    matrix = np.zeros((len(langs), BUCKETS))
    for r in counts.collect():
        matrix[place[r["lang"]], r["bucket"]] = r["n"]
    return langs, matrix


def log_matrix(counts: np.ndarray, added: float = 0.1) -> np.ndarray:
    """log p(bucket | language), one row per bucket."""
    smooth = counts + added
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)


def identify(
    docs: DataFrame, langs: list[str], matrix: np.ndarray, keep: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred and score (the posterior of that language under
    equal priors) of every row. ``und`` with score 0 where the text is NULL or has no letter, or nothing
    was learned; ties go to the first language in code point order. Rows of one id are
    scored each by its own text; an empty table gives an empty one; other columns are not
    read. At most MOST_LANGUAGES languages are learned, more are refused."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches):
        names, table = shared.value
        for batch in pieces(batches, "text"):
            preds, scores = [], []
            for text in batch.column("text").to_pylist():
                if not names or text is None or not any(map(str.isalpha, text)):
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = np.zeros(len(names))
                for part in _parts(text):
                    total += table[char_grams(part)].sum(axis=0, dtype=np.float64)
                odds = np.exp(total - total.max())
                preds.append(names[int(total.argmax())])
                scores.append(float(odds.max() / odds.sum()))
            yield {"doc_id": batch.column("doc_id"), **{c: batch.column(c) for c in keep}, "lang_pred": preds, "score": pa.array(scores, pa.float64())}

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), *keep, F.col(text_column).alias("text"))
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(rows, run, f"doc_id bigint, {kinds}lang_pred string, score double")
