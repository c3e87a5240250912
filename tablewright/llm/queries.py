"""The operators as registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    conversations,
    decontaminate,
    filter_audit,
    jaccard,
    language,
    lattice,
    line_dedup,
    mixing,
    packing,
    quality,
    quality_rules,
    secrets,
    token_files,
)
from tablewright.llm.common import held_out
from tablewright.session import Tables

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
# zlib's crc32 of the decimal conv_id, bit by bit.
CRC32_SQL = """xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
  ), 4294967295)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@register(
    "op1_line_dedup",
    """
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
      FROM documents
    ), keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines
    ), common AS (
      SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (
      SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
      FROM keyed k LEFT JOIN common c ON k.key = c.key
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op1(t: Tables) -> DataFrame:
    docs = t.documents
    return line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs)).drop("kept_text")


def quality_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label of the rows to learn from: crc32 of the id mod 5 is not 0."""
    return labels.where(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label"))


@register("op2_quality_classifier")
def op2(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    return quality.score(docs, *quality.train(docs, quality_labels(t.labels)), keep=("held_out",))


@register(
    "op3_jaccard_join",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^ 	-
]+') AS w
      FROM documents
    ), grams AS (
      SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS gram
      FROM words
    ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
      FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
      SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * k >= 80 * (x.n + y.n - k)
    ), reach AS (
      SELECT doc_id AS a, doc_id AS b FROM words
      UNION
      SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    )
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
    FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id
    JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id
    """,
)
def op3(t: Tables) -> DataFrame:
    return jaccard.jaccard_components(t.documents)


@register("op4_secret_scan")
def op4(t: Tables) -> DataFrame:
    return secrets.scan_secrets(t.documents)


@register("op5_quality_rules")
def op5(t: Tables) -> DataFrame:
    trusted = t.labels.where("quality = 1 AND toxic = 0")
    return quality_rules.quality_rules(t.documents, trusted)


@register("op6_language_id")
def op6(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", "lang", held_out("doc_id", 5, 0).alias("held_out"))
    langs, counts = language.count_languages(docs.where("NOT held_out"))
    return language.identify(docs, langs, language.log_matrix(counts) if langs else counts, keep=("held_out",))


@register(
    "op7_mixing",
    r"""
    WITH docs AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             ('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT
               / 281474976710656.0::DOUBLE AS draw
      FROM documents
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM docs GROUP BY source
    ), filled AS (  -- sources by the share at which they reach their cap
      SELECT *, row_number() OVER r AS k,
             sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
             sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
      FROM sources WINDOW r AS (ORDER BY 3 * source_size / w, source NULLS LAST)
    ), share AS (
      SELECT coalesce((SELECT (total - fixed) / open_w FROM filled
                       WHERE (total - fixed) / open_w * w < 3 * source_size ORDER BY k LIMIT 1), 0) AS s
    ), targets AS (
      SELECT source, source_size, least(w * s, 3.0 * source_size)::DOUBLE AS target FROM sources, share
    ), rated AS (
      SELECT d.doc_id, d.size, t.source_size, t.target, d.draw,
             CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0 END AS rate
      FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies,
           (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size AS taken
    FROM rated
    """,
)
def op7(t: Tables) -> DataFrame:
    return mixing.mix_counts(t.documents)


@register("op8_token_files")
def op8(t: Tables) -> DataFrame:
    return token_files.token_files(t.documents, BYTE_BPE)


@register("op9_lattice_lm")
def op9(t: Tables) -> DataFrame:
    return lattice.lm_scores(t.spark, t.documents, PIECE_BPE)


@register("op10_decontamination")
def op10(t: Tables) -> DataFrame:
    return decontaminate.find_leaks(t.documents, t.benchmark)


@register("op11_packing")
def op11(t: Tables) -> DataFrame:
    return packing.pack_documents(t.documents, BYTE_BPE)


@register(
    "op12_filter_audit",
    r"""
    WITH docs AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), failed AS (
      SELECT doc_id, part, [
               len(w) < 200,
               100 * len(list_distinct(w)) < 50 * len(w),
               100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
               regexp_matches(t, '[#$%&*|]'),
               coalesce(min(doc_id) OVER (PARTITION BY t) < coalesce(doc_id, 9223372036854775807), false)] AS f
      FROM docs
    ), label AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id
    ), counts AS (
      SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM failed LEFT JOIN label USING (doc_id) GROUP BY part, f
    ), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
    orders AS (
      SELECT [a.k, b.k, c.k, d.k, e.k] AS o, concat(chr(64 + a.k), chr(64 + b.k), chr(64 + c.k), chr(64 + d.k), chr(64 + e.k)) AS filter_order
      FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
    ), walked AS (
      SELECT part, filter_order, n, good, toxic, step, f[o[step]] AS fails,
             coalesce(list_bool_or([f[x] for x in o[1:step - 1]]), false) AS gone,
             len([x for x in f if x]) AS n_failed
      FROM counts, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step,
           sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN fails AND n_failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
           (sum(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)) OVER (PARTITION BY part, substr(filter_order, CAST(step AS INTEGER), 1)))::BIGINT AS shapley
    FROM walked GROUP BY part, filter_order, step
    """,
)
def op12(t: Tables) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_masks(t.documents), t.labels)


@register(
    "op13_conversation_trie",
    r"""
    WITH own AS (
      SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                           ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                    md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), hashed AS (SELECT conv_id, turns, CRC32_OF_ID % 9 AS h FROM own),
    rebuilt AS (
      SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
      FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
    ), member AS (
      SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS path
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
    ), nodes AS (
      SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends,
             CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(path[depth].t)) END AS bytes
      FROM member GROUP BY path, depth
    ), kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    counted AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
    below AS (
      SELECT path[1:a] AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
      FROM (SELECT *, unnest(range(depth + 1)) AS a FROM counted) GROUP BY 1
    )
    SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
           b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
    FROM counted c JOIN below b USING (path) LEFT JOIN counted p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
    """.replace("CRC32_OF_ID", CRC32_SQL),
)
def op13(t: Tables) -> DataFrame:
    return conversations.prefix_trie(conversations.rebuilt(t.conversations))
