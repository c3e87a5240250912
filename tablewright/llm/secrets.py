"""Secret scans: fixed patterns, then automata inferred from what they find.

The patterns' matches are labelled credentials. Their values, as strings of character
classes, form a prefix tree per kind; states whose statistics agree are merged (a
Hoeffding bound on their outgoing and ending frequencies, merged recursively), which
leaves a probabilistic automaton. All other tokens give a background automaton in the same
way. Every other token of SHORTEST characters or more, digits alone included, is scored by
the log likelihood per character of its best format against the background; those under
LONG characters by the formats that have such values.

What an automaton is inferred from is bounded: SAMPLE strings per kind (the background is a
kind, though its strings are no labelled values) of at most LONGEST characters. Scoring is
not: every candidate of every text is scored whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_batches, pieces
from tablewright.storage import materialize

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = 6  # characters of an assigned value
LONG = 16  # characters from which a token is scored by every format
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SAMPLE = 2000  # class strings per kind that an automaton is inferred from, drawn by hash with the odds of their counts
LONGEST = 200  # longer values are scored, not learned from
ALPHA = 0.05  # of the Hoeffding bound
FEWEST = 20  # passes a state needs before its statistics can differ
MARGIN = 0.35  # nats per character above the background
# One class for what hex digits are made of: a tree of finer classes is too sparse to merge well.
_CLASS = {c: "x" for c in "0123456789abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
_CLASS |= {chr(c): "U" for c in range(65, 91)} | {c: c for c in "+/_.=-"}
SYMBOLS = sorted(set(_CLASS.values()))


_CLASSES = str.maketrans(_CLASS)
REMEMBERED = 100_000  # tokens or class strings a task remembers something of


def classes(value: str) -> str:
    return value.translate(_CLASSES)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the fixed patterns, by start, then kind."""
    found = []
    longest = max(map(len, text.split()), default=0)
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST]
    if longest >= 20 and "AKIA" in text:
        found += [(*m.span(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if longest >= 24:
        found += [(*m.span(), 2, m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[tuple[int, int, int, str]], least: int = SHORTEST) -> list[tuple[int, int, str]]:
    """Tokens of ``least`` characters that no base span touches, without punctuation at the
    ends; letters or digits alone will do."""
    out, at = [], 0
    covered = []
    for start, end, *_ in base:  # by start: merged into disjoint ranges
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    for m in TOKEN.finditer(text):
        value = m[0].rstrip(".=-/+_")
        start = m.start() + len(value) - len(value.lstrip(".=-/+_"))
        end = m.start() + len(value)
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if end - start >= least and not (at < len(covered) and covered[at][0] < end):
            out.append((start, end, text[start:end]))
    return out


class Automaton:
    """A probabilistic automaton over character classes, by merging prefix-tree states."""

    def __init__(self, strings: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.passes: list[Counter] = [Counter()]  # by symbol
        self.ends = [0]
        for string, n in sorted(strings.items()):
            state = 0
            for symbol in string:
                self.passes[state][symbol] += n
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.passes.append(Counter())
                    self.ends.append(0)
                state = self.next[state][symbol]
            self.ends[state] += n
        self._infer()

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.passes[state].values())

    def _alike(self, a: int, b: int) -> bool:
        """Whether the statistics of both states, and of all that follow, agree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if n < FEWEST or m < FEWEST:
                continue
            bound = math.sqrt(math.log(2 / ALPHA) / 2) * (n**-0.5 + m**-0.5)
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for symbol in self.passes[a].keys() | self.passes[b].keys():
                if abs(self.passes[a][symbol] / n - self.passes[b][symbol] / m) > bound:
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, red: int, tree: int) -> None:
        """Add a subtree to the state it is merged with."""
        todo = [(red, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for symbol, target in self.next[b].items():
                self.passes[a][symbol] += self.passes[b][symbol]
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], target))
                else:
                    self.next[a][symbol] = target

    def _infer(self) -> None:
        """Merge each frontier state, nearest first, into the first state it agrees with."""
        red = [0]
        while True:
            known = set(red)
            edge = next(((s, x) for s in red for x in sorted(self.next[s]) if self.next[s][x] not in known), None)
            if edge is None:
                break
            state, symbol = edge
            child = self.next[state][symbol]
            other = next((r for r in red if self._alike(r, child)), None)
            if other is None:
                red.append(child)
            else:
                self.next[state][symbol] = other
                self._fold(other, child)
        self.states = red
        # Log probabilities, one added per symbol and the end, so that all strings have one.
        self.log, self.end = {}, {}
        for state in red:
            n = self.total(state) + len(SYMBOLS) + 1
            self.log[state] = {s: math.log((self.passes[state][s] + 1) / n) for s in SYMBOLS}
            self.end[state] = math.log((self.ends[state] + 1) / n)

    def score(self, string: str) -> float:
        """Log probability per symbol, the end counted; unseen steps go to the start."""
        state, total = 0, 0.0
        for symbol in string:
            total += self.log[state][symbol]
            state = self.next[state].get(symbol, 0)
        return (total + self.end[state]) / (len(string) + 1)


def class_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """kind, classes, n: class strings of the values of base spans, and (kind 3) of all
    other tokens."""

    def run(batches):
        for batch in pieces(batches, "text"):
            labels, plain = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    spans = base_spans(text)
                    labels.update((kind, classes(value)) for *_, kind, value in spans)
                    plain.update(value for *_, value in candidates(text, spans))
            for value, n in plain.items():
                labels[3, classes(value)] += n
            kinds, strings = zip(*labels) if labels else ((), ())
            yield {"kind": list(kinds), "classes": list(strings), "n": list(labels.values())}

    parts = map_batches(docs.select(F.col(text_column).alias("text")), run, "kind int, classes string, n bigint")
    return parts.groupBy("kind", "classes").agg(F.sum("n").alias("count"))


def shortest_values(counted: DataFrame) -> dict[int, int]:
    """Characters from which tokens are scored by each kind that has labelled values."""
    rows = counted.where("kind < 3").groupBy("kind").agg(F.min(F.length("classes")).alias("n")).collect()
    return {r["kind"]: min(LONG, r["n"]) for r in rows}


def infer_automata(counted: DataFrame) -> dict[int, Automaton]:
    """One automaton per credential kind, and one (key 3) of all tokens outside base
    spans. Each from SAMPLE class strings with their counts."""
    counted = counted.where(F.length("classes") <= LONGEST)
    # Each value has an exponential time by a hash of its string: often seen, soon drawn.
    late = -F.log((F.pmod(F.xxhash64("classes"), F.lit(1 << 52)) + F.lit(1)) / F.lit(float(1 << 52))) / F.col("count")
    out = {}
    for kind in range(4):
        rows = counted.where(F.col("kind") == kind).orderBy(late, "classes").limit(SAMPLE).collect()
        if rows:
            out[kind] = Automaton({r["classes"]: r["count"] for r in rows})
    return out


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_grammar, base_sha256, spans and found (start,
    end, kind, score) per row.

    Spans count code points, the end excluded; an assign span is the whole match. A NULL
    or empty text has none. A grammar span has a letter and is as long as the shortest
    labelled value of its format, or LONG. Without labelled credentials there are no
    automata and no grammar spans. Rows of one id are scanned each; an empty table gives
    an empty one; other columns are not read."""
    counted = materialize(class_counts(docs, text_column), "credential-classes")
    shortest = shortest_values(counted)
    automata = infer_automata(counted) if shortest else {}
    least = min(shortest.values(), default=0)
    shared = docs.sparkSession.sparkContext.broadcast(automata)  # states of bounded samples

    def score(string: str) -> float:
        formats = [a for k, a in shared.value.items() if k < 3 and len(string) >= shortest[k]]
        if not formats:
            return -math.inf
        plain = shared.value[3].score(string) if 3 in shared.value else -math.log(len(SYMBOLS) + 1)
        return max(a.score(string) for a in formats) - plain

    def run(batches):
        by_classes, by_value = lru_cache(REMEMBERED)(score), lru_cache(REMEMBERED)(lambda value: by_classes(classes(value)))
        for batch in pieces(batches, "text"):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans", "found")}
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                tokens = candidates(text, base, least) if text and least else []
                more = [(a, b, 3, s) for a, b, value in tokens if (s := by_value(value)) >= MARGIN]
                own = [(a, b, kind, None) for a, b, kind, _ in base]
                name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in spans)
                both = sorted(own + more, key=lambda s: (s[0], s[2]))
                for k, column in enumerate(("n_assign", "n_access", "n_hex", "n_grammar")):
                    out[column].append(sum(s[2] == k for s in both))
                out["base_sha256"].append(hashlib.sha256(name(own).encode()).hexdigest())
                out["spans"].append(name(both))
                out["found"].append([{"start": a, "end": b, "kind": KINDS[k], "score": s} for a, b, k, s in both])
            yield {"doc_id": batch.column("doc_id"), **out}

    schema = (
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_grammar bigint, base_sha256 string, spans string, "
        "found array<struct<start: int, end: int, kind: string, score: double>>"
    )
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return map_batches(rows, run, schema)
