"""Secrets in texts: fixed patterns, and formats inferred from what they find.

The values that the patterns find are labelled credentials. From a bounded sample of them (FIT values a kind, the smallest by
hash) a prefix tree is grown and its statistically compatible states are merged (Hoeffding's bound), which gives a
probabilistic automaton of each kind's format. One more, the background, is gathered by Spark over every other token of every text:
its state is the last character, so it is of bounded size and no token is rare enough to be learned by heart. All other tokens of all texts, and what is left of
a token beside a finding, are then scored by the logarithm of their likelihood under the best format over that under the background.
A format's steps are shrunk towards the background's, so that one with few values says little instead of nothing.
"""


from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaplens.llm.common import written

KINDS = ("assign", "access", "hex")
INFERRED = "inferred"
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more, from its first digit to its last
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SHORTEST = 8  # code points of a token that is scored
NAMES = ("passw", "secret", "token", "apikey", "api_key")

FIT = 1_000  # values of each kind that automata are fitted to
LONGEST = 256  # code points of a value that may be in that sample; longer ones are found and scored, but not learned from
MERGE = 0.05  # significance at which states are held to differ
SHRINK = 5.0  # steps that the background counts for in each state of a format, and characters whatever came before in each state of the background
EVIDENCE = 20.0  # natural logarithm of the likelihood ratio that a finding needs
EDGE = "\n"  # stands before a token's first and after its last character

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
BASE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
FOUND = pa.struct([("base", pa.list_(BASE)), ("inferred", pa.list_(SPAN))])
FOUND_DDL = "struct<base: array<struct<kind: string, start: bigint, end: bigint, value: string>>, inferred: array<struct<start: bigint, end: bigint>>>"


def scan(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int, str]]]:
    """What the fixed patterns find (kind, start, end, value), by start and kind; all other tokens and parts of tokens. Offsets are code points."""
    base = []
    low = text.lower()
    if any(name in low for name in NAMES):
        base += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    if any(end - start >= 32 for start, end, _ in tokens):
        base += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    rest, k, reach = [], 0, 0
    for start, end, _ in tokens:  # both by start: one pass tells what findings leave of each token
        at = max(start, reach)
        while k < len(base) and base[k][1] < end:
            if base[k][1] - at >= SHORTEST:
                rest.append((at, base[k][1], text[at : base[k][1]]))
            reach = max(reach, base[k][2])
            at = max(at, reach)
            k += 1
        if end - at >= SHORTEST:
            rest.append((at, end, text[at:end]))
    return base, rest


class Automaton:
    """A probabilistic automaton of strings, by merging the compatible states of their prefix tree in breadth-first order."""

    def __init__(self, values: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.times: list[dict[str, int]] = [{}]
        self.stops: list[int] = [0]
        for value in sorted(values):
            at = 0
            for c in value:
                self.times[at][c] = self.times[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = self._state()
                at = self.next[at][c]
            self.stops[at] += 1
        self._merge()

    def _state(self) -> int:
        self.next.append({})
        self.times.append({})
        self.stops.append(0)
        return len(self.next) - 1

    def _seen(self, state: int) -> int:
        return self.stops[state] + sum(self.times[state].values())

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._seen(a), self._seen(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / MERGE)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.stops[a] / n - self.stops[b] / m) > bound:
                return False
            for c in self.times[a].keys() | self.times[b].keys():
                if abs(self.times[a].get(c, 0) / n - self.times[b].get(c, 0) / m) > bound:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below `b` to `a`."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.stops[a] += self.stops[b]
            for c, n in self.times[b].items():
                self.times[a][c] = self.times[a].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> None:
        kept = [0]
        settled = {0}
        while True:
            edge = next(((s, c, t) for s in kept for c, t in sorted(self.next[s].items()) if t not in settled), None)
            if edge is None:
                return
            state, c, target = edge
            for other in kept:
                if self._compatible(other, target):
                    self.next[state][c] = other
                    self._fold(other, target)
                    break
            else:
                kept.append(target)
                settled.add(target)

    def frozen(self) -> Format:
        """Only the states that are left, with their counts: what scoring needs."""
        live, todo = {0}, [0]
        while todo:
            new = set(self.next[todo.pop()].values()) - live
            live |= new
            todo += new
        steps = {(at, c): (n, self.next[at][c]) for at in live for c, n in self.times[at].items()}
        return Format(steps, {at: self.stops[at] for at in live}, {at: self._seen(at) for at in live})


class Format(NamedTuple):
    """A fitted automaton: (times, next state) of each state's characters, its ends, and how often it was seen."""

    steps: dict[tuple[int, str], tuple[int, int]]
    stops: dict[int, int]
    seen: dict[int, int]


class Background:
    """Chances of a character after another, from counts of all pairs; they are shrunk to the chances after any other."""

    def __init__(self, pairs: dict[str, int]):
        self.pairs, self.single, self.before = pairs, Counter(), Counter()
        for pair, n in pairs.items():
            self.before[pair[0]] += n
            self.single[pair[1]] += n
        self.all = sum(pairs.values())

    def chance(self, before: str, c: str) -> float:
        p = (self.single[c] + 1) / (self.all + len(CHARACTERS) + 1)
        return (self.pairs.get(before + c, 0) + SHRINK * p) / (self.before[before] + SHRINK)

    def chances(self, value: str) -> list[float]:
        """Of each character of `value` and of its end."""
        return [self.chance(a, b) for a, b in zip(EDGE + value, value + EDGE)]


def evidence(model: Format, value: str, chances: list[float]) -> float:
    """Logarithm of the likelihood of `value` under a format over that under the background, of which `chances` are.

    A character that a state never saw leaves the automaton where it is, at the share that the background has of that state.
    """
    steps, stops, seen = model
    at, total = 0, 0.0
    for c, p in zip(value, chances):
        n, to = steps.get((at, c), (0, at))
        total += math.log((n / p + SHRINK) / (seen[at] + SHRINK))
        at = to
    return total + math.log((stops[at] / chances[-1] + SHRINK) / (seen[at] + SHRINK))


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value, n): values of at most LONGEST code points by kind, and under no kind the pairs of characters of all other tokens."""

    def pairs(tokens: Counter) -> Counter:
        out = Counter()
        for value, n in tokens.items():
            for a, b in zip(EDGE + value, value + EDGE):
                out[a + b] += n
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kinds: list, values: list, times: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(times, pa.int64())], ["kind", "value", "n"])

        runs, tokens = Counter(), Counter()
        for batch in batches:
            values = Counter()
            for text in batch.column(0).to_pylist():
                base, rest = scan(text)
                values.update((kind, value) for kind, *_, value in base if len(value) <= LONGEST)
                tokens.update(value for *_, value in rest)
                if len(tokens) > 100_000:
                    runs += pairs(tokens)
                    tokens.clear()
            yield rows([k for k, _ in values], [v for _, v in values], list(values.values()))
        runs += pairs(tokens)
        yield rows([""] * len(runs), list(runs), list(runs.values()))

    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(count, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def formats(docs: DataFrame, text_col: str = "text") -> tuple[list[Format], Background]:
    """Automata of the kinds, each from at most FIT distinct values, the smallest by hash, and the background of all other tokens."""
    there = written(counted(docs, text_col), "secret-counts")

    def sample(kind: str) -> list[str]:
        return [r.value for r in there.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(FIT).select("value").collect()]

    fitted = [Automaton(v).frozen() for v in map(sample, KINDS) if v]
    runs = {r.value: r.n for r in there.filter("kind = ''").select("value", "n").collect()}  # at most 69 times 69 pairs
    return fitted, Background(runs)


class Judge(dict):
    """Whether a token is a secret by the formats; a bounded cache of short tokens."""

    def __init__(self, fitted: list[Format], background: Background):
        super().__init__()
        self.fitted, self.background = fitted, background

    def __missing__(self, value: str) -> bool:
        chances = self.background.chances(value)
        found = any(evidence(m, value, chances) >= EVIDENCE for m in self.fitted)
        if len(value) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[value] = found
        return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, base (kind, start, end, value) and inferred (start, end), both by start; whole texts.

    A null text is empty and has none; null ids stay null; repeated rows are searched each. Where patterns find nothing
    there is no format and nothing is inferred. No rows give no rows; further columns are not read. Texts are scanned
    twice, so that no tokens are ever written: once to count, once to find and score.
    """
    models = docs.sparkSession.sparkContext.broadcast(formats(docs, text_col))  # bounded by FIT * LONGEST states a kind and 69 * 69 pairs

    @F.arrow_udf(FOUND_DDL)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Judge(*models.value)
        for batch in batches:
            out = []
            for text in batch:
                base, rest = scan(text.as_py())
                kept = [{"start": a, "end": b} for a, b, value in rest if judge[value]]
                out.append({"base": [dict(zip(("kind", "start", "end", "value"), b)) for b in base], "inferred": kept})
            yield pa.array(out, FOUND)

    rows = docs.select(docs[id_col].alias(id_col), found(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("s"))
    return rows.select(id_col, "s.base", "s.inferred")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of `find_secrets`: counts by kind, the digest of the patterns' spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = F.create_map(*(x for k, kind in enumerate((*KINDS, INFERRED)) for x in (F.lit(kind), F.lit(k))))
    told = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    keyed = F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("at"), order[b["kind"]].alias("k"), told(b["kind"], b).alias("span"))),
        F.transform("inferred", lambda b: F.struct(b["start"].alias("at"), order[F.lit(INFERRED)].alias("k"), told(F.lit(INFERRED), b).alias("span"))),
    )
    base = F.array_join(F.transform("base", lambda b: told(b["kind"], b)), ",")
    return found.select(id_col, *(count(k) for k in KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(F.array_sort(keyed), lambda x: x["span"]), ",").alias("spans"))
