"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

A token scores the logarithm of its odds to be in a toxic against another document, with a Dirichlet prior of a constant and
a share by its overall frequency; only significant tokens score. Documents are counted, not tokens, and equal texts once, so that
a word which one document repeats weighs as one. A word that was never learned scores as its longest known beginning. Every
token also costs a little, half way between the mean scores of both classes, so that a passage scores by density and length. One
linear scan finds all maximal-scoring segments. A segment of score S in n tokens has chance E = K n exp(-lambda S) of arising in other
text (lambda from their scores' moment equation, K from their best segments); the sum of the r best normalised scores has a
chance of its own, the smallest over r counts, and a logistic curve over its logarithm gives the score.

Labelled rows that are near copies of each other (by their words, in any order) have one vote: thousands of copies
of a text say no more about its words than the text. Tokens are learned from one part of these groups and
the calibration from another, so neither flatters the other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaplens.llm.common import components, written
from swaplens.llm.decontamination import words_of

TOXIC_ROWS, OTHER_ROWS = 8_000, 16_000  # labelled rows that are learned from at most, the smallest by hash of their id
SKETCH, BAND = 64, 4  # minima of hashes in a row's sketch, and how many of them make a band
ALIKE = 0.6  # share of equal minima from which two rows are near copies
PRIOR = 5.0  # documents that the Dirichlet prior weighs as much as, shared out by overall frequency
FLAT = 0.5  # and what it adds for every token alike
CLEAR = 3.0  # standard errors from zero at which a token is significant
STEMS = (5, 6, 7)  # code points of the beginnings of words that stand for unknown words
SUMMED = 1_000  # best segments of a text whose sums are tried; a longer sum is never reached, as its chance has a bound
RIDGE = 1e-4  # of the logistic curve, on standardised evidence
NOTHING = 0.49  # the score of a text without any passage at most: it is never predicted toxic
SIGNIFICANT = 0.01  # a passage is reported if less than so many are expected by chance

JUDGED = "struct<score: double, passages: array<struct<start: bigint, end: bigint, score: double>>>"


class Model(NamedTuple):
    scores: dict[bytes, float]
    cost: float
    decay: float
    scale: float
    slope: float
    offset: float


def features(word: bytes) -> list[bytes]:
    """A word, and its beginnings marked by a leading 0 byte, shortest first."""
    text = word.decode()
    return [word, *(b"\0" + text[:n].encode() for n in STEMS if len(text) > n)]


CACHED = 100_000  # words a worker keeps the score of; about 20 MB


class Scores(dict):
    """Scores of words by a cache; unknown words take that of their longest known beginning."""

    def __init__(self, known: dict[bytes, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> float:
        score = self.known.get(word)
        if score is None:
            score = next((self.known[f] for f in features(word)[:0:-1] if f in self.known), 0.0)
        if len(self) >= CACHED:
            self.clear()
        self[word] = score
        return score


def segments(scores: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of `scores` less `cost` each, in one pass over what scores above.

    A list of candidate segments is kept; a new one is joined to the last whose sum before it is smaller, as long as that
    makes a segment of larger score (Ruzzo and Tompa's rule).
    """
    total = np.concatenate([[0.0], np.cumsum(scores - cost)])
    kept: list[list[float]] = []  # start, end, sum before, sum after
    link: list[int] = []  # index of the last candidate whose sum before is smaller, or -1
    for at in np.flatnonzero(scores > cost).tolist():
        new = [at, at + 1, total[at], total[at + 1]]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = link[j]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                link.append(j)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:], link[j:]
    return [(int(a), int(b), float(y - x)) for a, b, x, y in kept]


def passages(text: str, scores: Scores, cost: float) -> tuple[int, list[tuple[int, int, float]]]:
    words = words_of(text)
    return len(words), segments(np.fromiter(map(scores.__getitem__, words), np.float64, len(words)), cost)


def _sample(labels: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, float]]:
    """At most TOXIC_ROWS and OTHER_ROWS labelled ids that are not held out, and the share of each class that this is."""
    rows = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IN (0, 1)")
    rows = rows.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).filter(~held_out(F.col("_id")))
    there = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    most = {1: TOXIC_ROWS, 0: OTHER_ROWS}
    parts = [rows.filter(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in most.items()]
    return parts[0].union(parts[1]), {y: min(1.0, most[y] / n) for y, n in there.items()}


def held_out(id_: Column) -> Column:
    """Whether the crc32 of an id as text is divisible by 5 (a null id is an empty text)."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


def sketches(text: Column) -> Column:
    """The minima of SKETCH hashes over the distinct words of a text; a text without words has zeros."""

    @F.arrow_udf("array<bigint>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        r = np.random.default_rng(11)
        mul, add = (r.integers(1, 1 << 31, SKETCH, dtype=np.uint64) for _ in range(2))
        for batch in batches:
            out = []
            for t in batch:
                low = np.full(SKETCH, 0, np.uint64)
                words = list(set(words_of(t.as_py())))
                for at in range(0, len(words), 100_000):
                    h = np.fromiter((xxhash.xxh32_intdigest(w) for w in words[at : at + 100_000]), np.uint64)
                    part = np.array([((h * m + a) & np.uint64((1 << 62) - 1)).min() for m, a in zip(mul, add)], np.uint64)
                    low = np.minimum(low, part) if at else part
                out.append(low.astype(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    return sketch(text)


def one_vote_each(rows: DataFrame) -> DataFrame:
    """One of the labelled rows (_id, _text, _toxic) for each group of near copies and label, with its `_group`.

    Rows that share a band are compared with the smallest of it by their whole sketches. The rows are the bounded sample.
    """
    kept = written(rows.withColumn("_sketch", sketches(F.col("_text"))), "toxic-sample")
    slots = F.array(*(F.struct(F.lit(k).alias("k"), F.slice("_sketch", k + 1, BAND).alias("v")) for k in range(0, SKETCH, BAND)))
    bands = kept.select("_id", "_sketch", F.explode(slots).alias("_band"))
    first = bands.groupBy("_band").agg(F.min(F.struct("_id", "_sketch")).alias("_first"))
    met = bands.join(first, "_band").filter("_id <> _first._id")
    same = F.expr("aggregate(zip_with(_sketch, _first._sketch, (x, y) -> CAST(x = y AS INT)), 0, (n, x) -> n + x)")
    links = met.filter(same >= ALIKE * SKETCH).select(F.col("_id").alias("a"), F.col("_first._id").alias("b")).distinct()
    found = kept.join(components(links, "toxic-links"), kept["_id"] == F.col("node"), "left").withColumn("_group", F.coalesce("root", "_id"))
    votes = found.groupBy("_group", "_toxic").agg(F.min(F.struct("_id", "_text")).alias("_one"))
    return written(votes.select("_group", "_toxic", F.col("_one._text").alias("_text")), "toxic-votes")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model, from a bounded sample of labelled rows; without toxic rows or without others nothing ever scores."""
    sample, share = _sample(labels, id_col, label_col)
    texts = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(sample), "_id")  # at most TOXIC_ROWS + OTHER_ROWS ids
    rows = one_vote_each(rows).withColumn("_later", F.crc32(F.col("_group").cast("string")) % 4 == 0).select("_text", "_toxic", "_later")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        found, documents = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                documents[toxic] += 1
                found[toxic].update({f for word in set(words_of(text)) for f in features(word)})
        for y in (0, 1):
            found[y][b""] = documents[y]  # under the empty token
        tokens = sorted(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_pydict({"token": tokens, "other": [found[0][t] for t in tokens], "toxic": [found[1][t] for t in tokens]}, pa.schema([("token", pa.binary()), ("other", pa.int64()), ("toxic", pa.int64())]))

    counted = rows.filter("NOT _later").select("_text", "_toxic").mapInArrow(count, "token binary, other long, toxic long").groupBy("token").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    size = counted.filter(F.octet_length("token") == 0).select("other", "toxic").first()
    if size is None or not size[0] or not size[1]:
        return Model({}, 1.0, 1.0, 1.0, 1.0, -50.0)
    n0, n1 = float(size[0]), float(size[1])
    prior = F.lit(FLAT) + (F.col("other") + F.col("toxic")) * (PRIOR / (n0 + n1))
    odds = F.log((F.col("toxic") + prior) / (n1 + PRIOR - F.col("toxic") - prior)) - F.log((F.col("other") + prior) / (n0 + PRIOR - F.col("other") - prior))
    sure = odds / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    picked = counted.filter(F.octet_length("token") > 0).select("token", odds.alias("odds"), sure.alias("sure")).filter(F.abs("sure") >= CLEAR)
    known = {bytes(r.token): float(r.odds) for r in picked.collect()}  # tokens of the bounded sample, those that several groups share
    return calibrated(rows, known, share)


def calibrated(rows: DataFrame, known: dict[bytes, float], share: dict[int, float]) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)

        seen = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((toxic, round(s, 2)) for s in map(scores.__getitem__, words_of(text)))
        keys = sorted(seen)
        yield pa.RecordBatch.from_pydict({"toxic": [k[0] for k in keys], "score": [k[1] for k in keys], "n": [seen[k] for k in keys]}, pa.schema([("toxic", pa.int32()), ("score", pa.float64()), ("n", pa.int64())]))

    later = rows.filter("_later").select("_text", "_toxic")
    spread = later.mapInArrow(means, "toxic int, score double, n long").groupBy("toxic", "score").agg(F.sum("n").alias("n")).collect()  # scores have two decimals: a bounded histogram
    x = {y: np.array([(r["score"], r["n"]) for r in spread if r["toxic"] == y], np.float64).reshape(-1, 2) for y in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return Model({}, 1.0, 1.0, 1.0, 1.0, -50.0)
    mean = {y: float((v[:, 0] * v[:, 1]).sum() / v[:, 1].sum()) for y, v in x.items()}
    cost = max((mean[0] + mean[1]) / 2, mean[0] + 1e-3, 1e-3)
    decay = _decay(x[0][:, 0] - cost, x[0][:, 1])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            found = [passages(t, scores, cost) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [n for n, _ in found], "s": [sorted((p[2] for p in ps), reverse=True)[:SUMMED] for _, ps in found], "y": batch.column(1)}, pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64())), ("y", pa.int32())]))

    data = later.mapInArrow(best, "n long, s array<double>, y int").collect()  # one row for each sampled document
    n, y = (np.array(v, np.float64) for v in zip(*((max(1, r["n"]), r["y"]) for r in data)))
    top = np.array([max(r["s"], default=0.0) for r in data])
    other = y == 0
    scale = float(other.sum() / (n[other] * np.exp(-decay * top[other])).sum())
    x = np.array([evidence(max(1, r["n"]), r["s"], decay, scale) for r in data])
    slope, offset = _logistic(x, y, np.where(y == 1, 1 / share.get(1, 1), 1 / share.get(0, 1)))
    return Model(known, cost, decay, scale, slope, offset)


def evidence(n: int, scores: list[float], decay: float, scale: float) -> float:
    """Minus the logarithm of the smallest chance of the r best segments of n tokens, over r.

    The sum T of r normalised scores decay * S - ln(scale * n) has the chance exp(-T) T^(r-1) / (r! (r-1)!) where T is large; each
    further segment costs a factor of two, as all r are tried.
    """
    base = math.log(scale * n)
    best = total = decay * max(scores, default=0.0) - base
    for r, s in enumerate(sorted(scores, reverse=True)[1:SUMMED], 2):
        total += decay * s - base
        if total <= r * (r - 1):
            break
        best = max(best, total - (r - 1) * (math.log(total) + math.log(2)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def _decay(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(r x)] = 1, where the mean of x is negative; 1 if nothing scores above zero."""
    share = weights / weights.sum()
    if values.max(initial=-1.0) <= 0:
        return 1.0
    f = lambda r: float((share * np.exp(np.minimum(r * values, 700))).sum()) - 1
    low, high = 0.0, 1e-3
    while f(high) <= 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) <= 0 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve with a little ridge, by Newton's method.

    The loss is convex; a step is halved until it lowers the loss, so that the search can neither cycle nor run away.
    """
    x = np.clip(x, -50, 50)
    mid, wide = float(x.mean()), max(float(x.std()), 1e-9)
    z, weight = (x - mid) / wide, weight / weight.sum()

    def loss(a: float, b: float) -> float:
        return float((weight * (np.logaddexp(0, a * z + b) - y * (a * z + b))).sum()) + RIDGE * (a * a + b * b) / 2

    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([(weight * (p - y) * z).sum() + RIDGE * a, (weight * (p - y)).sum() + RIDGE * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * z * z).sum() + RIDGE, (w * z).sum()], [(w * z).sum(), w.sum() + RIDGE]])
        step, now, size = np.linalg.solve(h, g), loss(a, b), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        if size <= 1e-6 or float(np.abs(size * step).max()) < 1e-9:
            break
        a, b = a - size * step[0], b - size * step[1]
    slope = max(a / wide, 1e-6)
    return float(slope), float(b - a * mid / wide)


def judged(text: Column, model: Model) -> Column:
    """Score and significant passages (in words) of a text column; null counts as empty."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf(JUDGED)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scores = Scores(m.scores)
        kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
        for batch in batches:
            out = []
            for text in batch:
                n, found = passages(text.as_py(), scores, m.cost)
                alone = lambda s: evidence(max(1, n), [s], m.decay, m.scale)  # noqa: B023, E731
                top = min(50.0, max(-50.0, evidence(max(1, n), [s for _, _, s in found], m.decay, m.scale)))
                score = 1 / (1 + math.exp(-min(30.0, max(-30.0, m.slope * top + m.offset))))
                score = score if found else min(score, NOTHING)
                out.append({"score": score, "passages": [{"start": a, "end": b, "score": s} for a, b, s in found if alone(s) >= -math.log(SIGNIFICANT)]})
            yield pa.array(out, kind)

    return judge(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row of `docs`: id, held_out, score (0 to 1), predicted (0 or 1), passages (start, end in words, score).

    A null text is empty and scores like any text without passages. A null id is held out. Null or other labels teach
    nothing; an id with both labels is toxic. Repeated rows are scored each, very long texts whole, no rows give no rows.
    Further columns of either table are not read.
    """
    model = learn(docs, labels, id_col, text_col, label_col)
    scored = docs.select(docs[id_col].cast("long").alias(id_col), judged(docs[text_col], model).alias("_j"))
    score = F.col("_j.score")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "_j.passages")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs` that are not predicted toxic; columns stay as they are."""
    columns = docs.columns
    model = learn(docs, labels, id_col, text_col, label_col)
    row = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), judged(docs[text_col], model).alias("_j")).filter("_j.score < 0.5")
    return row.select(*(F.col("_row").getField(c).alias(c) for c in columns))
