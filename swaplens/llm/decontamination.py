"""Benchmark decontamination by suffix arrays over the training documents.

Each task sorts the suffixes of its documents' words into one suffix array per shard of about SHARD words; every suffix
of the benchmark is searched in it by binary search, which gives the occurrences of each window and, by extension, the
longest verbatim match. Words that no benchmark item has end a suffix: nothing beyond them can match, so suffixes too
short for any window are left out, which changes no result. Texts are never shuffled. The benchmark is broadcast in blocks of at
most BLOCK words; more blocks mean further passes whose findings are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = 1_000_000  # words of documents in one suffix array
BLOCK = 500_000  # words of the benchmark in one broadcast (an item is never cut)

#: Words are runs of digits, lower-case letters and everything beyond ASCII; A-Z are lower-cased first.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

FOUND = "struct<n_words: bigint, n_hit: bigint, longest: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Benchmark:
    """Items as sequences of word numbers (from 1; 0 ends an item), their windows and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        sequence, of_window = [], {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                of_window.setdefault(tuple(ids[k : k + size]), ([], []))
                names, starts = of_window[tuple(ids[k : k + size])]
                names.append(item)
                starts.append(len(sequence) + k)
            sequence += [*ids, 0]
        self.sequence = np.array(sequence + [0] * (window + 1), np.int64)
        self.names = [sorted(set(names)) for names, _ in of_window.values()]
        order = suffix_array(self.sequence, _left(self.sequence))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        #: where each window stands in the benchmark, by the order of the suffixes there; `first`: where its places begin
        places = [np.array(starts, np.int64) for _, starts in of_window.values()]
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
        self.places = np.concatenate([np.zeros(0, np.int64), *(p[np.argsort(rank[p])] for p in places)])
        self.lengths = np.array([len(w) for w in of_window], np.int64)
        self.windows = np.zeros((len(of_window), window), np.int64)
        for row, w in zip(self.windows, of_window):
            row[: len(w)] = w
        self.shortest = int(self.lengths.min()) if len(of_window) else 0


def suffix_array(sequence: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of `sequence` in the order of their suffixes, each up to the 0 that ends its run.

    `left`: how many words each position has before that 0. Ranks of 1, 2, 4, ... words are refined by
    prefix doubling until none changes.
    """
    rank = sequence.astype(np.int64)
    step, classes = 1, -1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        ahead[left <= step] = 0
        kinds, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)
        if len(kinds) == classes or len(kinds) == len(sequence):
            return np.argsort(rank, kind="stable")
        classes, step = len(kinds), 2 * step
        if step >= len(sequence):
            return np.argsort(rank, kind="stable")


def _left(sequence: np.ndarray) -> np.ndarray:
    """How many words each position has before the next 0."""
    ends, at = np.flatnonzero(sequence == 0), np.arange(len(sequence))
    return ends[np.searchsorted(ends, at)] - at


def _bound(sequence: np.ndarray, order: np.ndarray, bench: Benchmark, after: bool) -> np.ndarray:
    """For each window, how many suffixes come before it (`after`: or start with it)."""
    low, high = np.zeros(len(bench.lengths), np.int64), np.full(len(bench.lengths), len(order), np.int64)
    width = np.arange(bench.windows.shape[1])
    inside = width[None, :] < bench.lengths[:, None]
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        differ = np.where(inside[open_], sequence[order[mid][:, None] + width] - bench.windows[open_], 0)
        first = (differ != 0).argmax(axis=1)
        sign = differ[np.arange(len(open_)), first]
        smaller = (sign < 0) | (after & (sign == 0))
        low[open_[smaller]] = mid[smaller] + 1
        high[open_[~smaller]] = mid[~smaller]
    return low


def search(texts: list[str], bench: Benchmark) -> list[dict]:
    """What each text has of the benchmark: n_words, n_hit, longest, spans of hit words, items (sorted)."""
    get = bench.vocabulary.get
    split = [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)) for w in map(words_of, texts)]
    sizes = np.array([len(w) for w in split], np.int64)
    found = [{"n_words": int(n), "n_hit": 0, "longest": 0, "spans": [], "items": []} for n in sizes]
    if not bench.shortest or not sizes.sum():
        return found
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    whole = np.concatenate([x for w in split for x in (w, [0])]).astype(np.int64)
    ends = np.flatnonzero(whole == 0)
    left = _left(whole)
    run = left + np.arange(len(whole)) - np.concatenate([[-1], ends])[np.searchsorted(ends, np.arange(len(whole)))] - 1
    kept = np.flatnonzero(run >= bench.shortest)  # runs long enough, and the 0 after each
    if not kept.size:
        return found
    pad = bench.windows.shape[1] + 1
    sequence = np.concatenate([whole[kept], np.zeros(pad, np.int64)])
    order = suffix_array(sequence[: len(kept)], left[kept])
    low, high = _bound(sequence, order, bench, False), _bound(sequence, order, bench, True)
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    if not which.size:
        return found
    at = order[np.repeat(low, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
    longest = _longest(sequence, at, which, bench)
    place = kept[at]
    doc = np.searchsorted(starts, place, "right") - 1
    turn = np.lexsort((place, doc))
    which, place, doc, longest = which[turn], place[turn] - starts[doc[turn]], doc[turn], longest[turn]
    for d, a, b in zip(*(x.tolist() for x in _groups(doc))):
        mine = found[d]
        spans: list[dict] = []
        for start, end in zip(place[a:b].tolist(), (place[a:b] + bench.lengths[which[a:b]]).tolist()):
            if spans and start <= spans[-1]["end"]:
                spans[-1]["end"] = max(end, spans[-1]["end"])
            else:
                spans.append({"start": start, "end": end})
        names = {n for w in np.unique(which[a:b]) for n in bench.names[w]}
        mine |= {"spans": spans, "n_hit": sum(s["end"] - s["start"] for s in spans), "items": sorted(names), "longest": int(longest[a:b].max())}
    return found


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], first, np.concatenate([first[1:], [len(values)]])


def _longest(sequence: np.ndarray, at: np.ndarray, which: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Words of the longest match from each `at`, where window `which` stands, over all places of that window.

    A window's places are in the order of their suffixes, so a binary search finds the two between which the document's
    suffix belongs; no other agrees in more words.
    """
    low, high = bench.first[which], bench.first[which + 1]
    best = bench.lengths[which].copy()
    below, above = best.copy(), best.copy()  # words in common with the bounds, and with all between them the lesser
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        size, smaller = _extent(sequence, at[open_], bench.sequence, bench.places[mid], np.minimum(below[open_], above[open_]))
        best[open_] = np.maximum(best[open_], size)
        low[open_[smaller]], below[open_[smaller]] = mid[smaller] + 1, size[smaller]
        high[open_[~smaller]], above[open_[~smaller]] = mid[~smaller], size[~smaller]
    return best


def _extent(sequence: np.ndarray, at: np.ndarray, other: np.ndarray, start: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from `at` and `start` on, of which `known` are known to, and whether `other` is smaller there."""
    size, live = known.copy(), np.arange(len(at))
    while live.size:
        word = sequence[at[live] + size[live]]
        live = live[(word != 0) & (word == other[start[live] + size[live]])]
        size[live] += 1
    return size, other[start + size] < sequence[at + size]


def _blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[Benchmark]:
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text")).filter("item IS NOT NULL")
    size = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    count = max(1, -(-int(size) // BLOCK))
    for k in range(count):
        mine = items if count == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield Benchmark([(r.item, r.text) for r in mine.collect()], window)  # bounded by BLOCK words


def findings(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with `found`, a struct of n_words, n_hit, longest, spans and items. See `contamination` for odd cases."""
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(benchmark, window, item_col, item_text)]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    parts = [_search(block)(text) for block in blocks]
    if len(parts) == 1:
        return docs.withColumn("found", parts[0])
    return docs.withColumn("_parts", F.array(*parts)).withColumn("found", merged()).drop("_parts")


def _search(block):
    @F.arrow_udf(FOUND)
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
        for batch in batches:
            out, shard, size = [], [], 0
            for text in batch.to_pylist():
                shard.append(text)
                size += len(text) // 6 + 1
                if size >= SHARD:
                    out += search(shard, block.value)
                    shard, size = [], 0
            yield pa.array(out + search(shard, block.value), kind)

    return searched


def merged() -> Column:
    """One finding from those of all blocks; `spans` may overlap, `n_hit` counts each word once."""
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform("_parts", lambda p: p["spans"]))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    counted = F.aggregate(
        spans, start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    )
    return F.struct(
        F.get("_parts", F.lit(0))["n_words"].alias("n_words"), counted["n"].alias("n_hit"), F.array_max(F.transform("_parts", lambda p: p["longest"])).alias("longest"),
        spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("_parts", lambda p: p["items"])))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest match), items, spans.

    A null text has no words, nor does a null item text; items without id take no part. Items of equal id count once.
    Repeated rows are judged each, very long texts whole. An empty benchmark hits nothing, and no documents give no
    rows. Further columns of either table are not read.
    """
    found = findings(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias("_text")), benchmark, window, "_text", item_col, item_text)
    return found.select(
        id_col, "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"), (F.size("found.spans") > 0).alias("contaminated"), "found.longest", "found.items", "found.spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark; columns stay as they are."""
    columns = docs.columns
    row = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), docs[text_col].alias("_text"))
    kept = findings(row, benchmark, window, "_text", item_col, item_text).filter(F.size("found.spans") == 0)
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in columns))
