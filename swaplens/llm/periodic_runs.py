"""Periodic runs of words: classes of suffixes united by decreasing common prefix, over ordered sets of positions.

Suffixes of a text that share a prefix of some length form a class. Classes are united in the order of decreasing length
(Kruskal's order on the LCP array). When two are united at length l, positions of different classes that become neighbours at
a distance q have a common prefix of exactly l: with q <= l words repeat at distance q from the first position on, for
q + l words. Neighbours never skip a smaller period: it would have united a position between them before. The first position
of a run is one of its seeds, so the smallest seed for each (end, period) is where the run starts.

A run of exponent e and length n has l >= n (1 - 1/e) at its start. Stretches of that many words that occur once in a text are
found first, by doubling on all words of many texts at once; only texts with repeated stretches get a suffix array.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 2_500_000  # bytes of texts that are searched together; a longer text comes alone


def repeated(words: np.ndarray, text: np.ndarray, size: int, copies: int) -> np.ndarray:
    """The texts in which a stretch of `size` words occurs twice, all of whose words occur `copies` times or more."""
    _, rank, n = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[rank] >= copies)
    full = np.full(len(words) + size, -1)
    full[at] = rank[at]
    done = 1
    while done < size and len(at):
        step = min(done, size - done)
        at = at[full[at + step] >= 0]
        key, rank, n = np.unique(full[at] * (len(words) + 1) + full[at + step], return_inverse=True, return_counts=True)
        twice = n[rank] > 1
        full[:] = -1
        at = at[twice]
        full[at] = rank[twice]
        done += step
    return np.unique(text[at])


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes: classes by ever longer prefixes, only those not yet alone are sorted again."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.concatenate([[True], words[order][1:] != words[order][:-1]])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[n] = -1
    active = order[~(first & np.append(first[1:], True))]
    step = 1
    while len(active):
        key = rank[active] * (n + 1) + rank[np.minimum(active + step, n)] + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        here = np.arange(len(active))
        new_class = np.concatenate([[True], key[1:] != key[:-1]])
        old_class = np.concatenate([[True], old[1:] != old[:-1]])
        start = np.maximum.accumulate(np.where(new_class, here, 0)) - np.maximum.accumulate(np.where(old_class, here, 0))
        rank[active] = old + start
        active = active[~(new_class & np.append(new_class[1:], True))]
        step *= 2
    order[rank[:n]] = np.arange(n)
    return order


def common_prefixes(words: list[int], order: np.ndarray) -> np.ndarray:
    """For each place in `order` but the first, the length of the prefix that its suffix shares with the one before."""
    n = len(words)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    out, h = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        far = n - max(i, j)
        while h < far and words[i + h] == words[j + h]:
            h += 1
        out[i] = h
        h = max(0, h - 1)
    return np.array(out)[order]


def runs(words: np.ndarray, least: int, copies: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of `least` words and `copies` periods or more, by start, then period."""
    order = suffix_order(words)
    shared = common_prefixes(words.tolist(), order)
    needed = -(-least * (copies - 1) // copies)
    edges = np.flatnonzero(shared >= needed)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    left, right, lengths = order[edges - 1].tolist(), order[edges].tolist(), shared[edges].tolist()
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}  # ordered positions of a class, under its root
    found: dict[tuple[int, int], int] = {}

    def root(i: int) -> int:
        top = i
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[i] != top:
            parent[i], i = top, parent[i]
        return top

    def seed(a: int, b: int, shared: int) -> None:
        q = b - a
        if q + shared >= least and shared >= (copies - 1) * q:
            key = (b + shared, q)
            found[key] = min(a, found.get(key, a))

    for i, j, l in zip(left, right, lengths):
        a, b = root(i), root(j)
        large, small = members.get(a) or [a], members.get(b) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        for k, x in enumerate(small):
            at = bisect(large, x)
            if at and (k == 0 or small[k - 1] < large[at - 1]):
                seed(large[at - 1], x, l)
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                seed(x, large[at], l)
        if len(small) == 1:
            insort(large, small[0])
        else:
            large += small
            large.sort()  # two ordered stretches: linear
        parent[b] = a
        members[a] = large
        members.pop(b, None)
    return sorted((start, end - start, q) for (end, q), start in found.items())


def _search(words: Sequence[Sequence[bytes]], least: int, copies: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    ids: dict[bytes, int] = {}
    sizes = [len(w) for w in words]
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64, sum(sizes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if len(flat):
        ends = np.cumsum(sizes)
        for k in repeated(flat, np.repeat(np.arange(len(words)), sizes), -(-least * (copies - 1) // copies), copies).tolist():
            out[k] = runs(flat[ends[k] - sizes[k] : ends[k]], least, copies)
    return out


def groups(batch: pa.RecordBatch, most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts (the second column) have at most `most` bytes together; a longer one comes alone."""
    start = size = 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _collapsed(words: Sequence[bytes], found: Sequence[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by single spaces."""
    if not found:
        return b" ".join(words).decode()
    kept, at = [], 0
    gone = sorted((start + q, start + n) for start, n, q in found)
    for a, b in gone:
        if b > at:
            kept += words[at:a]  # empty if a < at
            at = max(at, b)
    return b" ".join([*kept, *words[at:]]).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, copies: int = 3) -> DataFrame:
    """Per row of `docs`: id, runs (start, length, period in words; by start, then period), collapsed (the text with each
    run cut to its first period, words joined by single spaces).

    Words lie between ASCII white space. A run has the smallest period q it can, is max(least, copies * q) words or longer
    and can be extended on neither side. Null and empty texts have no words and no runs; ids may be null or repeat, each row is
    searched by itself. Very long texts are searched whole, in memory in proportion to the one text. No rows give no rows.
    Further columns are not read.
    """
    if copies < 2 or least < copies:
        raise ValueError("runs need at least two periods and one word for each")

    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([(id_col, pa.int64()), ("runs", pa.list_(kind)), ("collapsed", pa.string())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups(batch):
                words = [text.as_py().encode().split() for text in group.column(1)]
                found = _search(words, least, copies)
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
                yield pa.RecordBatch.from_arrays([group.column(0), pa.array(listed, pa.list_(kind)), pa.array(map(_collapsed, words, found), pa.string())], schema=schema)

    rows = docs.select(docs[id_col].cast("long").alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(search, f"`{id_col}` long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
