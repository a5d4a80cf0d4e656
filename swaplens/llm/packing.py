"""Best-fit packing of documents into sequences, by a configuration linear program over the histogram of lengths.

Lengths are at most the size of a sequence, so histogram, patterns and plan are of bounded size whatever the number
of documents. The covering program (as few patterns as cover every length's count) is solved by multiplicative weights;
each step prices lengths by their weights and finds the best pattern by knapsack dynamic programming. Whole parts of the
solution become sequences, what is left is packed best fit by decreasing length. Pieces then find their place by their
rank in length order alone, without ever being collected.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaplens.llm import vocabularies as V
from swaplens.llm.common import keyed_text, numbered, written

ROUNDS = 24  # pricing steps of the program
STEP = 0.5  # share of what is left that a step may cover
EDGE = 1 / 64  # weight of the multiplicative weights beside the filled room
CACHED = 200_000  # pieces a worker keeps; about 45 MB, since they stay there through the other stages of a pipeline


def _knapsack(lengths: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """For each capacity the item to take first (its index in `lengths`, which ascend), or -1: leave a unit empty."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(int(lengths[0]), size + 1):
        k = np.searchsorted(lengths, room, "right")
        got = best[room - lengths[:k]] + value[:k]
        j = int(got.argmax())
        if got[j] > best[room - 1]:
            best[room], choice[room] = got[j], j
        else:
            best[room] = best[room - 1]
    return choice


def solve(counts: dict[int, int], size: int, rounds: int = ROUNDS) -> dict[tuple[tuple[int, int], ...], float]:
    """Patterns ((length, how many), ...) and how often each is used: a fractional cover of the counts.

    A round weights each length by exp(-covered share / STEP), so that lengths left behind gain, prices a unit of a length
    by its size and weight, and solves one knapsack. Its table holds the best pattern around every length, and
    each of them takes up to STEP of what is left.
    """
    left = {n: float(counts[n]) for n in sorted(counts)}
    used: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        live = [n for n, c in left.items() if c >= 1]
        if not live:
            break
        lengths = np.array(live, np.int64)
        weight = np.exp(-np.array([1 - left[n] / counts[n] for n in live]) / STEP)
        choice = _knapsack(lengths, lengths * (1 + EDGE * weight / weight.max()), size).tolist()
        moved = False
        for seed in reversed(live):
            if left[seed] < 1:
                continue
            taken, room = {seed: 1}, size - seed
            while room > 0:
                if choice[room] < 0:
                    room -= 1
                    continue
                n = live[choice[room]]
                room -= n
                taken[n] = taken.get(n, 0) + 1
            most = min(left[n] / k for n, k in taken.items())
            if most < 1:
                continue  # used up meanwhile: the next round prices without it
            amount = max(1.0, STEP * most)
            for n, k in taken.items():
                left[n] -= amount * k
            key = tuple(sorted(taken.items()))
            used[key] = used.get(key, 0.0) + amount
            moved = True
        if not moved:
            break  # the rest is best fit's
    return used


def plan(counts: dict[int, int], size: int, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns with whole numbers of sequences, which hold exactly all pieces that `counts` (length: number) has.

    The program's patterns are rounded down, the fullest first; what they leave is packed best fit. Rounding may stop at any
    share of them, and the share (in quarters) that needs the fewest sequences is taken.
    """
    solution = sorted(solve(counts, size, rounds).items(), key=lambda x: (-sum(n * k for n, k in x[0]), x[0])) if counts else []
    best: list | None = None
    for share in range(4, -1, -1):
        left, whole = dict(counts), []
        for pattern, amount in solution[: len(solution) * share // 4]:
            times = min(int(amount + 1e-6), *(left[n] // k for n, k in pattern))
            if times:
                whole.append((pattern, times))
                for n, k in pattern:
                    left[n] -= times * k
        whole += best_fit(left, size)
        if best is None or sum(t for _, t in whole) < sum(t for _, t in best):
            best = whole
    return best or []


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit by decreasing length, for all pieces of a length at once: bins alike stay together as one entry."""
    bins: dict[int, list[list]] = {}  # room: [[content, number of bins], ...]
    rooms: list[int] = []

    def put(room: int, content: tuple, number: int) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
        bins.setdefault(room, []).append([content, number])

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        waiting = counts[length]
        while waiting:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                full, rest = divmod(waiting, each)
                if full:
                    put(size - each * length, ((length, each),), full)
                if rest:
                    put(size - rest * length, ((length, rest),), 1)
                break
            room = rooms[at]
            content, number = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            each = min(room // length, waiting)
            filled = min(number, waiting // each)
            if filled < number:
                put(room, content, number - filled)
            put(room - each * length, (*content, (length, each)), filled)
            waiting -= filled * each
    return [(content, number) for room in sorted(bins) for content, number in bins[room]]


def places(chosen: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length, for its pieces in order of rank: (first rank, first sequence, pieces a sequence, offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for pattern, times in chosen:
        offset = 0
        for n, k in pattern:
            out.setdefault(n, []).append((rank.get(n, 0), sequence, k, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return out


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every document's ids with `end_id`, cut at `size`: id, piece, start, length, ids_crc32 (and the ids themselves)."""
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = V.word_encoder(tokenizer, CACHED)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder(batch.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(schema)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    spec = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return keyed_text(docs, id_col, text_col).mapInArrow(encode, spec)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset (and `ids`, packed, if asked for).

    Only documents of more than `size` tokens are cut. A null text is empty: one piece that holds only `end_id`. A
    null id stays null. Repeated rows are packed each, ties in any order of theirs (their pieces are equal or of
    equal length). An empty table gives no rows. Further columns are not read.
    """
    cut = written(pieces(docs, tokenizer, size, end_id, id_col, text_col, keep_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    where = places(plan(counts, size))
    first, before = {}, 0
    for n in sorted(counts):
        first[n], before = before, before + counts[n]
    table = docs.sparkSession.sparkContext.broadcast({n: (first[n], *map(np.array, zip(*rows))) for n, rows in where.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, position: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(), position.to_numpy()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for n in np.unique(size):
            mine = size == n
            start, ranks, sequences, each, offsets = table.value[int(n)]
            rank = at[mine] - start
            k = np.searchsorted(ranks, rank, "right") - 1
            r = rank - ranks[k]
            sequence[mine], offset[mine] = sequences[k] + r // each[k], offsets[k] + (r % each[k]) * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = numbered(cut, [F.col("length"), F.col(id_col), F.col("piece")], "ranks")
    return ranked.withColumn("_place", place("length", "before")).select(*cut.columns, "_place.sequence_id", "_place.offset")
