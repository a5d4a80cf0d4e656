"""Token counts of documents, by a broadcast table of frequent pieces and a cache in each worker for the rest.

A piece is a run of white space and the word after it. A byte-level tokenizer never joins tokens across the end of a
word, so a text's count is the sum over its pieces, in any script, and equals the library's. The counts of the
pieces that are frequent anywhere are found by bounded counters in each task; only what those counters hold is
shuffled, never the pieces of texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaplens.llm import vocabularies as V
from swaplens.llm.common import keyed_text

PIECE = re.compile(f"[{V.WHITE}]*[^{V.WHITE}]+|[{V.WHITE}]+")

TABLE = 65_536  # pieces in the broadcast table: the bound of its size
PER_TASK = 8_192  # pieces a task proposes for it
COUNTED = 300_000  # pieces a task's counter holds before the rare half is forgotten


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(PIECE.findall(text))
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(COUNTED // 2)))
    top = [(p, n) for p, n in counts.most_common(PER_TASK) if len(p) <= V.LONGEST]
    yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in top], "n": [n for _, n in top]}, pa.schema([("piece", pa.string()), ("n", pa.int64())]))


def frequent_pieces(texts: DataFrame, size: int = TABLE) -> list[str]:
    """The most frequent pieces of column `text`, at most `size`; ties go to the smaller piece."""
    found = texts.select("text").mapInArrow(_proposals, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in found.orderBy(F.desc("n"), "piece").limit(size).select("piece").collect()]


class _Tiers(dict):
    """The table of frequent pieces; for others the worker's cache is asked."""

    def __init__(self, frequent: dict[str, int], missed: V.Known):
        super().__init__(frequent)
        self.missed = missed

    def __missing__(self, piece: str) -> int:
        return self.missed[piece]


@lru_cache(maxsize=2)
def _lengths(path: str) -> V.Known:
    """The cache of this worker for what the broadcast table does not hold; it outlives the task."""
    coder = V.load(path)
    return V.Known(lambda piece: len(coder.encode(piece, add_special_tokens=False)), False)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, table_size: int = TABLE) -> DataFrame:
    """Per row of `docs`: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (no tokens); a null id stays null; repeated rows are counted each. Very long texts
    are counted whole. Tables without rows give none. Other columns are not read, whatever their names.
    """
    texts = keyed_text(docs, id_col, text_col)
    spark = docs.sparkSession
    pieces = frequent_pieces(texts, table_size)
    coder = V.load(tokenizer)
    lengths = [len(e.ids) for e in coder.encode_batch(pieces, add_special_tokens=False)] if pieces else []
    # compact: one string and one array, from which each worker builds its hash table once
    table = spark.sparkContext.broadcast(("\0".join(p for p in pieces if "\0" not in p), pa.array([n for p, n in zip(pieces, lengths) if "\0" not in p], pa.uint16())))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        joined, sizes = table.value
        tiers = _Tiers(dict(zip(joined.split("\0"), sizes.to_pylist())) if len(sizes) else {}, _lengths(tokenizer))
        for batch in batches:
            out = []
            for text in batch:
                out.append(sum(map(tiers.__getitem__, PIECE.findall(text))))
                tiers.missed.trim(V.CACHED)
            yield pd.Series(out, dtype="int64")

    counted = texts.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
