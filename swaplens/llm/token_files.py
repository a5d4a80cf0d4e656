"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of their id and each range is written in ascending order, so a reader of some ids skips
files and stripes by their minimum and maximum and strides of rows by the index and the filters. Stripes are read in
parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swaplens.llm import vocabularies as V
from swaplens.llm.common import keyed_text, new_folder, shifted, written


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens array<int>), dealt by ranges of id; the end id closes each document."""
    texts = keyed_text(docs, id_col, text_col)
    ranges = texts.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, "text")
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = V.word_encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = [ids + end for ids in coder(part.column(1).to_pylist())]
                offsets = [0]
                for ids in packed:
                    offsets.append(offsets[-1] + len(ids) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[id_col, "tokens"])

    return ranges.mapInArrow(encode, f"`{id_col}` long, tokens array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes `docs` as files of (id, place, tokens, range) in ascending id order; ties in id are ordered by text."""
    tokens = encoded(docs, tokenizer, end_id, id_col, text_col)
    placed = tokens.select(id_col, F.monotonically_increasing_id().alias("_at"), "tokens", F.spark_partition_id().alias("_part"))
    (
        placed.write.format("orc")
        .option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", "0.01")
        .save(path)
    )


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The files' rows; a filter on the id reaches their minima, maxima and Bloom filters."""
    return spark.read.schema(f"`{id_col}` long, _at long, tokens array<int>, _part int").orc(path)


def checked(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document in the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            data, bounds = memoryview(tokens.values.buffers()[1] or b""), tokens.offsets.to_pylist()
            skip = 4 * tokens.values.offset
            crc = [zlib.crc32(data[skip + 4 * a : skip + 4 * b]) for a, b in zip(bounds, bounds[1:])]
            size = [b - a for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "_at", "_part", "n_tokens", "ids_crc32"])

    rows = read(spark, path, id_col).select(id_col, "_at", "_part", "tokens")
    found = rows.mapInArrow(digests, f"`{id_col}` long, _at long, _part int, n_tokens long, ids_crc32 long")
    return shifted(written(found, "token-digests"), F.col("n_tokens")).select(id_col, F.col("before").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to a new shared folder and reads them back: one row per row of `docs`.

    A null text is empty and holds only the end id. Null ids come first; rows that are equal in id are ordered by text,
    so that repeated rows give the same rows again. No rows give files without rows and no rows. Further columns are
    not read, whatever their names.
    """
    path = new_folder(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id, id_col, text_col)
    return checked(docs.sparkSession, path, id_col)
