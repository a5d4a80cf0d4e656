"""Near duplicates by SimHash, found by ball hashing that meets in the middle.

Every distinct fingerprint emits itself and its 64 neighbours at one bit. Two fingerprints that differ in at most two
bits share one of these variants, and fingerprints that share a variant differ in at most two bits. A variant has at
most 65 fingerprints around it, so no group is large; each is linked to the smallest of its group, which keeps the same
components with far fewer links than all pairs. Copies never meet: only distinct fingerprints are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swaplens.llm.common import components, written

SEED = 42
BLOCK = 200_000  # hashes of one text whose bits are spread out at a time


def fingerprint(text: str, size: int = 3) -> int:
    """The SimHash of whole `text`: A-Z in lower case, words between ASCII white space, shingles of `size` words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, size: int = 3) -> Column:
    """The fingerprint of a text column as a signed long; null counts as empty, which has fingerprint zero."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((fingerprint(t.as_py(), size) for t in batch), pa.int64())

    return simhash(F.coalesce(text.cast("string"), F.lit("")))


def variants(fp: Column) -> Column:
    """`fp` and all longs that differ from it in one bit."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit((1 << k) - ((1 << 64) if k == 63 else 0)).cast("long")) for k in range(64)))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints `fp` at one or two bits, enough to reach every one that all pairs reach."""
    balls = distinct.select("fp", F.explode(variants(F.col("fp"))).alias("variant"))
    met = balls.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("low")).filter("fp <> low").distinct()
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= 2).select(F.col("fp").alias("a"), F.col("low").alias("b"))


def placed(fingerprinted: DataFrame) -> DataFrame:
    """(fp, first, root) of the distinct `_fp` in rows (_id, _fp): its smallest id, and the name of its component."""
    distinct = fingerprinted.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("first"))
    roots = components(links(distinct.select("fp")), "links")
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Per row of `docs`: id, fingerprint (16 lower-case hex digits), component_id (the smallest id that can be reached).

    Null and empty texts have fingerprint zero and link like any other. Null ids get a component but are never its
    name; it is null if its component has no other. Repeated rows stay and share their component. Very long texts are
    read whole, no rows give no rows, further columns are not read.
    """
    rows = written(docs.select(docs[id_col].cast("long").alias("_id"), fingerprints(docs[text_col], size).alias("_fp")), "fingerprints")
    found = placed(rows)
    smallest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = found.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, "_fp", "left").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """The rows of `docs` with one of each component: that of smallest id, null last; of equal ids, one text.

    Columns stay as they are, whatever their names. Rows equal in id and text are one.
    """
    columns = docs.columns
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    row = docs.select(
        docs[id_col].cast("long").alias("_id"), F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), text)).alias("_key"), text.alias("_text"), F.struct(*(docs[c] for c in columns)).alias("_row")
    )
    rows = written(row.select("_id", "_key", fingerprints(F.col("_text"), size).alias("_fp")), "fingerprints")
    first = rows.groupBy("_fp").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key")).alias("_first"))  # copies meet in no join
    named = first.join(placed(rows).select(F.col("fp").alias("_fp"), "root"), "_fp")
    keep = named.groupBy("root").agg(F.min("_first").alias("_first")).select(F.col("_first._key").alias("_key"))
    kept = row.select("_key", "_row").join(keep, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in columns))
