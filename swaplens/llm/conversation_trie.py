"""The prefix trie of conversations, by adaptive radix trees over ranges of sorted keys.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, a conversation's key the ids of its turns. Keys are dealt by
range of (key, conversation), so that a group of conversations that begin or are alike, however large, is spread over tasks. Each
task builds trees of bounded size and emits a node wherever a tree's path reaches the end of a turn. Nodes on the path to the
first or the last key of a tree may go on in other trees: they are open, and few. Open nodes are merged by the
digest of their prefix; all others are whole where they are found. What an open node sums over open nodes below it is a
difference of running totals, as the order of trees is the order in which a walk meets the nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaplens.llm.common import written
from swaplens.llm.radix_tree import Node, Tree

WIDTH = 16  # bytes of a turn's id
ROWS, BYTES = 50_000, 8_000_000  # conversations and bytes of keys in a tree, at most; a longer key is a tree of its own

PART = T.StructType(
    [
        T.StructField("tree", T.LongType()),  # trees in the order of their keys
        T.StructField("open", T.BooleanType()),
        T.StructField("side", T.IntegerType()),  # of an open node: 0 on the path to the first key, 1 on that to the last only
        T.StructField("till", T.IntegerType()),  # of an open node: the last path that it lies on
        T.StructField("depth", T.IntegerType()),
        T.StructField("prefix", T.BinaryType()),  # of an open node: the digest of its key
        T.StructField("above", T.BinaryType()),  # and of its parent's
        T.StructField("conv_id", T.LongType()),
        T.StructField("parent_conv_id", T.LongType()),  # if the parent is not open
        T.StructField("parent_side", T.IntegerType()),  # if it is
        T.StructField("n_convs", T.LongType()),
        T.StructField("n_children", T.LongType()),
        T.StructField("n_leaves", T.LongType()),
        T.StructField("saved_tokens", T.LongType()),
        T.StructField("chars", T.LongType()),
        T.StructField("ends", T.StringType()),  # ids of conversations that end here (open), or their digest
    ]
)


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(block, conv_id, key, chars): per conversation the ids of its turns in order, in hex, and their texts' code points.

    Turns are ordered by number, null first, those of equal number by id; repeated rows are turns of their own. Rows
    without conversation belong to none. Only ids and lengths meet in one place, never texts.
    """
    said = F.coalesce(turns[text].cast("string"), F.lit(""))
    who = F.coalesce(turns[role].cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.encode(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), "utf-8"), 256), 1, 2 * WIDTH))
    number = turns[turn].cast("long")
    one = F.struct(number.isNotNull().alias("there"), F.coalesce(number, F.lit(0)).alias("number"), digest.alias("id"), F.char_length(said).alias("chars"))
    rows = turns.select(turns[conv].cast("long").alias("conv_id"), one.alias("turn")).filter("conv_id IS NOT NULL")
    rows = rows.withColumn("block", block_of(F.col("conv_id"))).repartition("block")  # which serves the window of `rebuilt` too
    grouped = rows.groupBy("block", "conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("block", "conv_id", F.expr("array_join(transform(turns, t -> hex(t.id)), '')").alias("key"), F.col("turns.chars").alias("chars"))


def block_of(conv: Column, size: int = 100) -> Column:
    """The first conversation of the block of `size` that a conversation lies in."""
    return conv - conv % size


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations whose first h turns come from the first of their block of 100, h = crc32(id) % 6.

    A block has at most 199 conversations (-99 to 99), so its window is bounded; of its first, five turns are kept.
    """
    head = F.max(F.when(F.col("conv_id") == F.col("block"), F.struct(F.substring("key", 1, 5 * 2 * WIDTH).alias("key"), F.slice("chars", 1, 5).alias("chars")))).over(Window.partitionBy("block"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    rows = convs.withColumns({"head": head, "h": h})
    key = F.concat(F.coalesce(F.expr(f"substring(head.key, 1, h * {2 * WIDTH})"), F.lit("")), F.expr(f"substring(key, h * {2 * WIDTH} + 1)"))
    chars = F.concat(F.coalesce(F.expr("slice(head.chars, 1, h)"), F.expr("CAST(array() AS ARRAY<INT>)")), F.expr("slice(chars, h + 1, greatest(size(chars), 1))"))
    return rows.select("conv_id", key.alias("key"), chars.alias("chars"))


def _aligned(tree: Tree, convs: Sequence[int], keys: Sequence[bytes], chars: Sequence[Sequence[int]], owner: Sequence[int]) -> dict[str, list]:
    """The nodes of a tree at the ends of turns, parents before children, with what lies below them summed.

    `owner` has the place among the distinct `keys` of each conversation.
    """
    parent, depth, sample, of_key = [-1], [0], [0], [-1] * len(keys)
    stack: list[tuple[Node, int, int]] = [(tree.root, 0, 0)]
    while stack:
        node, begin, row = stack.pop()
        end = begin + len(node.path)
        for d in range(begin // WIDTH + 1, end // WIDTH + 1):  # a compressed path may pass the ends of several turns
            parent.append(row)
            depth.append(d)
            sample.append(-1)
            row = len(parent) - 1
        if node.value is not None:
            of_key[node.value] = row
        stack += [(below, end, row) for _, below in node.items()]
    n, low = [0] * len(parent), [None] * len(parent)
    for c, k in zip(convs, owner):
        row = of_key[k]
        n[row] += 1
        low[row] = c if low[row] is None else min(c, low[row])
        sample[row] = k
    for row in range(len(parent) - 1, 0, -1):
        up = parent[row]
        n[up] += n[row]
        low[up] = low[row] if low[up] is None else min(low[row], low[up])
        sample[up] = sample[row] if sample[up] < 0 else sample[up]
    last = [0] + [chars[k][d - 1] for k, d in zip(sample[1:], depth[1:])]
    return {"parent": parent, "depth": depth, "n": n, "low": low, "chars": last, "of_key": of_key}


def _prefixes(key: bytes) -> list[bytes]:
    """The digests of a key's first 0, 1, 2, ... ids."""
    h, out = hashlib.sha256(), []
    for at in range(0, len(key) + 1, WIDTH):
        out.append(h.digest())
        h.update(key[at : at + WIDTH])
    return out


def nodes_of(number: int, convs: Sequence[int], keys: Sequence[bytes], chars: Sequence[Sequence[int]]) -> dict[str, list]:
    """The rows (PART) of one tree over conversations in the order of (key, id)."""
    tree, distinct, lengths, owner = Tree(), [], [], []
    for key, sizes in zip(keys, chars):
        at = tree.insert(key, len(distinct))
        if at == len(distinct):
            distinct.append(key)
            lengths.append(sizes)
        owner.append(at)
    found = _aligned(tree, convs, distinct, lengths, owner)
    parent, depth, n, last = found["parent"], found["depth"], found["n"], found["chars"]
    side: dict[int, int] = {}
    till: dict[int, int] = {}
    for path, key in ((0, owner[0]), (1, owner[-1])):
        row = found["of_key"][key]
        while row >= 0:
            side.setdefault(row, path)
            till[row] = path
            row = parent[row]
    names = {0: _prefixes(distinct[owner[0]]), 1: _prefixes(distinct[owner[-1]])}
    children, leaves, saved = ([0] * len(parent) for _ in range(3))
    for row in range(len(parent) - 1, 0, -1):
        if row not in side:
            children[parent[row]] += 1
            leaves[row] += children[row] == 0
            saved[row] += (n[row] - 1) * last[row]
        leaves[parent[row]] += leaves[row]
        saved[parent[row]] += saved[row]
    ends: dict[int, list[str]] = {}
    for c, k in zip(convs, owner):
        ends.setdefault(found["of_key"][k], []).append(str(c))
    rows = range(len(parent))
    name = lambda row, d: names[side[row]][d] if row in side and d >= 0 else None
    closed_end = lambda row: hashlib.sha256(",".join(ends.get(row, ())).encode()).hexdigest()
    return {
        "tree": [number] * len(parent),
        "open": [r in side for r in rows],
        "side": [side.get(r) for r in rows],
        "till": [till.get(r) for r in rows],
        "depth": depth,
        "prefix": [name(r, depth[r]) for r in rows],
        "above": [name(r, depth[r] - 1) for r in rows],
        "conv_id": found["low"],
        "parent_conv_id": [found["low"][p] if p >= 0 and p not in side else None for p in parent],
        "parent_side": [side.get(p) for p in parent],
        "n_convs": n,
        "n_children": children,
        "n_leaves": leaves,
        "saved_tokens": saved,
        "chars": last,
        "ends": [(",".join(ends[r]) if r in ends else None) if r in side else closed_end(r) for r in rows],
    }


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in PART.fields])


def grown(convs: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """The nodes (PART) of trees over ranges of (key, conv_id)."""
    dealt = convs.select(F.unhex("key").alias("key"), "conv_id", "chars").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, keys, chars, held = [], [], [], 0
        for batch in batches:
            for key, conv, sizes in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if ids and (len(ids) == rows or held + len(key) > size):
                    yield pa.RecordBatch.from_pydict(nodes_of(number, ids, keys, chars), _schema())
                    ids, keys, chars, held, number = [], [], [], 0, number + 1
                ids.append(conv)
                keys.append(key)
                chars.append(sizes)
                held += len(key)
        if ids:
            yield pa.RecordBatch.from_pydict(nodes_of(number, ids, keys, chars), _schema())

    return dealt.mapInArrow(grow, PART)


def running(rows: DataFrame, order: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """`rows` with `<weight>_before`: the sum of each weight over rows that come before, by ranges and their totals."""
    parts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "trie-order")
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = parts.groupBy("_part").agg(*(F.sum(w).alias(w) for w in weights))
    base = totals.select("_part", *(F.coalesce(F.sum(w).over(ranges), F.lit(0)).alias(f"_{w}") for w in weights))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumns({f"{w}_before": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    own = own.join(base, "_part")
    return own.withColumns({f"{w}_before": F.col(f"{w}_before") + F.col(f"_{w}") for w in weights}).drop("_part", "_at", *(f"_{w}" for w in weights))


def _ended(pieces: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of open nodes: their lists of ids, in the order of trees, run through one hash as a stream."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for prefix, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if prefix != name:
                    if name is not None:
                        done.append((name, h.hexdigest()))
                    name, h = prefix, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["prefix", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["prefix", "ends_sha256"])

    rows = pieces.filter("ends IS NOT NULL").select("prefix", "tree", "ends").repartition("prefix").sortWithinPartitions("prefix", "tree")
    return rows.mapInArrow(digests, "prefix binary, ends_sha256 string")


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(convs: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """One row (NODE) per distinct beginning of the conversations (conv_id, key, chars), the empty one included.

    No conversations give no rows. Conversations without turns are members of the root only. A conversation may be a beginning of
    others, any number may be alike.
    """
    parts = written(grown(written(convs, "trie-keys"), rows, size), "trie-parts")
    opened = parts.filter("open")
    merged = opened.groupBy("prefix").agg(
        F.max("depth").alias("depth"), F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.max("chars").alias("chars"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.min(F.struct("tree", "side")).alias("first"), F.max(F.struct("tree", "till")).alias("last"),
    )
    merged = written(merged, "trie-open")
    below = merged.filter("above IS NOT NULL").groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("opened"))
    known = merged.join(below, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("opened", F.lit(0)))
    known = known.withColumns({"saves": (F.col("n_convs") - 1) * F.col("chars"), "leaf": (F.col("n_children") == 0).cast("long")})
    # a walk meets open nodes by (path, depth); the end of a path is a row of its own, deeper than any node
    met = known.select(F.col("first.tree").alias("tree"), F.col("first.side").alias("side"), "depth", "prefix", "saves", "leaf")
    paths = opened.select("tree").distinct().select("tree", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    met = met.unionByName(paths.withColumns({"depth": F.lit(2**31 - 1), "prefix": F.lit(None).cast("binary"), "saves": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")}))
    totals = written(running(met, ("tree", "side", "depth"), ("saves", "leaf")), "trie-totals")
    begun = totals.filter("prefix IS NOT NULL").select("prefix", F.col("saves_before").alias("saves0"), F.col("leaf_before").alias("leaf0"))
    ended = totals.filter("prefix IS NULL").select(F.struct("tree", F.col("side").alias("till")).alias("last"), F.col("saves_before").alias("saves1"), F.col("leaf_before").alias("leaf1"))
    known = known.join(begun, "prefix").join(ended, "last")
    names = merged.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    known = known.join(names, "above", "left").join(_ended(opened), "prefix", "left")
    wide = known.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf1") - F.col("leaf0")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saves1") - F.col("saves0")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    # a whole node below an open one: its parent is found by its place on the tree's path, so that no parent is a hot key
    whole = parts.filter("NOT open").withColumn("ends_sha256", F.col("ends"))
    inner = whole.filter("parent_side IS NULL").select(*NODE)
    place = opened.join(merged.select("prefix", F.col("conv_id").alias("_top")), "prefix").select("tree", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "_top")
    outer = whole.filter("parent_side IS NOT NULL").drop("parent_conv_id").join(place, ["tree", "parent_side", "depth"]).withColumnRenamed("_top", "parent_conv_id").select(*NODE)
    every = inner.unionByName(outer).withColumn("depth", F.col("depth").cast("long"))
    return every.unionByName(wide)
