"""Repeated runs of lines, by a suffix array over sequences of line ids that is built by distributed prefix doubling.

A line that occurs once ends every repeated run, so only repeated lines are sorted. Rank level k orders the positions by
their first 2**k lines: the pairs of ranks (i, i + 2**k) of one level are counted, pairs that occur once are dropped
(nothing longer repeats there), and the rest are sorted by range and numbered to give the next level. Suffixes that
share a prefix of n lines are an interval of the array with that longest common prefix; two ranks of level floor(log2 n),
one for each end of the prefix, name it.

A run counts if it has `min_words` words. Every line of a repeated run lies in a window of the run that is as short as the
limit allows and starts, or ends, at one of its lines, so the intervals of such windows, at most two for each line, reveal
the same lines as all intervals do. All is DataFrame operations; no text and no group of copies is ever collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swaplens.llm.common import numbered, written

WORD = r"[^ \t\x0B\f\r]+"


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(_id, _key, _text): rows equal in id and text share their key and are one document."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), text)))
    return docs.select(docs[id_col].alias("_id"), key.alias("_key"), text.alias("_text"), *more)


def repeated_lines(keyed: DataFrame) -> DataFrame:
    """(_id, _key, line, words, rank) of the lines that occur more than once; `rank` orders them by their digest."""
    lines = keyed.select("_id", "_key", F.posexplode(F.split("_text", "\n")).alias("line", "content")).select(
        "_id", "_key", "line", F.unhex(F.md5("content")).alias("digest"), F.regexp_count("content", F.lit(WORD)).cast("long").alias("words")
    )
    lines = written(lines, "lines")
    often = lines.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    ranks = numbered(often, [F.col("digest")], "ranks").select("digest", F.col("before").alias("rank"))
    return written(lines.join(ranks, "digest").drop("digest").dropDuplicates(["_key", "line"]), "repeated")


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(_id, _key, start, size): the shortest windows of at least `min_words` words from, and up to, each line."""
    by_doc = Window.partitionBy("_key").orderBy("line")
    run = Window.partitionBy("_key", "run")
    upto = lines.withColumn("run", F.col("line") - F.row_number().over(by_doc))
    upto = upto.withColumn("till", F.sum("words").over(run.orderBy("line"))).withColumn("from", F.col("till") - F.col("words"))
    upto = upto.withColumn("last", F.max("line").over(run)).withColumn("first", F.min("line").over(run)).withColumn("all", F.max("till").over(run))
    # the first line that starts min_words or more after this one; growing frames keep both in linear time
    beyond = F.min("line").over(run.orderBy(F.col("from").desc()).rangeBetween(Window.unboundedPreceding, -min_words))
    before = F.max("line").over(run.orderBy("till").rangeBetween(Window.unboundedPreceding, -min_words))
    found = upto.withColumn("beyond", beyond).withColumn("before", before)
    end = F.coalesce(F.col("beyond") - 1, F.when(F.col("all") - F.col("from") >= min_words, F.col("last")))
    start = F.coalesce(F.col("before") + 1, F.when(F.col("till") >= min_words, F.col("first")))
    ahead = found.select("_id", "_key", F.col("line").alias("start"), end.alias("end"))
    back = found.select("_id", "_key", start.alias("start"), F.col("line").alias("end"))
    both = ahead.union(back).filter("start IS NOT NULL AND end >= start").distinct()
    return both.select("_id", "_key", "start", (F.col("end") - F.col("start") + 1).cast("long").alias("size"))


def later_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """(_key, start, size) of the windows that occur at an earlier place too: smaller id (null last), then key, then line."""
    every = written(windows(lines, min_words).withColumn("level", F.floor(F.log2(F.col("size") + F.lit(0.5))).cast("int")), "windows")
    place = F.struct(F.col("_id").isNull(), "_id", "_key", "start")
    ranks, found, level = lines.select("_key", "line", "rank"), [], 0
    deepest = every.agg(F.max("level")).first()[0]
    while deepest is not None and level <= deepest:
        reach = 1 << level
        mine = every.filter(F.col("level") == level).withColumn("line", F.col("start"))
        mine = mine.join(ranks.withColumnRenamed("rank", "head"), ["_key", "line"]).withColumn("line", (F.col("start") + F.col("size") - reach).cast("int"))
        mine = mine.join(ranks.withColumnRenamed("rank", "tail"), ["_key", "line"])
        mine = written(mine.select("_id", "_key", "start", "size", "head", "tail"), "named")
        interval = mine.groupBy("size", "head", "tail").agg(F.min(place).alias("original"), F.count("*").alias("n")).filter("n > 1")
        found.append(mine.join(interval, ["size", "head", "tail"]).filter(place != F.col("original")).select("_key", "start", "size"))
        if level < deepest:
            ranks = doubled(ranks, reach)
        level += 1
    return written(reduce(DataFrame.union, found), "copies") if found else every.select("_key", "start", "size")


def doubled(ranks: DataFrame, reach: int) -> DataFrame:
    """Ranks of the positions by twice as many lines; those whose lines do not repeat are left out."""
    ahead = Window.partitionBy("_key").orderBy("line").rangeBetween(reach, reach)
    pairs = written(ranks.withColumn("next", F.max("rank").over(ahead)).filter("next IS NOT NULL"), "pairs")
    often = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1").select("rank", "next")
    order = numbered(often, [F.col("rank"), F.col("next")], "ranks").withColumnRenamed("before", "order")
    return written(pairs.join(order, ["rank", "next"]).select("_key", "line", F.col("order").alias("rank")), "doubled")


def cuts(copies: DataFrame) -> DataFrame:
    """(_key, cuts): the lines that copies cover as sorted intervals (start, end exclusive) that do not touch."""
    by_doc = Window.partitionBy("_key").orderBy("start", "size")
    reached = F.max(F.col("start") + F.col("size")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    grouped = copies.withColumn("fresh", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    grouped = grouped.withColumn("part", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    parts = grouped.groupBy("_key", "part").agg(F.min("start").cast("int").alias("start"), F.max(F.col("start") + F.col("size")).cast("int").alias("end"))
    return parts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))  # at most a document's lines


def without(text: Column, cut: Column) -> Column:
    """`text` without the lines in `cut`; one pass over its lines."""
    lines = F.split(text, "\n")
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(cut, j - 1)["end"])
    end = lambda j: F.coalesce(F.get(cut, j)["start"], F.size(lines))
    kept = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda j: F.slice(lines, begin(j) + 1, end(j) - begin(j)))
    return F.when(cut.isNull(), text).otherwise(F.array_join(F.flatten(kept), "\n"))


def _joined(docs: DataFrame, min_words: int, id_col: str, text_col: str, *more: Column) -> DataFrame:
    found = cuts(later_copies(repeated_lines(_keyed(docs, id_col, text_col)), min_words))
    return _keyed(docs, id_col, text_col, *more).join(found, "_key", "left")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, text without later copies of repeated runs of lines, n_lines (before), n_removed.

    A run is one or more whole lines, in the same order and of `min_words` words together (between ASCII white space), and
    a copy is later if the run occurs in a document of smaller id (null ids last) or further up in the same. The first
    occurrence stays. A null text is empty: one line without words. Rows equal in id and text are one document, with the same
    result; rows equal in id alone are ordered by a digest of their text. No rows give no rows, very long texts are cut
    in one pass, further columns are not read. A text of which all lines are copies becomes empty.
    """
    found = _joined(docs, min_words, id_col, text_col)
    removed = F.coalesce(F.aggregate("cuts", F.lit(0), lambda n, c: n + c["end"] - c["start"]), F.lit(0)).cast("long")
    return found.select(F.col("_id").alias(id_col), without(F.col("_text"), F.col("cuts")).alias("text"), F.size(F.split("_text", "\n")).cast("long").alias("n_lines"), removed.alias("n_removed"))


def deduplicated(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with later copies of repeated runs of lines cut from its text; rows without a copy stay as they are."""
    columns = docs.columns
    found = _joined(docs, min_words, id_col, text_col, F.struct(*(docs[c] for c in columns)).alias("_row"))
    text = F.when(F.col("cuts").isNull(), F.col("_row").getField(text_col)).otherwise(without(F.col("_text"), F.col("cuts")))
    return found.select(*((text if c == text_col else F.col("_row").getField(c)).alias(c) for c in columns))
