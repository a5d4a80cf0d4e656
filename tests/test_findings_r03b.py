"""Small checks behind the second part of round 3's findings."""
import gzip

from pyspark.sql import functions as F

from swaplens.catalog.trade_queries import DON, SMA, exit_by_score
from swaplens.operators import models, signals
from swaplens.operators.folds import chunk
from swaplens.operators.walkforward import default_trades, feature_frame, walk_forward
from swaplens.sources import files


def test_files_meet_their_own_header_without_lists(spark, tmp_path):
    """files in folders named by instrument, one with a line before its header, long lists of symbols as a table."""
    for name, text in (("A~1", "Date,Open,High,Low,Close,Volume\n2020-01-01,1,3,0.5,2,10\n2020-01-02,2,3,1,2.5,\n2020-01-01,1,3,0.5,9,11\n"),
                       ("B 2", '"close", "date",extra\n4,2020-01-01,x\n'), ("C", "made by hand\ndate,close\n2020-01-01,7\n"), ("D", "a,b\n1,2\n")):
        (tmp_path / f"key={name}").mkdir()
        (tmp_path / f"key={name}" / "part-0.csv").write_text(text)
    (tmp_path / "key=E").mkdir()
    (tmp_path / "key=E" / "part-0.csv.gz").write_bytes(gzip.compress(b"Close,Date\n5,2020-01-03\n"))
    got = files.read_bars(spark, str(tmp_path), "m", name=files.in_folder("key"))
    want = {("A~1", "2020-01-01", 1.0, 9.0, 11.0), ("A~1", "2020-01-02", 2.0, 2.5, None), ("B 2", "2020-01-01", None, 4.0, None),
            ("C", "2020-01-01", None, 7.0, None), ("E", "2020-01-03", None, 5.0, None)}
    rows = lambda df: {(r.symbol, str(r.date), r.open, r.close, r.volume) for r in df.collect()}
    assert rows(got) == want
    few = spark.createDataFrame([("E",), ("B 2",), ("E",), ("none",)], "symbol string")
    assert rows(files.read_bars(spark, str(tmp_path), "m", few, files.in_folder("key"))) == {w for w in want if w[0] in ("E", "B 2")}
    many = spark.range(30_000).selectExpr("concat('S', id) AS symbol").unionByName(spark.createDataFrame([("C",)], "symbol string"))
    assert {w[0] for w in rows(files.read_bars(spark, str(tmp_path), "m", many, files.in_folder("key")))} == {"C"}


def test_recursive_features_only_where_they_are_read(spark, bars):
    """the filters' Python stage is no part of a plan that reads none of them, and trades stay the same."""
    plans = {"control": DON, "exit": exit_by_score(SMA.with_(gate=signals.adx_gate())), "lag": DON.with_(lag=1)}
    got = walk_forward(bars, plans, 5, 2)
    want = walk_forward(bars, plans, 5, 2, feature_frame(chunk(bars, 5), list(plans.values())))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan(want) and "ArrowEvalPython" not in plan(got)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(got) == rows(want) and got.count() > 100
    gated = DON.with_(gate=F.col("rsi") > 40)  # a column that only a filter gives
    assert "ArrowEvalPython" in plan(walk_forward(bars, {"rsi": gated}, 5, 2)) and walk_forward(bars, {"rsi": gated}, 5, 2).count() > 0
    assert "ArrowEvalPython" not in plan(default_trades(bars, DON))


def test_boosting_tasks_do_not_grow_with_the_rows_alone():
    """as many partitions as cores, fewer for few rows, more only where one would be too large."""
    assert [models.boosting_partitions(n, 12) for n in (1, 50_001, 1_900_000, 6_000_000, 19_000_000)] == [1, 2, 12, 12, 38]
