"""Small checks behind the findings of round 4."""
import threading

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from swaplens.catalog.trade_queries import DON, exit_by_score
from swaplens.functions.indicators import FEATURES
from swaplens.operators import boosting, decisions, models, valuation
from swaplens.operators.walkforward import walk_forward
from swaplens.plans import analysis
from swaplens.plans.study import Freeze, Market, StudyConfig
from swaplens.session import cut_lineage
from swaplens.sources import files


def training(rows=2500, values=20):
    """Rows with few distinct values, for which Spark's candidate splits are those between all of them."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, values, (rows, len(FEATURES))).astype(float) * rng.uniform(0.1, 9, len(FEATURES))
    z = x[:, 0] - x[:, 1] * x[:, 2] / 9 + rng.normal(0, 3, rows)
    return pd.DataFrame(x, columns=list(FEATURES)).assign(label=(z > np.quantile(z, 0.7)).astype(float))


def test_binned_boosting_gives_the_trees_of_spark(spark, monkeypatch):
    """The same probabilities as GBTClassifier, over several partitions, blocks and rebuilt margins."""
    monkeypatch.setattr(boosting, "REBASE", 3)
    monkeypatch.setattr(boosting, "DEALT", 64)
    monkeypatch.setattr(boosting, "BLOCK", 256)
    monkeypatch.setattr(models, "ROWS_PER_PARTITION", 500)
    budget = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 30, "seed": 42}
    df = spark.createDataFrame(training()).repartition(3).cache()
    mine = models.ProbModel(**budget).fit(df)
    weights, n = models.class_weights(df)
    assert n == 2500 and abs(weights[0] * df.where("label = 0").count() - n / 2) < 1e-9
    theirs = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True),
                              GBTClassifier(featuresCol="_std", weightCol="weight", **budget)]).fit(
        df.withColumn("weight", F.when(F.col("label") == 1, weights[1]).otherwise(weights[0])))
    both = mine.score(theirs.transform(df).select(*FEATURES, vector_to_array("probability")[1].alias("q")), "p").toPandas()
    assert both.q.std() > 0.1 and np.abs(both.p - both.q).max() < 1e-9
    assert np.allclose(mine.model.stages[-1].featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray())


def test_candidate_splits_follow_all_rows():
    """Summaries of parts give thresholds near the weighted quantiles of the whole, also where parts differ."""
    rng = np.random.default_rng(2)
    parts = [rng.normal(k, 1 + k, 40_000) for k in range(3)]
    weights = [np.where(p > 1, 2.0, 0.5) for p in parts]
    told = [boosting.summary(v, w) for v, w in zip(parts, weights)]
    assert all(len(v) <= boosting.SUMMARY for v, _ in told)
    got = boosting.candidates(*(np.concatenate(x) for x in zip(*told)))
    every, w = np.concatenate(parts), np.concatenate(weights)
    share = np.array([w[every <= t].sum() for t in got]) / w.sum()
    assert len(got) == boosting.BINS - 1 and np.abs(share - np.arange(1, boosting.BINS) / boosting.BINS).max() < 0.003


def test_left_out_instruments_are_valued_where_their_bars_are(spark, bars):
    """the same changes as from daily values of every instrument and day, of which no row is made."""
    cfg = StudyConfig(markets=[Market(m, 5.0) for m in ("M0", "M1", "M2")], freezes=(Freeze("F1", "1997-07-01", "1999-07-01"), Freeze("F2", "1999-07-01", "2100-01-01")), min_days=20)
    plans = {"baseline|all": DON, "exit|F1": exit_by_score(DON), "exit|F2": exit_by_score(DON, 0.2)}
    made = walk_forward(bars, plans, 5, 2)
    trades = cut_lineage(made.withColumns({"strategy": F.lit("don"), "freeze": F.split_part("variant", F.lit("|"), F.lit(2)), "variant": F.split_part("variant", F.lit("|"), F.lit(1))}))
    cost = analysis.cost_column(cfg)
    p = analysis.portfolios(valuation.portfolio_totals(trades, bars, cost, analysis.TAGS), trades, cfg, False)
    every = analysis.in_freezes(valuation.daily_values(trades, bars, cost, analysis.TAGS), cfg).withColumn("n", F.lit(1))
    got = valuation.left_out(trades, bars, cost, p.sums)
    on = ["strategy", "market", "freeze", "variant", "symbol"]
    want, have = (x.toPandas().sort_values(on).reset_index(drop=True) for x in (analysis.shifts(p, every, "symbol"), got))
    assert len(want) == len(have) > 10 and (want[on] == have[on]).all().all()
    assert np.allclose(want[["d1", "d2"]], have[["d1", "d2"]], atol=1e-12) and want.d1.abs().max() > 1e-3
    plan = analysis.jackknife_instruments(p, trades, bars, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan


def test_files_are_listed_once(spark, tmp_path):
    """One relation of lines gives headers and cells, and folders of instruments are no partitions for the driver to keep."""
    for name, text in (("A", 'Date,Open,Close\n\n2020-01-01,"1",2\n  \n2020-01-02,3,"4"\n'), ("B~2", "close,date\n5,2020-01-01,more\n6\n")):
        (tmp_path / f"key={name}").mkdir()
        (tmp_path / f"key={name}" / "part-0.csv").write_text(text)
    got = files.read_bars(spark, str(tmp_path), "m", name=files.in_folder("key"))
    rows = {(r.symbol, str(r.date), r.open, r.close) for r in got.collect()}
    assert rows == {("A", "2020-01-01", 1.0, 2.0), ("A", "2020-01-02", 3.0, 4.0), ("B~2", "2020-01-01", None, 5.0), ("B~2", "None", None, 6.0)}
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [") == 1 and "key#" not in plan


def test_models_of_a_decision_are_fitted_side_by_side(spark, monkeypatch):
    """the two models of an entry or an exit do not wait for each other."""
    both = threading.Barrier(2)
    monkeypatch.setattr(decisions.ModelRegistry, "made", lambda self, f: both.wait(20) and None or models.ProbModel())
    registry = decisions.ModelRegistry({"all": models.TrainingData(None)}, workers=4)
    monkeypatch.setattr(models.TrainingData, "frame", None)
    decisions.learned_entry().learned(DON, registry, "all", "1999-07-01", DON)
    assert len(registry.entries) == 2
