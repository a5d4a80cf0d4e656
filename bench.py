"""Headline timings as one JSON line; data from $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from swaplens.functions.columns import FOLD_KEYS  # noqa: E402
from swaplens.functions.indicators import with_features  # noqa: E402
from swaplens.operators import cleaning, inference, signals, valuation  # noqa: E402
from swaplens.operators.folds import chunk  # noqa: E402
from swaplens.operators.walkforward import Strategy, walk_forward  # noqa: E402
from swaplens.operators.decisions import ModelRegistry  # noqa: E402
from swaplens.operators.models import SMALL_BUDGET  # noqa: E402
from swaplens.plans.analysis import analyze  # noqa: E402
from swaplens.plans.study import STRATEGIES, Freeze, Market, StudyConfig, run_study, study_pools  # noqa: E402
from swaplens.session import cut_lineage, local_session  # noqa: E402
from swaplens.sources import derived  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def cold_study(bars) -> dict:
    """A whole small study, once and cold: model fits of all main and transfer variants, their trades, the analysis.

    One documented strategy, one freeze, three markets, the small model budget of the ablations.
    """
    markets = [Market(r["market"], 5.0) for r in bars.select("market").distinct().orderBy("market").limit(3).collect()]
    cfg = StudyConfig(markets=markets, freezes=[Freeze("F", "1997-07-01", "2100-01-01")], ablations=(), settings=(),
                      strategies={"jma_trend": STRATEGIES["jma_trend"]}, model_params=SMALL_BUDGET, min_days=60)
    start = time.perf_counter()
    registry = ModelRegistry(study_pools(bars, cfg), workers=4)
    trades, skipped = run_study(bars, cfg, registry)
    trades = cut_lineage(trades)
    traded = time.perf_counter()
    for table in analyze(trades, bars, cfg).values():
        drain(table)
    end = time.perf_counter()
    n = trades.count()
    return {"seconds": round(end - start, 3), "analysis_seconds": round(end - traded, 3), "fits": len(registry.entries), "trades": n,
            "skipped": skipped.count(), "trades_per_sec_with_fits": round(n / (traded - start), 1)}


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=max(8, int(CPUS)) if CPUS.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    bars = cut_lineage(derived.bars(spark, SF_DIR))
    # 24 parameter combinations per variant, the largest grid of the documented strategies.
    control = Strategy(exit="trailing", exit_grid={"sl_mult": [1.5, 2.0], "trail_mult": [2.0, 3.0]}, fee_bps=5.0, fill="close")
    plans = {"baseline": control, "rule_adx": control.with_(gate=signals.adx_gate())}
    done = {}

    def trades():
        done["trades"] = cut_lineage(walk_forward(bars, plans, 5, 3))

    def value():
        daily = valuation.daily_values(done["trades"], bars, 5.0)
        done["pf"] = cut_lineage(valuation.equal_weight(valuation.portfolio_sums(daily, ["variant", "market"])))

    def bootstrap():
        v, b = (done["pf"].where(F.col("variant") == n).drop("variant") for n in ("rule_adx", "baseline"))
        drain(inference.block_bootstrap(inference.paired_series(v, b, ["market"], ["ret"]), ["market"], reps=2000))

    raw = bars.withColumns({"adjclose": F.col("close"), "ordinal": F.lit(0)})
    steps = {
        "bars": lambda: drain(derived.bars(spark, SF_DIR)),
        "clean": lambda: drain(cleaning.clean(raw, cleaning.CleaningRules(min_rows=100))),
        "features": lambda: drain(with_features(chunk(bars), FOLD_KEYS)),
        "walk_forward": trades, "mark_to_market": value, "block_bootstrap": bootstrap,
    }
    times = {}
    for name, step in steps.items():
        step()  # warm the JVM, the code cache and the Python workers
        t = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - t, 3)
    n_bars, n_trades = bars.count(), done["trades"].count()
    study = cold_study(bars)  # beside the sum of the steps, which stays comparable between rounds
    print(json.dumps({"metric": "study_pipeline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")), "bars": n_bars, "trades": n_trades,
                      "trades_per_sec_walk_forward": round(n_trades / times["walk_forward"], 1), "study": study}))
    spark.stop()


if __name__ == "__main__":
    main()
