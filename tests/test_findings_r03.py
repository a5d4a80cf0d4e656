"""Small checks behind the findings of round 3."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from swaplens.catalog.trade_queries import DON, SMA, exit_by_score
from swaplens.operators import scan, states, valuation
from swaplens.operators.walkforward import walk_forward


def folds(lengths, seed=3):
    """Packed folds of random closes with two signals."""
    rng = np.random.default_rng(seed)
    rows = [[{"close": float(c), "atr": 1.0, "date": t, "sig": rng.integers(-1, 2, 2).tolist(), "up": None, "down": None, "size": None}
             for t, c in enumerate(100 + rng.normal(0, 2, n).cumsum())] for n in lengths]
    kind = pa.struct([("close", pa.float64()), ("atr", pa.float64()), ("date", pa.int32()), ("sig", pa.list_(pa.int32())),
                      *((c, pa.list_(pa.float64())) for c in ("up", "down", "size"))])
    return pa.array(rows, pa.list_(kind))


def events(packed, distinct, shift=0):
    e = states.scan(states.Bars(packed), distinct)
    return sorted(zip((e.fold + shift).tolist(), e.machine.tolist(), e.entry.tolist(), e.exit.tolist(), e.exit_price.tolist(), e.reason.tolist()))


def test_folds_of_different_lengths_share_a_pass():
    """a block steps through instruments of any length together; each closes at its own end."""
    packed = folds([40, 7, 23])
    distinct = [(s, scan.trailing(1.5, 2.0), None) for s in (0, 1)]
    together = events(packed, distinct)
    alone = sorted(x for k in range(3) for x in events(packed[k : k + 1], distinct, k))
    assert together == alone and len(together) > 6
    assert {(f, leave) for f, _, _, leave, _, r in together if r == 3} <= {(0, 39), (1, 6), (2, 22)}


def test_totals_are_the_sums_of_daily_values(spark, bars):
    """sums per date made where the bars are, without a row per instrument and day."""
    plans = {"control": DON, "exit": exit_by_score(DON), "sma": SMA.with_(sizer=F.lit(0.5))}
    trades = walk_forward(bars, plans, 5, 2)
    want = valuation.portfolio_sums(valuation.daily_values(trades, bars, 5.0), ["variant", "market"]).toPandas()
    got = valuation.portfolio_totals(trades, bars, 5.0).toPandas()
    on = ["variant", "market", "date"]
    want, got = (x.sort_values(on).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got) > 100 and (want[on] == got[on]).all().all() and (want.n == got.n).all()
    for c in ("gross", "cost", "ret", "turnover", "exposure"):
        assert np.allclose(want[c], got[c], atol=1e-12)


def test_workers_keep_few_words():
    """pipeline: caches that stay in a worker are small; a word that was forgotten scores as before."""
    from swaplens.llm import packing, toxicity, vocabularies

    known = {b"good": -1.0, b"\0abcd": 2.0}
    scores = toxicity.Scores(known)
    words = [f"w{k}".encode() for k in range(toxicity.CACHED + 10)]
    first = [scores[w] for w in (b"good", b"abcdefgh", b"other")]
    largest = 0
    for w in words:
        scores[w]
        largest = max(largest, len(scores))
    assert largest <= toxicity.CACHED <= 100_000 and [scores[w] for w in (b"good", b"abcdefgh", b"other")] == first
    assert packing.CACHED < vocabularies.CACHED
