"""A sample of registered queries against DuckDB on the small tables."""
import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SF

SAMPLE = ["c7_clean_bars", "c9_cross_validate", "i18_features_per_fold", "l4_bracket", "x10_walk_forward", "m10_combined_decisions",
          "a9_portfolio_metrics", "n14_regime_labels", "r1_run_matrix"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = con.execute(contract.oracle_sql()[name]).fetchdf()
    got = contract.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want) > 0

    def rows(df):
        text = lambda v: "" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)[:10]
        return sorted(tuple(text(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)


def test_flagship_entry(spark):
    assert contract.entry(spark).count() > 0


def test_names_have_no_orphans():
    assert set(contract.oracle_sql()) <= set(contract.queries())
