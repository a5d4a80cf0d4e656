"""Periodic runs against a search of all periods, and the registered query against its SQL."""
import random

import duckdb
import pytest

import __spark_entry__ as contract
from swaplens.llm import periodic_runs as P


def brute(words, least, copies):
    found, n = [], len(words)
    for q in range(1, n // copies + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                stretch = words[start : i + q]
                if len(stretch) >= max(least, copies * q) and all(stretch[p:] != stretch[:-p] for p in range(1, q)):
                    found.append((start, len(stretch), q))
                start = None
    return sorted(found)


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least, copies", [(24, 3), (6, 3), (4, 2)])
def test_runs_equal_brute_force(least, copies):
    r = random.Random(least)
    texts = []
    for _ in range(400):
        words = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 110))]
        for _ in range(r.randint(0, 2)):
            a, p = r.randrange(len(words) + 1), r.randint(1, 12)
            for i in range(a, min(len(words), a + r.randint(10, 90))):
                words[i] = words[a + (i - a) % p]
        texts.append([w.encode() for w in words])
    for words, found in zip(texts, P._search(texts, least, copies)):
        assert found == brute(words, least, copies)
        assert P._collapsed(words, found) == collapsed([w.decode() for w in words], found)


def test_rows(spark, odd, odd_rows, empty):
    got = sorted(((r[0], [tuple(x) for x in r[1]], r[2]) for r in P.periodic_runs(odd).collect()), key=str)
    words = lambda t: (t or "").encode().split()
    want = sorted(((i, brute(words(t), 24, 3) if len(words(t)) < 500 else [], collapsed([w.decode() for w in words(t)], brute(words(t), 24, 3) if len(words(t)) < 500 else [])) for i, t, *_ in odd_rows), key=str)
    assert got == want
    assert P.periodic_runs(empty).count() == 0


def test_a_very_long_text_is_searched_whole(spark):
    line = " ".join(f"w{k}" for k in range(50))
    text = " ".join(["start", *["x"] * 30_000, "middle", *[line] * 200, "end of it"])
    (row,) = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 30_000, 1), (30_002, 10_000, 50)]
    assert row.collapsed == f"start x middle {line} end of it"  # no ASCII white space in the last word


def test_parameters_are_checked(empty):
    with pytest.raises(ValueError):
        P.periodic_runs(empty, copies=1)


def test_query_equals_sql(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.randint(0, 200)))) for k in range(150)] + [(7, None), (None, "a " * 40), (12, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = contract.queries()["op12_periodic_runs"](spark, str(tmp_path))
    want = con.execute(contract.oracle_sql()["op12_periodic_runs"]).fetchdf()
    key = lambda rows: sorted((tuple(None if v != v else v for v in r) for r in rows), key=str)
    assert key(map(tuple, got.select(*want.columns).collect())) == key(want.astype(object).where(want.notna(), None).values.tolist())
