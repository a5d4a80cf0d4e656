"""The pipeline's stages against brute force, and its odd inputs."""
from collections import Counter

import corpus_pipeline
import pytest

from swaplens.llm import packing, toxicity
from swaplens.llm.common import written
from tests.llm.conftest import SCHEMA
from tests.llm.test_duplicates import brute_groups, brute_leaks, brute_lines
from tests.llm.test_findings import toxic_rows


@pytest.fixture(scope="module")
def folder(spark, odd_rows, passage, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, labels = toxic_rows(120, seed=2)
    rows = rows + [(1000 + i if i is not None else None, *x) for i, *x in odd_rows[:14] + odd_rows[15:]]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'en' AS lang", "_key AS source", "cast(length AS long) AS n_chars")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y, _ in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage.split()[:30])), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    rows = docs.collect()

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = written(stages["toxicity"](spark, docs, folder), "t")
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    assert bad and Counter(kept.collect()) == Counter(r for r in rows if r.doc_id not in bad)

    cut = written(stages["line_dedup"](spark, kept, folder), "l")
    rows = kept.collect()
    want = brute_lines([tuple(r) for r in rows], 50)
    assert Counter((r.doc_id, r.text or "", r.n_chars or 0) for r in cut.collect()) == Counter((r.doc_id, t := want[r.doc_id, r.text or ""], len(t)) for r in rows)

    one = written(stages["near_dedup"](spark, cut, folder), "o")
    rows = cut.collect()
    _, names, group = brute_groups([tuple(r) for r in rows])
    assert one.count() == len(set(group)) and {r.doc_id for r in one.collect()} == set(names)

    clean = written(stages["decontamination"](spark, one, folder), "c")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert Counter(clean.collect()) == Counter(r for r in one.collect() if not brute_leaks(r.text, items, 10)[4])
    assert kept.columns == cut.columns == one.columns == clean.columns == columns

    packed = stages["packing"](spark, clean, folder)
    whole = packing.pack(clean, corpus_pipeline.vocabulary("word_bpe_49k.json"))
    digest = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert digest(packed) == digest(whole) and packed.count() == clean.count()
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_no_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    from swaplens.llm.queries import ORACLES, QUERIES

    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in QUERIES) != 1] == []
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_decontamination"])
def test_query_matches_sql(spark, name):
    import duckdb

    from swaplens.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert Counter(map(tuple, got[cols].values.tolist())) == Counter(map(tuple, want[cols].values.tolist()))
