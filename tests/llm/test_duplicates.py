"""Line runs, SimHash groups and benchmark passages, against brute force."""
import hashlib
import random
from collections import Counter, defaultdict

import xxhash

from swaplens.llm import common, decontamination, line_dedup, simhash
from tests.llm.conftest import SCHEMA, prose


def brute_lines(rows, least):
    """(id, text) -> text without later copies: every run is compared with everything before it."""
    docs = sorted({(i is None, i or 0, hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).digest(), t or "") for i, t, *_ in rows})
    split = [[line for line in d[3].split("\n")] for d in docs]
    words = [[len([w for w in __import__("re").findall(r"[^ \t\x0b\f\r]+", line)]) for line in d] for d in split]
    gone = defaultdict(set)
    seen = set()
    for d, lines in enumerate(split):
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(words[d][s:e]) >= least:
                    run = tuple(lines[s:e])
                    if run in seen:
                        gone[d].update(range(s, e))
                    seen.add(run)
    return {(None if n else i, t): "\n".join(x for k, x in enumerate(split[d]) if k not in gone[d]) if gone[d] else t for d, (n, i, _, t) in enumerate(docs)}


def line_rows(seed):
    r = random.Random(seed)
    pool = [f"line {k} " + " ".join("w" for _ in range(r.randint(0, 4))) for k in range(6)] + ["", "x"]
    return [(k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9))), 0, 0, "", 0.0) for k in range(12)]


def test_line_runs(spark, odd, odd_rows, empty):
    for rows, least in ((odd_rows[:14] + odd_rows[15:], 50), (line_rows(1), 5), (line_rows(2), 9), (line_rows(3), 1)):
        want = brute_lines(rows, least)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = line_dedup.dedup_lines(df, least).collect()
        assert len(got) == len(rows)
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], want[r[0], r[1] or ""]) for r in rows)
        for r in got:
            assert r.n_removed == 0 or r.n_lines >= r.n_removed
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_runs_keep_rows_as_they_are(spark, odd, odd_rows, passage):
    got = line_dedup.deduplicated(odd).collect()
    assert got[0].__fields__ == odd.columns and len(got) == len(odd_rows)
    assert sum(passage in (r.text or "") for r in got) == 1
    assert [r.text for r in got if r.doc_id == 11] == [None]


def test_native_line_runs(spark, odd):
    plan = line_dedup.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow"))


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    prints = [brute_fingerprint(t or "") for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    names = {g: min((r[0] for r, x in zip(rows, group) if x == g and r[0] is not None), default=None) for g in set(group)}
    return prints, [names[g] for g in group], group


def near_rows():
    base = prose(5, 400).split()
    rows = []
    for k in range(25):
        r = random.Random(k)
        words = list(base)
        for _ in range(k // 3):
            words[r.randrange(len(words))] = f"new{r.randrange(99)}"
        rows.append((k, " ".join(words), 0, 0, "", 0.0))
    return rows


def test_near_duplicates(spark, odd_rows, empty):
    rows = odd_rows + [(100 + r[0], *r[1:]) for r in near_rows()]
    prints, names, group = brute_groups(rows)
    assert len(set(group)) < len(rows) - 8
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = simhash.near_duplicates(df).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], f"{p:016x}", n) for r, p, n in zip(rows, prints, names))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(group))
    assert {r.doc_id for r in kept.collect()} == {n for n in names}


def test_links_reach_all_that_pairs_reach(spark):
    r = random.Random(0)
    prints = [0]
    for _ in range(60):
        p = r.choice(prints)
        for _ in range(r.choice((1, 2, 5))):
            p ^= 1 << r.randrange(64)
        prints.append(p)
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    root = {r.node: r.root for r in common.components(simhash.links(spark.createDataFrame(rows, "fp long")), "links").collect()}
    for (a,) in rows:
        for (b,) in rows:
            if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2:
                assert root.get(a, a) == root.get(b, b)
    assert all(root[n] <= n for n in root)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(30)] + [(200, 200)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{101 + k: 100 for k in range(30)}}


def brute_words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(text, items, window):
    words = brute_words(text)
    hit, found = set(), set()
    for item, t in items:
        own = brute_words(t)
        size = min(window, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1 if size else 0):
            if tuple(words[k : k + size]) in grams:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_leaks(spark, odd, odd_rows, empty, passage, monkeypatch):
    items = [(1, passage), (2, prose(20, 40)), (3, "the"), (4, ""), (5, None), (6, "same id here"), (10, "漢字 ́ LL"), (2, prose(21, 15)), (7, prose(20, 40))]
    bench = spark.createDataFrame([(*i, "x") for i in items + [(None, "of and")]], "item_id long, text string, score string")
    for window in (10, 4):
        want = Counter((i, *brute_leaks(t, items, window)) for i, t, *_ in odd_rows)
        got = decontamination.contamination(odd, bench, window)
        assert Counter(tuple(r)[:6] for r in got.collect()) == want
        monkeypatch.setattr(decontamination, "SHARD", 50)
        assert Counter(tuple(r)[:6] for r in got.collect()) == want
        monkeypatch.setattr(decontamination, "BLOCK", 60)
        assert Counter(tuple(r)[:6] for r in decontamination.contamination(odd, bench, window).collect()) == want
        monkeypatch.undo()
    rows = decontamination.contamination(odd, bench.filter("item_id = 1"), 10).collect()
    assert {r.doc_id: r.longest for r in rows if r.contaminated} == {3: 60, 7: 60}
    kept = decontamination.clean(odd, bench.filter("item_id = 1"), 10)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 2
    assert decontamination.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(odd, bench.limit(0)).collect())


def test_suffix_arrays():
    import numpy as np

    r = random.Random(4)
    for _ in range(30):
        s = np.array([r.randint(0, 3) for _ in range(r.randint(1, 60))] + [0])
        ends = np.flatnonzero(s == 0)
        left = ends[np.searchsorted(ends, np.arange(len(s)))] - np.arange(len(s))
        runs = [tuple(s[k : k + left[k]]) for k in range(len(s))]
        assert [runs[k] for k in decontamination.suffix_array(s, left)] == sorted(runs)


def test_tables_between_steps_can_be_removed(spark):
    path = common.new_folder(spark, "test")
    spark.range(3).write.parquet(path)
    assert path.startswith(common.run_folder(spark)) and spark.read.parquet(path).count() == 3
    common.release(spark)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
