"""Secrets, toxicity, main texts and neighbours: brute force, held-out accuracy, measured recall."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swaplens.llm import html_text, neighbours, secrets, toxicity
from tests.llm.conftest import SCHEMA, prose

SF = "/root/testdata/sf0.01"


def brute_secrets(text):
    kinds = {
        "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)",
    }
    least = {"assign": 8, "access": 16, "hex": 32}
    found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if len(m[m.lastindex]) >= least[kind]]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def secret_rows(odd_rows):
    r = random.Random(1)
    rows = list(odd_rows)
    for k in range(60):
        value = "".join(r.choices("0123456789abcdef", k=40))
        rows.append((1000 + k, f'{prose(k, 9)} é token = "{value}" ſecret=abcdefghij toKen=short token=secret=abcdefgh1 {"".join(r.choices("etaoinshr", k=18))} {prose(k, 4)}', 0, 0, "", 0.0))
    rows.append((2000, "note " + "".join(r.choices("0123456789abcdef", k=31)) + " plainwordsthatarelongenough", 0, 0, "", 0.0))
    rows.append((2001, "AKIAAKIA short AKIA" + "Z" * 12 + "a PASSWD:'x.y/z_0=-' api-key=12345678", 0, 0, "", 0.0))
    return rows


def test_secrets(spark, odd_rows, empty):
    rows = secret_rows(odd_rows)
    found = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = secrets.digest(found).collect()
    want = Counter()
    for i, t, *_ in rows:
        spans = brute_secrets(t)
        n = Counter(s.split(":")[0] for s in spans)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for i, t, *_ in rows:
        assert any(r.doc_id == i and [s for s in r.spans.split(",") if s and not s.startswith("inferred")] == brute_secrets(t) for r in got)
    inferred = {r.doc_id: re.findall(r"inferred:(\d+):(\d+)", r.spans) for r in got if "inferred" in r.spans}
    assert inferred == {2000: [("5", "36")]}
    assert secrets.digest(secrets.find_secrets(empty)).count() == 0


def pairs(tokens):
    return Counter(a + b for t in tokens for a, b in zip("\n" + t, t + "\n"))


def test_what_findings_leave_of_tokens():
    text = "leftover/token=abcdefgh1 x 0123456789abcdef0123456789abcdef-restOfIt shorter plainword"
    base, rest = secrets.scan(text)
    assert [(k, text[a:b]) for k, a, b, _ in base] == [("assign", "token=abcdefgh1"), ("hex", "0123456789abcdef0123456789abcdef")]
    assert [v for *_, v in rest] == ["leftover/", "-restOfIt", "plainword"]
    assert all(text[a:b] == v for a, b, v in rest)


def test_background_counts_every_other_token(spark, odd_rows, empty):
    rows = secret_rows(odd_rows)
    got = {r.value: r.n for r in secrets.counted(spark.createDataFrame(rows, SCHEMA).repartition(3)).filter("kind = ''").collect()}
    assert got == pairs([v for _, t, *_ in rows for *_, v in secrets.scan(t or "")[1]])
    assert secrets.counted(empty).count() == 0


def test_few_values_make_a_format(spark):
    """One long value, however often it is repeated, is found where no name stands before it; ordinary words are not."""
    value = "9f3a77c0d1e2b4586a90z8y7x6w5v4u3t2s1r0q9"
    rows = [(k, f"{prose(k, 40)} token={value} understanding government", 0, 0, "", 0.0) for k in range(30)] + [(99, f"some words {value} and elsewhere", 0, 0, "", 0.0)]
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.inferred] for r in secrets.find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{k: [] for k in range(30)}, 99: [(11, 51)]}


def test_automata_tell_formats_apart():
    r = random.Random(2)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(200)]
    words = ["".join(r.choices("etaoinshr", k=r.randint(16, 24))) for _ in range(200)]
    a, b = secrets.Automaton(hexes[:150]).frozen(), secrets.Background(pairs(words[:150]))
    for v in hexes[150:]:
        assert secrets.evidence(a, v, b.chances(v)) > secrets.EVIDENCE
    for v in words[150:]:
        assert secrets.evidence(a, v, b.chances(v)) < -secrets.EVIDENCE
    single = secrets.Automaton(hexes[:1]).frozen()
    assert all(secrets.evidence(single, v, b.chances(v)) < 0 for v in words[150:])
    assert secrets.evidence(single, hexes[0], b.chances(hexes[0])) > secrets.EVIDENCE
    for before in ("\n", "e", "Z"):
        assert sum(b.chance(before, c) for c in secrets.CHARACTERS + "\n") == pytest.approx(1)
    few = secrets.Automaton(["ab", "abab", "ababab"] * 20)
    assert sum(bool(few._seen(k)) for k in range(len(few.next))) >= 2


def brute_segments(scores, cost):
    """Maximal segments by their definition: the best segment, then the same to its left and right."""
    x = np.array(scores) - cost

    def best(lo, hi):
        top = max(((x[a:b].sum(), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if top[0] <= 1e-12:
            return []
        a, b = -top[2], -top[2] - top[1]
        return best(lo, a) + [(a, b, top[0])] + best(b, hi)

    return best(0, len(x))


def test_segments():
    r = random.Random(5)
    for _ in range(60):
        scores = [r.choice([0, 0, 0, 2.3, 5.7, -1.1]) for _ in range(r.randint(0, 25))]
        got = toxicity.segments(np.array(scores, float), 0.9)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in brute_segments(scores, 0.9)))
        assert [g[:2] for g in got] == [b[:2] for b in brute_segments(scores, 0.9)]


def toxic_rows(n, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic = r.random() < 0.2
        words = prose(seed * 1000 + k, r.randint(20, 120)).split(" ")
        for _ in range(len(words) // 15 + 2 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["vilest", "rotters", "scumdom"]))
        rows.append((k, " ".join(words), 0, 0, "", 0.0))
        labels.append((k, int(toxic), 0.0))
    return rows, labels


def test_toxicity(spark, odd_rows, empty):
    rows, labels = toxic_rows(400)
    rows += [(5000 + i if i is not None else None, *x) for i, *x in odd_rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 0.0), (3, None, 0.0), (5, 7, 0.0)], "doc_id long, toxic int, score double")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.doc_id is None or r.doc_id < 5000 or r.predicted == 0
    held_wrong = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 0.0) for i, y, _ in labels], "doc_id long, toxic int, score double")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, held_wrong).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in held)  # held-out labels teach nothing
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.toxicity(empty, known).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, known.limit(0)).collect()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href=/>Home</a></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="ad">Buy this thing now, it is very good and cheap for all.</div>
%s<aside>Side text</aside><form><input value=x>Sign up</form><div id="comments"><p>I do not agree with any of this at all, sorry.</p></div>
<footer>&copy; 2020</footer><script>var t = "<p>no</p>";</script></body></html>"""
BODY = """<h1>A  title &amp; more</h1><p>First <b>bold</b> text<br>goes\n on with enough words to be the article itself.<p>Second one &lt;here&gt; is
also long enough, with <a href=x>a link</a> inside of it.<ul><li>Point one is a short line<li>Point two</ul><p>Be.</p>"""
TEXT = "A title & more\nFirst bold text goes on with enough words to be the article itself.\nSecond one <here> is also long enough, with a link inside of it.\nPoint one is a short line\nPoint two\nBe."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<div><div id=post>%s</div></div>"])
def test_main_text(wrap):
    assert html_text.extract(PAGE % (wrap % BODY)) == TEXT


@pytest.mark.parametrize("wrap", [
    *(f'<div class="{name}">%s</div>' for name in ("content no-sidebar", "with-sidebar", "has-comments", "has-header", "ad-free", "social", "header", "content-sidebar-wrap")),
    *(f'<div class="{name}"><article>%s</article></div>' for name in ("no-sidebar", "social", "comments", "widget")),
    '<div id=social><div class="sidebar">%s</div></div>', '<div role=form>%s</div>', "<form action=/><input value=y><label>Find</label><button>Go</button>%s</form>",
    '<main><div class="comments"><article>%s</article></div></main>',
])
def test_wrappers_named_as_noise_keep_the_article(wrap):
    assert html_text.extract(PAGE % (wrap % BODY)) == TEXT
    assert html_text.extract(f"<html><body>{wrap % BODY}</body></html>") == TEXT  # and with nothing beside it


def test_named_parts_go_however_long():
    noise = "".join(f"<p>I do not agree with number {k} at all, and I say so here at length.</p>" for k in range(50))
    for part in ('<div class="%s">' + noise + "</div>", '<div id="%s"><article>' + noise + "</article></div>"):
        for name in ("comments", "comment-list", "related-posts"):
            assert html_text.extract(PAGE % (f"<div class=content>{BODY}</div>" + part % name)) == TEXT
            assert html_text.extract(PAGE % f"<main>{BODY}{part % name}</main>") == TEXT
    for name in ("cookie-notice", "site-footer", "ad-728x90", "nav-bar", "sidebar1"):
        assert html_text.extract(PAGE % f'<main>{BODY}<div class="{name}"><p>Some words of this.</p></div></main>') == TEXT


@pytest.mark.parametrize("aside", [
    "<blockquote>" + "<p>%s</p>" * 2 + "</blockquote>", "<blockquote>" + "<p>%s</p>" * 6 + "</blockquote>", "<table><tr>" + "<td>%s</td>" * 5 + "</table>", "<ul>" + "<li>%s" * 5 + "</ul>",
    "<b><div>" + "<p>%s</p>" * 40 + "</div></b>",
])
@pytest.mark.parametrize("wrap", ["<div>%s</div>", "%s", "<div><font>%s</font></div>", "<div><div><p>short</p></div>%s</div>"])
def test_text_beside_blocks_is_kept(aside, wrap):
    lines = [f"line {k} " + prose(k, 16) for k in range(30)]
    quotes = [prose(100 + k, 33) for k in range(aside.count("%s"))]
    for page in (aside % tuple(quotes) + "<br>".join(lines), "<br>".join(lines) + aside % tuple(quotes)):
        got = html_text.extract(f"<html><body>{wrap % page}</body></html>")
        assert all(" ".join(x.split()) in got for x in (*lines, *quotes))


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "%s"])
def test_short_blocks_around_a_long_section_are_kept(wrap):
    long = ["".join(f"<p>{prose(20 * j + k, 40)}</p>" for k in range(8)) for j in range(2)]
    page = f"<h1>On it</h1><section><h2>One</h2>{long[0]}</section><h2>Two</h2><section>{long[1]}</section>"
    got = html_text.extract(PAGE % (wrap % page)).split("\n")
    assert [x for x in got if len(x) < 10] == ["On it", "One", "Two"] and len(got) == 19


def test_sums_of_densities_choose_among_articles():
    teasers = "".join(f"<article><h2>Teaser {k}</h2><p>Read more of it.</p></article>" for k in range(6))
    for tag in ("article", "div"):
        got = html_text.extract(f"<html><body><div>{teasers}</div><{tag}>{BODY}</{tag}></body></html>")
        assert TEXT in got and got.endswith(TEXT)


def test_given_pages_need_no_article_tags(spark):
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert pages and all(html_text.extract(p) == html_text.extract(re.sub(r"(?i)(</?)(article|main)\b", r"\1div", p)) for p in pages)


def test_inline_elements_do_not_hide_their_block():
    bold = "<br>".join(f"<b>{prose(k, 20)}</b>" for k in range(10))
    got = html_text.extract(f"<html><body><div><font>{bold}</font></div><p>end</p></body></html>")
    assert all(" ".join(prose(k, 20).split()) in got for k in range(10))


LINKED = [
    "<ol>" + "".join(f"<li><a href={k}>Reference number {k} of the article</a> 20{k}" for k in range(10, 16)) + "</ol>",
    "<table>" + "".join(f"<tr><td><a href={k}>Name of person {k}</a><td>{k}" for k in range(10, 16)) + "</table>",
    "<section>" + "".join(f"<p><a href={k}>Further reading of part {k}</a>" for k in range(10, 16)) + "</section>",
]


@pytest.mark.parametrize("linked", LINKED)
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "%s"])
def test_linked_lists_of_the_article_are_kept(wrap, linked):
    got = html_text.extract(f"<html><body>{wrap % (BODY + linked)}</body></html>")
    lines = [re.sub("<[^>]*>", "", x) for x in re.split("<(?:li|td|p)>", linked)[1:]]
    assert got == "\n".join([TEXT, *lines])


def test_mostly_linked_page_is_kept_and_a_menu_outside_goes():
    page = "".join(f"<p>See <a href={k}>the long story number {k} of this site</a>." for k in range(8))
    assert html_text.extract(f"<html><body><div>{page}</div></body></html>").count("See the long story") == 8
    menu = "<ul>" + "".join(f"<li><a href={k}>{prose(k, 30)}</a>" for k in range(4)) + "</ul>"
    assert html_text.extract(f"<html><body>{menu}<div class=content>{BODY}</div></body></html>") == TEXT


def test_pages(spark):
    pages = [(1, "u", PAGE % f"<article>{BODY}</article>", "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "u", "plain text", "c"), (5, "u", "<article><p>cut of", "c"),
             (6, "u", "<div>" * 2000 + "deep", "c"), (7, "u", "a < b &amp c &#x41; &bogus; <!-- no --> </b></p>", "c"), (1, "u", PAGE % f"<article>{BODY}</article>", "c"), (8, "u", "<article>" + "<p>very long words here</p>" * 3000, "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df).collect()
    texts = {1: TEXT, 2: "", 3: "", None: "plain text", 5: "cut of", 6: "deep", 7: "a < b & c A &bogus;", 8: "\n".join(["very long words here"] * 3000)}
    assert Counter(tuple(r) for r in got) == Counter((i, u, texts[i], len(texts[i])) for i, u, *_ in pages)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract_pages(pages).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b)))).strip() for b in re.split("<(?:/?p|/?h1)>", inside))
        assert r.text == "\n".join(b for b in blocks if b)


def brute_neighbours(rows, every, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = min(sound[i], v) if i in sound else v
    out = {}
    for q, v in sound.items():
        if q % every == 0:
            a = np.array(v, float)
            near = sorted((-float(a @ np.array(w)) / (np.linalg.norm(a) * np.linalg.norm(w)), i) for i, w in sound.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in r.normal(size=16).astype(np.float32)]) for k in range(300)]
    rows[10] = (10, rows[20][1])
    rows += [(301, None), (302, []), (305, [0.0] * 16), (310, [1.0, None] + [0.0] * 14), (315, [float("nan")] * 16), (320, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    rows += [(325, [1.0, 2.0]), (330, [2.0, 1.0]), (335, [3.0]), rows[50], (50, rows[51][1])]
    df = spark.createDataFrame([(*x, 1, 0.5) for x in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(3)
    got = {}
    for x in neighbours.search(df, every=5, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute_neighbours(rows, 5, 4)
    assert got.keys() == {q for q, w in want.items() if w}
    hit = sum(len({i for i, _ in want[q]} & {i for _, i, _ in g}) for q, g in got.items()) / sum(map(len, want.values()))
    assert hit >= 0.97
    for q, g in got.items():
        assert [x[0] for x in g] == list(range(1, len(want[q]) + 1))
        exact = dict((i, s) for i, s in brute_neighbours(rows, 5, 999)[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in g)
        assert [(-s, i) for _, i, s in g] == sorted((-s, i) for _, i, s in g)
    assert neighbours.search(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, list(r.embedding)) for r in df.collect()], 50, 5)
    got = neighbours.search(df).collect()
    hit = sum(any(i == r.vec_id for i, _ in want[r.query_id]) for r in got)
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_near_copies_of_a_labelled_row_have_one_vote(spark):
    """Hundreds of copies with their words shuffled and some replaced teach no more than one of them."""
    r = random.Random(12)
    rows, labels = toxic_rows(500, 3)
    toxic = [t for i, t, *_ in rows if t and dict((a, b) for a, b, _ in labels).get(i) == 1][:3]
    more, marks = [], []
    for k in range(600):
        words = toxic[k % 3].split()
        r.shuffle(words)
        words[0] = f"new{k}"
        more.append((10_000 + k, " ".join(words)))
        marks.append((10_000 + k, 1))
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + more, "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, y, _ in labels] + marks, "doc_id long, toxic int")
    votes = toxicity.one_vote_each(docs.join(known, "doc_id").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("toxic").alias("_toxic")))
    n = {x["_toxic"]: x["count"] for x in votes.groupBy("_toxic").count().collect()}
    assert n[1] <= sum(y == 1 for _, y, _ in labels) + 30  # of 600: a band may meet another text first
    truth = {i: y for i, y, _ in labels}
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(docs, known).collect()}
    clean = [i for i, y in truth.items() if y == 0]
    assert sum(got[i] for i in clean) <= 0.05 * len(clean)
    assert sum(got[i] for i, y in truth.items() if y == 1) >= 0.9 * sum(truth.values())


def test_several_passages_weigh_more_than_the_best_of_them():
    one = toxicity.evidence(1000, [14.0], 1.0, 0.1)
    assert toxicity.evidence(1000, [14.0, 13.0, 12.0], 1.0, 0.1) > one == pytest.approx(14 - np.log(100))
    assert toxicity.evidence(1000, [14.0, 1.0], 1.0, 0.1) == one
    assert toxicity.evidence(1000, [], 1.0, 0.1) == pytest.approx(-np.log(100))
