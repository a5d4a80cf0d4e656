"""The registered queries: each applies one operator, with the parameters of production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.packing import pack

    return pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), size=4096, end_id=1)


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


@query
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.token_files import round_trip

    return round_trip(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), size=3)


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.decontamination import contamination

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op5_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS l FROM (SELECT item_id, {_FOLDED} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d JOIN sizes ON l <= len(w))),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (g, l)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, folder, "documents"), min_words=50)


ORACLES["op1_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, len(regexp_extract_all(ls[i], '[^ \t\x0B\f\r]+')) AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT doc_id, i, sum(w) OVER p AS till, sum(w) OVER p - w AS since FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.till - a.since >= 50 GROUP BY ALL
        UNION
        SELECT a.doc_id, max(b.i) AS s, a.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.till - b.since >= 50 GROUP BY a.doc_id, a.i),
t AS (SELECT win.doc_id, s, e, e - s AS n, md5(array_to_string(ls[s:e], chr(10))) AS g FROM win JOIN d ON win.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY n, g ORDER BY doc_id, s) AS k FROM t),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(s, e + 1)) AS i FROM r WHERE k > 1) GROUP BY doc_id)
SELECT d.doc_id, array_to_string(list_filter(ls, lambda x, i: NOT coalesce(list_contains(g, i), false)), chr(10)) AS text,
       len(ls)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""


@query
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.secrets import digest, find_secrets

    return digest(find_secrets(table(spark, folder, "documents")))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.toxicity import toxicity

    found = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.html_text import extract_pages

    return extract_pages(table(spark, folder, "pages"))


@query
def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.neighbours import search

    return search(table(spark, folder, "embeddings"), every=50, k=5)


@query
def op13_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.bpe import round_trip

    rows = round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose id has a checksum divisible by 10 repeat a stretch of words from a place on, before runs are searched."""
    from swaplens.llm.periodic_runs import periodic_runs

    docs = table(spark, folder, "documents")
    words = docs.withColumns({"w": F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), "h": F.crc32(F.col("doc_id").cast("string"))})
    planted = """CASE WHEN h % 10 = 0 AND size(w) > 0 THEN
        transform(array(named_struct('w', w, 'a', h div 10 % size(w), 'k', 3 + h div 10 % 8)), s ->
            array_join(transform(s.w, (x, i) -> CASE WHEN i < s.a THEN x
                ELSE s.w[CAST(s.a + (i - s.a) % (1 + (size(s.w) - s.a) div s.k) AS INT)] END), ' '))[0]
        ELSE text END"""
    found = periodic_runs(words.select("doc_id", F.expr(planted).alias("text")))
    longest = F.expr("""array_sort(runs, (x, y) -> CASE
        WHEN x.length * y.period <> y.length * x.period THEN CASE WHEN x.length * y.period > y.length * x.period THEN -1 ELSE 1 END
        WHEN x.start <> y.start THEN CASE WHEN x.start < y.start THEN -1 ELSE 1 END
        WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    best = F.get("sorted", F.lit(0))
    return found.withColumn("sorted", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("get(sorted, 0).length * 1000 div get(sorted, 0).period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of the decimal digits `x` in SQL: fixed values are the polynomial and the all-ones mask.
_CRC = """xor(list_reduce(list_transform(string_split({x}, ''), lambda s: ascii(s)::BIGINT),
  lambda c, b: xor(c >> 8, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, xor(c, b) & 255)), 4294967295), 4294967295)"""

ORACLES["op12_periodic_runs"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, coalesce({_CRC.format(x="doc_id::VARCHAR")}, 1) AS h FROM documents),
p AS (SELECT *, (h // 10) % len(o) AS a, 1 + (len(o) - (h // 10) % len(o)) // (3 + (h // 10) % 8) AS q FROM d WHERE len(o) > 0),
w AS (SELECT k, CASE WHEN h % 10 = 0 THEN list_transform(range(len(o)), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % q END]) ELSE o END AS w FROM p),
f AS (SELECT k, i, x FROM (SELECT k, unnest(range(len(w))) AS i, unnest(w) AS x FROM w)),
g AS (SELECT k, 0 AS e, list(hash(x) ORDER BY i) AS g FROM f GROUP BY k
      UNION ALL
      SELECT k, e + 1, list_transform(range(len(g) - (1 << e)), lambda i: hash(g[i + 1], g[i + 1 + (1 << e)])) FROM g WHERE len(g) > 1 << e),
c AS (SELECT k, e, i, q FROM (SELECT k, e, i, lead(i) OVER (PARTITION BY k, e, x ORDER BY i) - i AS q FROM (SELECT k, e, unnest(range(len(g))) AS i, unnest(g) AS x FROM g WHERE e > 0))
      WHERE q >= 1 << (e - 1) AND q < 1 << e),
s AS (SELECT k, min(i) AS start, max(i) + (1 << e) + q - min(i) AS length, q AS period
      FROM (SELECT *, i - row_number() OVER (PARTITION BY k, e, q ORDER BY i) AS island FROM c) GROUP BY k, e, q, island),
r AS (SELECT * FROM s WHERE length >= 24 AND length >= 3 * period),
t AS (SELECT k, count(*) AS n_runs, arg_min(r, (-length::DECIMAL(18, 0) / period, start, period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS y FROM f ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
       (b.length * 1000 // b.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(y, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (k) LEFT JOIN kept USING (k)
"""


@query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    from swaplens.llm.conversation_trie import conversations, rebuilt, trie

    return trie(rebuilt(conversations(table(spark, folder, "conversations"))))


ORACLES["op11_conversation_trie"] = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'s': sha256(len(r) || ':' || r || x), 'n': len(x)}} ORDER BY turn NULLS FIRST, sha256(len(r) || ':' || r || x)) AS o, {_CRC.format(x="c::VARCHAR")} % 6 AS h FROM t GROUP BY c),
b AS (SELECT o.c, list_concat(coalesce(p.o[1:o.h], []), o.o[o.h + 1:]) AS b FROM o LEFT JOIN o p ON p.c = o.c - o.c % 100),
m AS (SELECT c, len(b) AS l, d, sha256(array_to_string([t.s for t in b[1:d]], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string([t.s for t in b[1:d - 1]], ',')) END AS up, CASE WHEN d > 0 THEN b[d].n ELSE 0 END AS n
      FROM (SELECT *, unnest(range(len(b) + 1)) AS d FROM b)),
nodes AS (SELECT k, d, up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saves,
          sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE l = d), '')) AS ends FROM m GROUP BY k, d, up),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
below AS (SELECT DISTINCT a.k, z.k AS j FROM full_nodes f JOIN m z ON z.c = f.conv_id AND z.k = f.k JOIN m a ON a.c = z.c AND a.d <= z.d),
sums AS (SELECT below.k, sum(f.saves) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS leaves FROM below JOIN full_nodes f ON f.k = below.j GROUP BY below.k)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN sums USING (k) LEFT JOIN full_nodes p ON p.k = f.up
"""
