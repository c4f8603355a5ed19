"""Retrieval queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import neighbours as N
from ..operators import retrieve as R
from ..registry import only, query, table
from .standins import CHUNKS_SQL, FILES_SQL, QUERIES_SQL, chunks, files, queries

_COS = "round(list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[]))), 6)"
_STOP = ", ".join(f"'{w}'" for w in R.STOP)
_TERMS = f"list_filter(regexp_extract_all(lower(text), '{R.TERM}'), lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t))"


@query("dense_topk", f"""
WITH q AS (SELECT embedding AS b, label FROM embeddings WHERE vec_id = 0)
SELECT vec_id, {_COS.replace('a::', 'e.embedding::').replace('b::', 'q.b::')} AS score FROM embeddings e, q WHERE e.label = q.label ORDER BY score DESC, vec_id LIMIT 10
""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    embedding, label = only(e.where("vec_id = 0"), "embedding", "label")
    return R.dense_search(e, embedding or [0.0], 10, e.where(F.col("label") == label) if embedding else e.limit(0))


@query("dense_topk_batch", f"""
WITH s AS (SELECT q.vec_id AS q, e.vec_id, {_COS.replace('a::', 'e.embedding::').replace('b::', 'q.embedding::')} AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT q, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""")
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.dense_search_batch(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding"), 10)


@query("approximate_recall", """WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) SELECT count(*) AS queries, CAST(count(*) * least(10, (SELECT count(*) - 1 FROM embeddings)) AS BIGINT) AS wanted, true AS enough FROM q""")
def approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of exact answers that the neighbour graphs find, over queries that tuned nothing: nine tenths or more."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")
    found = N.recall(N.search(N.build(e), q, 10), R.dense_search_batch(e, q, 10))
    return found.agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("enough"))


_BM25_SQL = f"""
{QUERIES_SQL}, a AS (SELECT DISTINCT q, unnest({_TERMS}) AS term FROM queries),
c AS (SELECT doc_id, {_TERMS} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM c), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM a) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT q, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * dl / avgdl))), 6) AS score
  FROM a JOIN tf USING (term) JOIN df USING (term), st GROUP BY q, doc_id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 100)"""


@query("bm25_topk", f"WITH {_BM25_SQL} SELECT q, doc_id, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), queries(spark, sf_dir), 100)


_TRI_SQL = f"""{QUERIES_SQL}, a3 AS (SELECT DISTINCT q, unnest({_TERMS}) AS term FROM queries), t3 AS (SELECT DISTINCT term, substr(term, 1, 3) AS g FROM a3),
c3 AS (SELECT doc_id, lower(text) AS text, greatest(length(lower(text)) - 2, 0) AS dl FROM documents), st3 AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM c3),
p3 AS (SELECT doc_id, dl, unnest(range(1, dl + 1)) AS i, text FROM c3), g3 AS (SELECT doc_id, dl, i, text, substr(text, i, 3) AS g FROM p3),
tf3 AS (SELECT term, doc_id, dl, count(*) AS tf FROM g3 JOIN t3 USING (g) WHERE substr(text, i, length(term)) = term GROUP BY ALL), df3 AS (SELECT term, count(*) AS df FROM tf3 GROUP BY term),
s3 AS (SELECT q, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * dl / avgdl))), 6) AS score
  FROM a3 JOIN tf3 USING (term) JOIN df3 USING (term), st3 GROUP BY q, doc_id),
tri AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s3) WHERE rank <= 20)"""


@query("trigram_topk", f"WITH {_TRI_SQL} SELECT q, doc_id, score, rank FROM tri")
def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), queries(spark, sf_dir), 20, substrings=True)


@query("random_ranker", f"""WITH {QUERIES_SQL}, p AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY md5(concat_ws(':', '0', q, doc_id))) AS rank FROM queries, documents)
SELECT q, doc_id, rank FROM p WHERE rank <= 20""")
def random_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.random_ranker(table(spark, sf_dir, "documents"), queries(spark, sf_dir), 20)


@query("grep_literal", f"""WITH {CHUNKS_SQL}, h AS (SELECT *, instr(lower(code), 'licensed under') AS pos FROM chunks WHERE status = 'active')
SELECT path, start_line, end_line, start_line + length(substr(code, 1, pos - 1)) - length(replace(substr(code, 1, pos - 1), chr(10), '')) AS match_line,
  trim(string_split(code, chr(10))[1 + length(substr(code, 1, pos - 1)) - length(replace(substr(code, 1, pos - 1), chr(10), ''))], ' ') AS excerpt FROM h WHERE pos > 0""")
def grep_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grep(chunks(spark, sf_dir), "Licensed UNDER")


@query("grep_miss_counts", f"""WITH {CHUNKS_SQL}, l AS (SELECT *, contains(lower(code), 'mit license') AS hit, programming_language IN ('fr', 'de') AS scope FROM chunks WHERE status = 'active')
SELECT count(*) FILTER (hit AND scope) AS total, count(*) FILTER (hit AND NOT scope) AS out_of_scope, count(*) FILTER (scope) AS searched_chunks, count(DISTINCT path) FILTER (scope) AS searched_files FROM l""")
def grep_miss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grep_counts(chunks(spark, sf_dir), "MIT License", F.col("programming_language").isin("fr", "de"))


_LEGS_SQL = f"""{_BM25_SQL}, {_TRI_SQL.replace(QUERIES_SQL + ', ', '')},
runs AS (SELECT 'bm25' AS leg, q, doc_id, score, rank FROM bm25 UNION ALL SELECT 'trigram', q, doc_id, score, rank FROM tri)"""


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_legs(table(spark, sf_dir, "documents"), queries(spark, sf_dir), {"bm25": (100, False), "trigram": (20, True)})


@query("fusion_rrf", f"""WITH {_LEGS_SQL}, f AS (SELECT q, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM runs GROUP BY q, doc_id)
SELECT q, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 50""")
def fusion_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_legs(spark, sf_dir), "rrf", top_k=50)


_NORMS = {
    "min-max": "CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END",
    "zmuv": "CASE WHEN sd > 0 THEN (score - av) / sd ELSE 0 END",
    "sum": "CASE WHEN hi > lo THEN (score - lo) / (sm - n * lo) ELSE 0 END",
    "max": "score / hi",
    "rank": "1 - (rank - 1) / n",
    "borda": "(n - rank + 1) / n",
}
_STATS_SQL = "st2 AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS av, stddev_pop(score) OVER w AS sd, sum(score) OVER w AS sm, count(*) OVER w AS n FROM runs WINDOW w AS (PARTITION BY leg, q))"


@query("norms", f"WITH {_LEGS_SQL}, {_STATS_SQL} SELECT leg, q, doc_id, " + ", ".join(f'round(({v})::DOUBLE, 6) AS "{k.replace("-", "_")}_norm"' for k, v in _NORMS.items()) + " FROM st2")
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _legs(spark, sf_dir)
    return runs.select("leg", "q", "doc_id", *[F.round(R.normalised(runs, k), 6).alias(f"{k.replace('-', '_')}_norm") for k in _NORMS])


def _fusion(method: str, value: str) -> None:
    sql = f"""WITH {_LEGS_SQL}, {_STATS_SQL}, v AS (SELECT q, doc_id, {_NORMS['min-max']} AS norm, CASE leg WHEN 'bm25' THEN 0.7 ELSE 0.3 END::DOUBLE AS w FROM st2),
f AS (SELECT q, doc_id, round({value}, 6) AS score FROM v GROUP BY q, doc_id)
SELECT q, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 50"""

    @query(f"fusion_{method}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.fuse(_legs(spark, sf_dir), method, {"bm25": 0.7, "trigram": 0.3}, "min-max", 50)


for _method, _value in (("wsum", "sum(w * norm)"), ("sum", "sum(norm)"), ("mnz", "sum(norm) * count(*)"), ("max", "max(norm)"), ("wmnz", "sum(w * norm) * count(*)")):
    _fusion(_method, _value)


@query("rerank_depth", f"""WITH {_BM25_SQL}, d AS (SELECT q, b.doc_id, rank, rank <= 20 AS head, CASE WHEN rank <= 20 THEN -length(text) END AS fresh FROM bm25 b JOIN documents USING (doc_id))
SELECT q, doc_id, rank, row_number() OVER (PARTITION BY q ORDER BY head DESC, fresh DESC NULLS LAST, rank) AS new_rank FROM d""")
def rerank_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return R.rerank(bm25_topk(spark, sf_dir).join(d, "doc_id"), 20, -F.col("n")).select("q", "doc_id", "rank", "new_rank")


@query("weight_grid", """WITH s AS (SELECT unnest(range(5)) AS a), t AS (SELECT unnest(range(5)) AS b), w AS (SELECT a / 4 AS w1, b / 4 AS w2, (4 - a - b) / 4 AS w3 FROM s, t WHERE a + b <= 4)
SELECT l_returnflag, w1, w2, w3, round(avg(w1 * l_quantity / 50 + w2 * l_discount + w3 * l_tax), 6) AS score FROM lineitem, w GROUP BY ALL""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean fused score of each group of rows under every weighting of three scores."""
    legs = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(F.col("l_quantity") / 50).alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"))
    grid = F.array(*[F.struct(*[F.lit(x).alias(f"w{i}") for i, x in enumerate(w, 1)]) for w in R.weight_grid(3, 0.25)])
    each = legs.select("*", F.explode(grid).alias("w")).select("*", "w.*")
    return each.select("l_returnflag", "w1", "w2", "w3", F.round(F.col("w1") * F.col("a") + F.col("w2") * F.col("b") + F.col("w3") * F.col("c"), 6).alias("score"))


_SYMBOLS_SQL = "symbols AS (SELECT concat('p/', p_size % 5, '/', p_brand, '.rs') AS path, split_part(p_name, ' ', 1) AS name, p_type AS kind, p_partkey AS start_line FROM part)"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), F.col("p_size") % 5, F.lit("/"), "p_brand", F.lit(".rs")).alias("path"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("start_line"))


@query("symbol_rank_files", f"""WITH {_SYMBOLS_SQL}, a AS (SELECT s_suppkey AS q, unnest([split_part(p.p_name, ' ', 1), split_part(p2.p_name, ' ', 1)]) AS name FROM supplier JOIN part p ON p.p_partkey = s_suppkey + 1 JOIN part p2 ON p2.p_partkey = s_suppkey * 3 + 1),
a2 AS (SELECT DISTINCT q, name FROM a), h AS (SELECT q, path, count(DISTINCT name) AS idents, count(*) AS definitions FROM a2 JOIN symbols USING (name) GROUP BY q, path)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY idents DESC, definitions DESC, path) AS rank FROM h) WHERE rank <= 100""")
def symbol_rank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")), table(spark, sf_dir, "supplier")
    one = s.join(p, F.col("p_partkey") == F.col("s_suppkey") + 1)
    asked = one.select(F.col("s_suppkey").alias("q"), "name", F.lit(1).alias("k"))
    two = s.join(p, F.col("p_partkey") == F.col("s_suppkey") * 3 + 1).select(F.col("s_suppkey").alias("q"), "name", F.lit(2).alias("k"))
    both = asked.join(two.select("q"), "q", "left_semi").unionByName(two.join(asked.select("q"), "q", "left_semi"))
    return R.rank_files_by_symbols(both.select("q", "name").distinct(), _symbols(spark, sf_dir))


@query("rank_symbols_anchor", f"""WITH {_SYMBOLS_SQL}, n AS (SELECT name FROM symbols WHERE start_line = 1), a AS (SELECT path FROM symbols WHERE start_line = 1),
t AS (SELECT s.path, start_line, CASE WHEN s.path = a.path THEN 0 WHEN regexp_extract(s.path, '^(.*)/[^/]*$', 1) = regexp_extract(a.path, '^(.*)/[^/]*$', 1) THEN 1 ELSE 2 END AS tier, count(*) OVER () AS total
  FROM symbols s JOIN n ON n.name = s.name, a)
SELECT path, start_line, tier, total FROM t ORDER BY tier, path, start_line LIMIT 20""")
def rank_symbols_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    name, path = only(s.where("start_line = 1"), "name", "path")
    return R.lookup_symbols(s, name or "", path or "", 20)


@query("nearest_container", """WITH s AS (SELECT l_orderkey AS path, l_linenumber AS name, l_returnflag AS kind, l_partkey % 50 AS "start", l_partkey % 50 + l_suppkey % 40 + 1 AS "end" FROM lineitem),
s2 AS (SELECT path, min(name) AS name, min(kind) AS kind, "start", "end" FROM s GROUP BY path, "start", "end"),
j AS (SELECT i.*, o.name AS pn, o.kind AS pk, row_number() OVER (PARTITION BY i.path, i.name, i."start", i."end" ORDER BY o."start" DESC, o."end", o.name) AS k FROM s2 i LEFT JOIN s2 o
  ON i.path = o.path AND o."start" <= i."start" AND o."end" >= i."end" AND (o."start" < i."start" OR o."end" > i."end"))
SELECT path, name, kind, "start", "end", pn AS parent_name, pk AS parent_kind FROM j WHERE k = 1""")
def nearest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("name"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_suppkey") % 40 + 1).alias("end"))
    return R.nearest_container(s.groupBy("path", "start", "end").agg(F.min("name").alias("name"), F.min("kind").alias("kind")))


@query("selector_filter", f"""WITH {FILES_SQL} SELECT path, programming_language FROM files
WHERE (path GLOB 'src/*/src1/*' OR path GLOB '*/src2/*') AND programming_language IN ('en', 'de') AND NOT (path GLOB '*7.md')""")
def selector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.globs import Selector

    f = files(spark, sf_dir)
    return f.where(Selector(paths=["src/*/src1/*", "*/src2/*"], languages=["en", "de"]).column() & ~Selector(paths=["*7.md"]).column()).select("path", "programming_language")


@query("list_files", f"""WITH {FILES_SQL} SELECT path, total FROM (SELECT path, count(*) OVER () AS total FROM files WHERE path GLOB 'src/en/*') ORDER BY path LIMIT 50""")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.globs import sqlite_glob

    from ..operators.lifecycle import list_paths

    return list_paths(files(spark, sf_dir), F.col("path").rlike(sqlite_glob("src/en/*")), 50)


@query("prefix_overfetch", f"""WITH {_BM25_SQL}, f AS (SELECT q, doc_id, rank FROM bm25 JOIN documents USING (doc_id) WHERE source LIKE 'src1%' AND rank <= 40)
SELECT q, doc_id, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS place FROM f) WHERE place <= 10""")
def prefix_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking is cut at four times the limit first, then filtered, then cut again."""
    d = table(spark, sf_dir, "documents").where(F.col("source").startswith("src1")).select("doc_id")
    hit = bm25_topk(spark, sf_dir).where("rank <= 40").join(d, "doc_id", "left_semi")
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where("place <= 10").select("q", "doc_id", "rank", "place")


@query("search_display_join", f"""WITH {CHUNKS_SQL}, q AS (SELECT embedding AS b FROM embeddings WHERE vec_id = 0),
t AS (SELECT vec_id, {_COS.replace('a::', 'e.embedding::').replace('b::', 'q.b::')} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 20)
SELECT vec_id, score, path, start_line, path IS NULL AS orphaned FROM t LEFT JOIN chunks c ON c.doc_id = t.vec_id AND c.n = 0 AND c.status = 'active'""")
def search_display_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    (embedding,) = only(e.where("vec_id = 0"), "embedding")
    top = R.dense_search(e, embedding or [0.0], 20, None if embedding else e.limit(0))
    shown = chunks(spark, sf_dir).where("n = 0 and status = 'active'").select(F.col("doc_id").alias("vec_id"), "path", "start_line")
    # the winners are top_k rows, so they are the side to broadcast
    hit = shown.join(F.broadcast(top), "vec_id")
    return top.join(hit.drop("score"), "vec_id", "left").select("vec_id", "score", "path", "start_line", F.col("path").isNull().alias("orphaned"))


@query("outline", f"""WITH {_SYMBOLS_SQL}, asked(path) AS (VALUES ('p/0/Brand#11.rs'), ('p/1/Brand#12.rs'), ('p/x/none.rs'))
SELECT a.path, s.name, s.start_line, s.path IS NOT NULL AS indexed, count(s.path) OVER (PARTITION BY a.path) AS total FROM asked a LEFT JOIN symbols s ON a.path = s.path""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("p/0/Brand#11.rs",), ("p/1/Brand#12.rs",), ("p/x/none.rs",)], "path string")
    s = _symbols(spark, sf_dir).withColumn("indexed", F.lit(True))
    total = F.count("indexed").over(Window.partitionBy("path"))
    return asked.join(s, "path", "left").select("path", "name", "start_line", F.coalesce("indexed", F.lit(False)).alias("indexed"), total.alias("total"))
