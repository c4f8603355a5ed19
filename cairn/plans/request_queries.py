"""Requests, responses and whole-database figures; documents are files, orders runs or commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests as Q
from ..functions import text as T
from ..operators import lifecycle as L
from ..operators import provenance as P
from ..registry import query, table
from .lifecycle_queries import updates
from .standins import CHUNKS_SQL, FILES_SQL, chunks, files

_BAD = "(path = '' OR starts_with(path, '/') OR contains(path, '//') OR contains(path, '\\') OR list_contains(string_split(path, '/'), '..'))"


@query("request_bounds", r"""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 130 - 5 END AS k, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE repeat('é', (o_orderkey % 60)::INT) END AS q,
  o_orderkey % 40 AS steps, o_orderkey % 9 AS sections, o_orderkey % 700 AS words FROM orders)
SELECT * FROM (SELECT id, CASE WHEN k < 1 OR k > 100 THEN 'top_k_out_of_range' WHEN q = '' THEN 'query_empty' WHEN strlen(q) > 64 THEN 'query_too_long' WHEN steps < 1 OR steps > 30 THEN 'budget_out_of_range'
  WHEN sections < 2 OR sections > 6 THEN 'shape_out_of_range' WHEN words <> 0 AND (words < 100 OR words > 500) THEN 'shape_out_of_range' END AS reason FROM r) WHERE reason IS NOT NULL""")
def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    q = F.when(k % 11 == 0, "").otherwise(F.repeat(F.lit("é"), (k % 60).cast("int")))
    budget = F.struct((k % 40).alias("max_steps"), (k % 9).alias("max_report_sections"), (k % 700).alias("max_report_words"))
    r = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 != 0, k % 130 - 5).alias("k"), q.alias("q"), budget.alias("b"))
    caps, floors = {"max_steps": 30, "max_report_sections": 6, "max_report_words": 500}, {"max_report_sections": 2, "max_report_words": 100}
    return Q.rejects(r, "id", Q.first_of(Q.top_k(F.col("k"), 100), Q.query(F.col("q"), 64), Q.budget(F.col("b"), caps, floors)))


@query("request_ids", """WITH r AS (SELECT l_orderkey AS id, list((l_partkey % 7)::VARCHAR ORDER BY l_linenumber, l_partkey % 7) AS ids FROM lineitem GROUP BY 1), u AS (SELECT id, unnest(ids) AS x, generate_subscripts(ids, 1) AS k FROM r),
f AS (SELECT id, x, min(k) AS k FROM u GROUP BY ALL) SELECT id, list(x ORDER BY k) AS used, CASE WHEN count(*) > 4 THEN 'context_too_many' END AS context, CASE WHEN count(*) > 5 THEN 'delete_too_many' END AS gone FROM f GROUP BY id""")
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 7).cast("string").alias("x")))), lambda s: s["x"])
    r = li.groupBy(F.col("l_orderkey").alias("id")).agg(ids.alias("ids"))
    return r.select("id", Q.distinct_ids(F.col("ids")).alias("used"), Q.context_ids(F.col("ids"), 4).alias("context"), Q.delete_ids(F.col("ids"), 5).alias("gone"))


@query("request_selectors", """WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 6 END AS paths, s_nationkey % 5 AS languages, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 90 END AS lim, s_suppkey % 2 = 0 AS a, s_suppkey % 5 = 0 AS b,
  CASE WHEN s_suppkey % 7 > 0 THEN 1 END AS keep_last, CASE WHEN s_suppkey % 5 > 0 THEN 1 END AS older_than FROM supplier)
SELECT id, CASE WHEN coalesce(paths, 0) + languages > 7 THEN 'selector_too_large' END AS large, CASE WHEN coalesce(paths, 0) + languages = 0 THEN 'selector_empty' END AS none,
 CASE WHEN lim < 1 OR lim > 50 THEN 'symbol_limit_out_of_range' END AS symbol, CASE WHEN lim < 1 OR lim > 60 THEN 'list_limit_out_of_range' END AS page, CASE WHEN a AND b THEN 'index_modes_exclusive' END AS modes, CASE WHEN keep_last IS NULL AND older_than IS NULL THEN 'history_bound_missing' END AS prune FROM r""")
def request_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    some = lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), lambda x: x.cast("string"))
    paths, languages = F.when(k % 4 > 0, some(k % 6)), some(F.col("s_nationkey") % 5)
    limit = F.when(k % 3 > 0, k % 90)
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), Q.selector(paths, languages, 7).alias("large"), Q.some_selector(Q.entries(paths, languages)).alias("none"), Q.symbol(F.col("s_name"), limit, 64, 50).alias("symbol"),
        Q.list_limit(limit, 60).alias("page"), Q.index_modes(k % 2 == 0, k % 5 == 0).alias("modes"), Q.history_prune(F.when(k % 7 > 0, 1), F.when(k % 5 > 0, 1)).alias("prune"),
    )


@query("request_bodies", f"""WITH {FILES_SQL}, b AS (SELECT doc_id % 50 AS request, CASE WHEN doc_id % 90 = 7 THEN replace(path, 'src/', 'src/../') WHEN doc_id % 95 = 9 THEN '/' || path ELSE path END AS path, CASE WHEN doc_id % 97 = 11 THEN left(sha256, 63) WHEN doc_id % 97 = 12 THEN replace(sha256, left(sha256, 1), 'g') ELSE sha256 END AS sha FROM files),
c AS (SELECT request, CASE WHEN {_BAD} THEN 'path_invalid' WHEN NOT regexp_full_match(sha, '[0-9a-fA-F]{{64}}') THEN 'sha256_invalid' END AS why FROM b),
g AS (SELECT request, CASE WHEN count(*) > 20 AND request % 3 = 0 THEN 'too_many_files' ELSE min(why) END AS reason FROM c GROUP BY request) SELECT request, reason FROM g WHERE reason IS NOT NULL""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift bodies of many files: requests of every third number may have twenty files, the others any number."""
    d = F.col("doc_id")
    path = F.when(d % 90 == 7, F.replace("path", F.lit("src/"), F.lit("src/../"))).when(d % 95 == 9, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))
    sha = F.when(d % 97 == 11, F.left("sha256", F.lit(63))).when(d % 97 == 12, F.replace("sha256", F.left("sha256", F.lit(1)), F.lit("g"))).otherwise(F.col("sha256"))
    b = files(spark, sf_dir).select((d % 50).alias("request"), path.alias("path"), sha.alias("sha"))
    check = Q.first_of(Q.path(F.col("path")), Q.sha256(F.col("sha")))
    few = Q.rejected_requests(b.where("request % 3 = 0"), "request", check, 20)
    return few.unionByName(Q.rejected_requests(b.where("request % 3 <> 0"), "request", check, 10**9))


@query("request_sizes", f"""WITH {FILES_SQL}, b AS (SELECT f.doc_id % 50 AS request, CASE WHEN strlen(text) > 40000 THEN 'code_too_large' END AS why FROM files f JOIN documents USING (doc_id)) SELECT request, CASE WHEN count(*) > 1000 THEN 'too_many_files' ELSE min(why) END AS reason FROM b GROUP BY request HAVING count(*) > 1000 OR min(why) IS NOT NULL
UNION ALL SELECT 1000 + o_custkey, 'too_many_commits' FROM orders GROUP BY o_custkey HAVING count(*) > 12""")
def request_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bodies with a file of too much code, history bodies of too many commits."""
    b = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("request"), "text")
    c = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1000).alias("request"), F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("sha"))
    return Q.rejected_requests(b, "request", Q.code(F.col("text"), 40000), 1000).unionByName(Q.rejected_requests(c, "request", Q.git_sha(F.col("sha")), 12, "too_many_commits"))


@query("shape_faults", f"""WITH {FILES_SQL}, {CHUNKS_SQL}, f AS (SELECT path, CASE WHEN doc_id % 8 = 3 THEN left(sha256, 63) || 'g' WHEN doc_id % 8 = 5 THEN left(sha256, 60) ELSE sha256 END AS sha, CASE WHEN doc_id % 10 = 1 THEN -1 ELSE retry_count END AS retries FROM files),
c AS (SELECT path, code, CASE WHEN n % 5 = 4 THEN -1 ELSE start_line END AS a, CASE WHEN n % 7 = 5 THEN 0 ELSE end_line END AS b FROM chunks)
SELECT path, reason, count(*) AS n FROM (SELECT path, CASE WHEN NOT regexp_full_match(sha, '[0-9a-fA-F]{{64}}') THEN 'sha256_invalid' WHEN retries < 0 THEN 'retry_count_negative' END AS reason FROM f
UNION ALL SELECT path, CASE WHEN code = '' OR a < 0 OR a > b THEN 'span_invalid' END FROM c) WHERE reason IS NOT NULL GROUP BY ALL""")
def shape_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no index may hold, whatever wrote them."""
    f, d, n = files(spark, sf_dir), F.col("doc_id"), F.col("n")
    sha = F.when(d % 8 == 3, F.concat(F.left("sha256", F.lit(63)), F.lit("g"))).when(d % 8 == 5, F.left("sha256", F.lit(60))).otherwise(F.col("sha256"))
    of_files = Q.rejects(f, "path", Q.file_shape(sha, F.when(d % 10 == 1, -1).otherwise(F.col("retry_count"))))
    start, end = F.when(n % 5 == 4, -1).otherwise(F.col("start_line")), F.when(n % 7 == 5, 0).otherwise(F.col("end_line"))
    of_chunks = Q.rejects(chunks(spark, sf_dir), "path", Q.chunk_shape(F.col("code"), start, end, F.lit(0), F.lit(0)))
    return of_files.unionByName(of_chunks).groupBy("path", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("request_commits", """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'xyz' WHEN o_orderkey % 2 = 0 THEN sha256(o_orderkey::VARCHAR) ELSE left(sha256(o_orderkey::VARCHAR), 40) END AS sha,
  CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS subject, CASE o_orderkey % 4 WHEN 0 THEN 'modified' WHEN 1 THEN 'renamed' WHEN 2 THEN 'copied' ELSE 'deleted' END AS change, CASE WHEN o_orderkey % 3 = 0 THEN 'a/b' WHEN o_orderkey % 13 = 0 THEN '../x' END AS old FROM orders)
SELECT * FROM (SELECT id, CASE WHEN NOT regexp_full_match(sha, '[0-9a-fA-F]{40}|[0-9a-fA-F]{64}') THEN 'commit_invalid' WHEN trim(subject) = '' THEN 'subject_empty' WHEN strlen(subject) > 10 THEN 'message_too_large'
 WHEN change IN ('renamed', 'copied') AND old IS NULL THEN 'old_path_missing' WHEN change NOT IN ('renamed', 'copied') AND old IS NOT NULL THEN 'old_path_unexpected' WHEN change IN ('renamed', 'copied') AND old = '../x' THEN 'path_invalid' END AS reason FROM c) WHERE reason IS NOT NULL""")
def request_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    long = F.sha2(k.cast("string").cast("binary"), 256)
    sha = F.when(k % 10 == 0, "xyz").when(k % 2 == 0, long).otherwise(F.left(long, F.lit(40)))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("modified", "renamed", "copied", "deleted")]), (k % 4 + 1).cast("int"))
    paths = F.array(F.struct(F.lit("a/c").alias("path"), kind.alias("change_type"), F.when(k % 3 == 0, "a/b").when(k % 13 == 0, "../x").alias("old_path")))
    subject = F.when(k % 9 == 0, " ").otherwise(F.col("o_orderpriority"))
    return Q.rejects(table(spark, sf_dir, "orders").select(k.alias("id"), sha.alias("sha"), subject.alias("subject"), paths.alias("paths")), "id", Q.commit(F.col("sha"), F.col("subject"), F.lit(""), F.col("paths"), 10))


@query("global_counts", f"""WITH {FILES_SQL} SELECT 'projects' AS name, count(DISTINCT project_guid) AS n FROM files UNION ALL SELECT 'status_log', count(*) FROM events UNION ALL SELECT 'runs', count(*) FROM orders
UNION ALL SELECT 'pinned_runs', count(*) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'stale_runs', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.lit(1)).alias("expires_at"), (F.col("o_orderstatus") == "F").alias("stale"))
    return L.global_counts(files(spark, sf_dir), updates(spark, sf_dir), runs)


@query("runtime_status", f"WITH {FILES_SQL}, b AS (SELECT status, count(*) AS n FROM files GROUP BY 1), m AS (SELECT sum(n) FILTER (status = 'indexing') AS indexing, list(status || '=' || n ORDER BY status) AS files FROM b) SELECT (SELECT count(*) FROM supplier) AS claims, coalesce(indexing, 0)::BIGINT AS indexing, array_to_string(files, ',') AS files FROM m")
def runtime_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.runtime_status(files(spark, sf_dir), table(spark, sf_dir, "supplier"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("files")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.withColumn("files", told)


@query("active_runs", "SELECT o_orderkey AS id, 2000000000 - floor(epoch(o_orderdate))::BIGINT AS age_s FROM orders WHERE o_orderstatus = 'P'")
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return L.active_runs(o.select(F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "P", 1).alias("ended_at")), 2000000000)


_RESPONSE = "r AS (SELECT doc_id % 30 AS request, programming_language, path, count(*) FILTER (n % 2 = 1) AS n FROM chunks GROUP BY ALL)"


@query("response_map", f"WITH {CHUNKS_SQL}, {_RESPONSE} SELECT request, programming_language, path, n FROM r")
def response_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested maps, flattened again so that they compare."""
    m = _responses(spark, sf_dir).select("request", F.explode("files").alias("programming_language", "p"))
    return m.select("request", "programming_language", F.explode("p").alias("path", "n"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.response_map(chunks(spark, sf_dir).select((F.col("doc_id") % 30).alias("request"), "programming_language", "path", F.when(F.col("n") % 2 == 1, F.col("n")).alias("chunk")), "request")


@query("response_tally", f"WITH {CHUNKS_SQL}, {_RESPONSE} SELECT request, sum(n)::BIGINT AS chunks, count(*) FILTER (n = 0) AS too_short FROM r GROUP BY request")
def response_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tally(_responses(spark, sf_dir), "request")


@query("confirm_writes", f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND status = 'indexing' THEN 'indexed' ELSE status END AS status, CASE WHEN doc_id % 4 < 2 AND status = 'indexing' THEN 0 ELSE retry_count END AS retry_count,
CASE WHEN doc_id % 4 < 2 THEN status = 'indexing' END AS applied, CASE WHEN doc_id % 4 < 2 AND status = 'indexing' THEN 'm2' END AS embedded_model_id FROM files""")
def confirm_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return L.confirm_writes(f, f.where("doc_id % 4 < 2"), "m2", 1800000000).select("doc_id", "status", "retry_count", "applied", "embedded_model_id")


@query("linear_buckets", "WITH b AS (SELECT i, CASE WHEN i < 10 THEN 5.0::DOUBLE + 15 * i END AS le FROM range(11) t(i)) SELECT le, (SELECT count(*) FROM events WHERE value IS NOT NULL AND (le IS NULL OR value <= le)) AS count FROM b")
def linear_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.linear_histogram(table(spark, sf_dir, "events"), "value", 5.0, 15.0, 10)


@query("message_truncate", """WITH m AS (SELECT doc_id, left(text, 20) AS s, substr(text, 21) AS b FROM documents), c AS (SELECT doc_id, s, b, 300 - strlen(s) - 5 AS room, list_transform(range(1, 301), lambda k: strlen(left(b, k::BIGINT))) AS size FROM m)
SELECT doc_id, sha256(CASE WHEN strlen(s) + strlen(b) <= 300 THEN b WHEN strlen(b) <= room THEN b || '[cut]' ELSE left(b, len(list_filter(size, lambda x: x <= room))::BIGINT) || '[cut]' END) AS body FROM c""")
def message_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = F.left("text", F.lit(20)), F.substr("text", F.lit(21))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.truncated(s, b, 300, "[cut]"), 256).alias("body"))


@query("title_and_age", "SELECT event_id, event_type AS title, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age, round(v / pow(10, floor(log10(v)) - 2)) * pow(10, floor(log10(v)) - 2) AS v3 FROM (SELECT event_id, event_type, event_id * 977 % 400000 AS s, (event_id % 7 + 1) * 1250.0::DOUBLE AS v FROM events)")
def title_and_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" \n\t\n  "), "event_type", F.lit(" \nmore"))
    return table(spark, sf_dir, "events").select("event_id", T.title_line(text).alias("title"), T.age(F.col("event_id") * 977 % 400000).alias("age"), T.significant((F.col("event_id") % 7 + 1) * F.lit(1250.0), 3).alias("v3"))


@query("run_details", "SELECT o_orderkey AS id, CASE WHEN length(o_orderpriority) > 6 THEN left(o_orderpriority, 6) || '[truncated]' ELSE o_orderpriority END AS report, length(o_orderpriority) > 6 AS truncated FROM orders WHERE o_orderkey % 2 = 0")
def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("report"))
    return P.run_detail(runs, F.col("id") % 2 == 0, 6)


@query("run_journal", """WITH s AS (SELECT o_custkey % 9 AS project_guid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 9 ORDER BY o_orderkey) AS seq FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_custkey % 9 AS project_guid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 9 ORDER BY floor(epoch(o_orderdate)), o_orderkey) AS k, floor(epoch(o_orderdate))::BIGINT + 60 AS expires_at FROM orders WHERE o_orderkey % 2 = 1), t AS (SELECT project_guid, max(seq) AS top FROM s GROUP BY 1)
SELECT 'runs' AS name, id, coalesce(top, 0) + k AS seq, expires_at FROM n LEFT JOIN t USING (project_guid)
UNION ALL SELECT 'replaced', o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 6 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 AND o_orderstatus = 'F')""")
def run_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("project_guid"), k.alias("id"), F.unix_timestamp("o_orderdate").alias("created_at"), F.when(k % 3 == 0, F.col("o_custkey")).alias("challenged"), F.when(F.col("o_orderstatus") == "F", "refuted").alias("verdict"))
    from pyspark.sql import Window

    old = o.where("id % 2 = 0").withColumn("seq", F.row_number().over(Window.partitionBy("project_guid").orderBy("id")))
    child = o.where("id % 2 = 1").select("id", F.lit("x").alias("path"))
    out = P.run_journal({"runs": old}, {"runs": o.where("id % 2 = 1"), **{c: child for c in ("citations", "evidence", "turns", "context")}}, 60)
    none = F.lit(None).cast("long")
    return out["runs"].select(F.lit("runs").alias("name"), "id", "seq", "expires_at").unionByName(out["replaced"].select(F.lit("replaced").alias("name"), "id", none.alias("seq"), none.alias("expires_at")))
