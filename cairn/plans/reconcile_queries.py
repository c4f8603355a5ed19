"""Reconciliation queries: documents against a mutated copy of themselves, orders as commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..registry import query, table
from .standins import CHUNKS_SQL, FILES_SQL, chunks, files

_MANIFEST = "manifest AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN sha256('x') ELSE upper(sha256) END AS sha256 FROM files WHERE doc_id % 13 <> 0 UNION ALL SELECT concat(path, '.new'), sha256 FROM files WHERE doc_id % 17 = 0)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    own = f.where("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper("sha256")).alias("sha256"))
    return own.unionByName(f.where("doc_id % 17 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "sha256"))


@query("drift_buckets", f"""WITH {FILES_SQL}, {_MANIFEST}, b AS (SELECT coalesce(m.path, f.path) AS path, CASE WHEN status = 'indexing' THEN 'indexing' WHEN status = 'indexed' AND m.path IS NULL THEN 'orphaned'
  WHEN status = 'indexed' AND lower(m.sha256) <> f.sha256 THEN 'stale' WHEN m.path IS NOT NULL AND coalesce(status, '') <> 'indexed' THEN 'missing' END AS bucket FROM manifest m FULL JOIN files f ON m.path = f.path) SELECT path, bucket FROM b WHERE bucket IS NOT NULL""")
def drift_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drift(manifest(spark, sf_dir), files(spark, sf_dir))


_COMMITS = "commits AS (SELECT o_custkey % 50 AS project_guid, o_orderkey AS sha, floor(epoch(o_orderdate))::BIGINT AS committed_at FROM orders)"
SINCE = 800000000


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("project_guid"), F.col("o_orderkey").alias("sha"), F.unix_timestamp("o_orderdate").alias("committed_at"))


@query("history_sync", f"""WITH {_COMMITS}, s AS (SELECT * FROM commits WHERE sha % 5 <> 0), p AS (SELECT * FROM commits WHERE sha % 3 <> 0)
SELECT project_guid, sha, change FROM (SELECT coalesce(p.project_guid, s.project_guid) AS project_guid, coalesce(p.sha, s.sha) AS sha, CASE WHEN s.sha IS NULL THEN 'indexed' WHEN p.sha IS NOT NULL THEN 'unchanged' WHEN s.committed_at >= {SINCE} THEN 'removed' END AS change
FROM p FULL JOIN s ON p.project_guid = s.project_guid AND p.sha = s.sha) WHERE change IS NOT NULL""")
def history_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = commits(spark, sf_dir)
    return R.history_sync(c.where("sha % 3 <> 0"), c.where("sha % 5 <> 0"), SINCE)


@query("history_keep_last", f"WITH {_COMMITS}, r AS (SELECT *, row_number() OVER (PARTITION BY project_guid ORDER BY committed_at DESC, sha DESC) AS rank FROM commits) SELECT project_guid, sha, committed_at, rank FROM r WHERE rank > 20 AND committed_at < {SINCE * 11 // 10}")
def history_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_last(commits(spark, sf_dir), 20, SINCE * 11 // 10)


#: An order is a commit: by its number a subject, a body, parents and paths.
_WALK = f"""w AS (SELECT o_orderkey AS sha, floor(epoch(o_orderdate))::BIGINT AS ts, 1 + (o_orderkey % 4 = 0)::INT AS parents,
  CASE o_orderkey % 7 WHEN 0 THEN 'Merge branch b' WHEN 1 THEN 'Merge the two parsers' WHEN 2 THEN 'ab' WHEN 3 THEN 'Merge tag v1' ELSE 'Change ' || o_orderkey END AS subject,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN ' ' ELSE repeat('é', o_orderkey % 9) || CASE WHEN o_orderkey % 500 = 2 THEN repeat('x', 65536) ELSE '' END END AS body,
  list_transform(range(o_orderkey % 4), lambda j: CASE WHEN (o_orderkey + j) % 3 = 0 THEN 'src/a' || j || '.py' ELSE 'docs/b' || j || '.md' END) AS paths FROM orders),
e AS (SELECT *, max(ts) OVER () - 900 * 86400 AS oldest, list_filter(paths, lambda p: starts_with(p, 'src/')) AS own, strlen(subject) + strlen(body) AS bytes FROM w),
r AS (SELECT *, CASE WHEN ts >= oldest THEN row_number() OVER (PARTITION BY ts >= oldest ORDER BY ts DESC, sha) END AS k FROM e),
d AS (SELECT *, CASE WHEN ts < oldest THEN 'age' WHEN k > 3000 THEN 'count' WHEN bytes < 12 THEN 'message' WHEN parents > 1 AND trim(body) = '' AND (starts_with(subject, 'Merge branch ') OR starts_with(subject, 'Merge tag ')) THEN 'merge' WHEN len(paths) > 0 AND len(own) = 0 THEN 'scope' END AS drop_ FROM r)"""


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import kept_commits

    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    subject = F.when(k % 7 == 0, "Merge branch b").when(k % 7 == 1, "Merge the two parsers").when(k % 7 == 2, "ab").when(k % 7 == 3, "Merge tag v1").otherwise(F.concat(F.lit("Change "), k.cast("string")))
    body = F.when(k % 3 == 0, "").when(k % 3 == 1, " ").otherwise(F.concat(F.repeat(F.lit("é"), (k % 9).cast("int")), F.when(k % 500 == 2, F.repeat(F.lit("x"), F.lit(65536))).otherwise("")))
    name = lambda j: F.when((k + j) % 3 == 0, F.concat(F.lit("src/a"), j.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("docs/b"), j.cast("string"), F.lit(".md")))
    paths = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < k % 4), lambda j: F.struct(name(j).alias("path")))
    c = o.select(k.alias("sha"), F.unix_timestamp("o_orderdate").alias("committed_at"), (F.when(k % 4 == 0, 2).otherwise(1)).alias("parent_count"), subject.alias("subject"), body.alias("body"), paths.alias("paths"))
    return kept_commits(c, c.agg(F.max("committed_at")).first()[0] or 0, 900, 3000, 12, includes=["src/**"])


@query("commit_walk", f"WITH {_WALK} SELECT sha, drop_ AS \"drop\", drop_ IS NULL AND bytes > 65536 AS cut, CASE WHEN drop_ IS NULL THEN own ELSE paths END AS paths FROM d")
def commit_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which commits of a walk are kept, and with which paths."""
    return walked(spark, sf_dir).select("sha", "drop", "cut", F.transform("paths", lambda p: p["path"]).alias("paths"))


@query("commit_drops", f"WITH {_WALK} SELECT drop_ AS \"drop\", count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT 'cut', count(*) FROM d WHERE drop_ IS NULL AND bytes > 65536 HAVING count(*) > 0")
def commit_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import drop_counts

    return drop_counts(walked(spark, sf_dir))


@query("file_history", f"""WITH {_COMMITS}, t AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem), h AS (SELECT path, sha, committed_at, count(*) OVER (PARTITION BY path) AS total, row_number() OVER (PARTITION BY path ORDER BY committed_at DESC, sha DESC) AS rank FROM t JOIN commits USING (sha))
SELECT path, sha, committed_at, total, left(sha::VARCHAR, 8) AS short_sha, path % 2 = 0 AS path_indexed FROM h WHERE rank <= 10""")
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).distinct()
    paths = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    return R.file_history(commits(spark, sf_dir).drop("project_guid"), touched, paths.where("path % 2 = 0"), touched.select("path").distinct(), 10)


@query("index_equivalence", f"""WITH {CHUNKS_SQL}, a AS (SELECT path, list((start_line, end_line) ORDER BY start_line, end_line) AS s FROM chunks WHERE doc_id % 10 <> 0 GROUP BY path),
b AS (SELECT path, list((start_line, end_line + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END) ORDER BY start_line, end_line) AS s FROM chunks WHERE doc_id % 8 <> 0 GROUP BY path)
SELECT path, problem FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'only_a' WHEN a.path IS NULL THEN 'only_b' WHEN a.s <> b.s THEN 'spans' END AS problem FROM a FULL JOIN b ON a.path = b.path) WHERE problem IS NOT NULL""")
def index_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    b = c.where("doc_id % 8 <> 0").withColumn("end_line", F.col("end_line") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0))
    return R.equivalence(c.where("doc_id % 10 <> 0"), b)


@query("merge_labels", "WITH i AS (SELECT o_orderkey % 500 AS base_commit, list_sort(list_distinct(list(l_partkey % 3))) AS gold, any_value(o_orderpriority) AS dataset FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT base_commit, gold, list_sort(list(DISTINCT dataset)) AS datasets, count(*) AS n FROM i GROUP BY base_commit, gold")
def merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    i = j.groupBy("o_orderkey").agg(F.collect_list(F.col("l_partkey") % 3).alias("gold"), F.first("o_orderpriority").alias("dataset"))
    return R.merge_labels(i.select((F.col("o_orderkey") % 500).alias("base_commit"), "gold", "dataset"))


@query("skip_decision", f"""WITH {FILES_SQL}, {_MANIFEST}, s AS (SELECT path, sha256, status, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'c1' END AS chunks_version, CASE WHEN doc_id % 5 = 0 THEN 's0' ELSE 's1' END AS symbols_version FROM files)
SELECT m.path, CASE WHEN status = 'indexing' THEN 'in_flight' WHEN coalesce(lower(m.sha256) = lower(s.sha256) AND chunks_version = 'c1' AND status = 'indexed', false) AND symbols_version = 's1' THEN 'unchanged'
WHEN coalesce(lower(m.sha256) = lower(s.sha256) AND chunks_version = 'c1' AND status = 'indexed', false) THEN 'symbols_only' WHEN s.sha256 IS NULL THEN 'new' ELSE 'full' END AS decision FROM manifest m LEFT JOIN s USING (path)""")
def skip_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    s = f.select("path", "sha256", "status", F.when(F.col("doc_id") % 4 != 0, "c1").alias("chunks_version"), F.when(F.col("doc_id") % 5 == 0, "s0").otherwise("s1").alias("symbols_version"))
    return R.skip_decision(manifest(spark, sf_dir), s, {"chunks_version": "c1", "symbols_version": "s1"})


@query("registry_equality", "WITH c AS (SELECT r_name AS id, r_regionkey * 1024 AS dim FROM region), s AS (SELECT r_name AS id, CASE WHEN r_regionkey = 2 THEN 1 ELSE r_regionkey * 1024 END AS dim FROM region WHERE r_regionkey <> 4) SELECT *, 'compiled' AS side FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM s) UNION ALL SELECT *, 'stored' FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM c)")
def registry_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), (F.col("r_regionkey") * 1024).alias("dim"), "r_regionkey")
    s = c.where("r_regionkey <> 4").withColumn("dim", F.when(F.col("r_regionkey") == 2, 1).otherwise(F.col("dim")))
    return R.registry_differences(c, s)


@query("answers_in_order", "WITH r AS (SELECT l_orderkey AS batch, l_linenumber - 1 AS i, l_partkey AS v FROM lineitem), g AS (SELECT batch, list(i ORDER BY i, v) AS i, list(v ORDER BY i, v) AS v FROM r GROUP BY batch) SELECT batch, i = range(len(i)) AS ok, CASE WHEN i = range(len(i)) THEN v END AS values FROM g")
def answers_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.requests_in_order(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") - 1).alias("index"), F.col("l_partkey").alias("value")))


@query("leg_instances", "SELECT o_orderkey AS q FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40")
def leg_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instances that every leg of a fusion has."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("q")).intersect(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey"))
