"""Lifecycle and inventory queries: documents are files, their lines chunks, events status updates and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..registry import query, table
from .standins import CHUNKS_SQL, FILES_SQL, STATUSES, chunks, files

NOW = 1700030000
_EV = "CASE event_type WHEN 'signup' THEN 'just_uploaded' WHEN 'view' THEN 'indexing' WHEN 'click' THEN 'indexed' WHEN 'error' THEN 'failed' ELSE 'deleted' END"
_UPD = f"upd AS (SELECT user_id AS file, event_id AS id, {_EV} AS status, floor(epoch(ts))::BIGINT AS at_s FROM events)"
_MOVES = f"""{_UPD}, o AS (SELECT *, lag(status) OVER w AS old_status, sum((status = 'indexed')::INT) OVER w AS era FROM upd WINDOW w AS (PARTITION BY file ORDER BY id)),
moves AS (SELECT *, sum((status = 'failed')::INT) OVER (PARTITION BY file, era ORDER BY id) AS retry_count,
  coalesce((old_status IS NULL AND status IN ('just_uploaded', 'indexing')) OR (status IN ('indexing', 'deleted') AND old_status IS NOT NULL) OR (old_status = 'indexing' AND status IN ('indexed', 'cancelled', 'failed')), false) AS legal FROM o)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("id"), F.expr(_EV).alias("status"), F.unix_timestamp("ts").alias("at"))


@query("files_by_status", f"WITH {FILES_SQL} SELECT project_guid, status, count(*) AS n FROM files GROUP BY ALL")
def files_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_by(files(spark, sf_dir), "project_guid", "status")


@query("status_pivot", f"WITH {FILES_SQL} SELECT project_guid, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES) + " FROM files GROUP BY project_guid")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status_pivot(files(spark, sf_dir))


@query("language_inventory", f"""WITH {FILES_SQL}, {CHUNKS_SQL}, f AS (SELECT project_guid, programming_language, count(*) AS files, count(*) FILTER (status = 'indexed') AS indexed_files FROM files GROUP BY ALL),
c AS (SELECT project_guid, programming_language, count(*) FILTER (status = 'active') AS chunks_active, count(*) FILTER (status = 'deleted') AS chunks_deleted FROM chunks GROUP BY ALL)
SELECT project_guid, programming_language, files, indexed_files, coalesce(chunks_active, 0) AS chunks_active, coalesce(chunks_deleted, 0) AS chunks_deleted FROM f LEFT JOIN c USING (project_guid, programming_language)""")
def language_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.language_inventory(files(spark, sf_dir), chunks(spark, sf_dir))


@query("state_snapshot", f"""WITH {FILES_SQL}, {CHUNKS_SQL}, c AS (SELECT project_guid, count(*) AS active_chunks FROM chunks WHERE status = 'active' GROUP BY 1)
SELECT project_guid, max(status_updated_at) FILTER (status = 'indexed') AS last_indexed, count(*) FILTER (status = 'failed' AND retry_count >= 3) AS permanently_failed,
count(*) FILTER (status = 'indexing') AS indexing, count(DISTINCT programming_language) AS languages, any_value(coalesce(active_chunks, 0)) AS active_chunks FROM files LEFT JOIN c USING (project_guid) GROUP BY project_guid""")
def state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.state_snapshot(files(spark, sf_dir), chunks(spark, sf_dir))


@query("load_figures", """WITH r AS (SELECT user_id % 4 AS level, floor(epoch(ts) * 1000)::BIGINT AS started, floor(epoch(ts) * 1000)::BIGINT + event_id % 700 AS ended, CASE event_type WHEN 'error' THEN [429, 499, 500, 503, 404, 418][1 + event_id % 6] ELSE 200 END AS status, event_id % 5 AS files, event_id * 37 % 100000 AS bytes, event_id % 11 AS chunks, event_id % 13 AS pool FROM events),
g AS (SELECT level, count(*) AS requests, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(chunks)::BIGINT AS chunks, round((max(ended) - min(started)) / 1000, 3) AS wall_s, """ + ", ".join(f"count(*) FILTER (status = {s}) AS err_{s}" for s in L.TOLD_STATUSES) + """, count(*) FILTER (status >= 400 AND status NOT IN (429, 499, 500, 503)) AS err_other, min(pool) AS min_pool FROM r GROUP BY level)
SELECT *, round(chunks / wall_s, 2) AS chunks_per_s, round(files / wall_s, 2) AS files_per_s, round(bytes / 1048576 / wall_s, 3) AS mb_per_s FROM g""")
def load_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("event_id"), F.floor(F.unix_micros("ts") / 1000)
    status = F.when(F.col("event_type") == "error", F.element_at(F.array(*[F.lit(s) for s in (429, 499, 500, 503, 404, 418)]), (k % 6 + 1).cast("int"))).otherwise(200)
    r = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return L.load_figures(r.select((F.col("user_id") % 4).alias("level"), at.alias("started"), (at + k % 700).alias("ended"), status.alias("status"), (k % 5).alias("files"), (k * 37 % 100000).alias("bytes"), (k % 11).alias("chunks"), (k % 13).alias("pool")))


@query("active_projects", f"WITH {CHUNKS_SQL} SELECT DISTINCT project_guid FROM chunks WHERE status = 'active'")
def active_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("status = 'active'").select("project_guid").distinct()


@query("file_listing", f"""WITH {FILES_SQL}, {CHUNKS_SQL}, c AS (SELECT path, count(*) AS n FROM chunks WHERE status = 'active' GROUP BY path)
SELECT f.path, f.status, coalesce(c.n, 0) AS chunk_count FROM files f LEFT JOIN c USING (path) WHERE status IN ('indexed', 'failed') AND programming_language = 'fr'""")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.file_listing(files(spark, sf_dir), chunks(spark, sf_dir), ["indexed", "failed"], "fr")


@query("status_log", f"WITH {_MOVES}, l AS (SELECT *, lag(retry_count) OVER (PARTITION BY file ORDER BY id) AS b FROM moves) SELECT file, id, old_status, status AS new_status, retry_count::BIGINT AS retry_count FROM l WHERE old_status IS NULL OR old_status <> status OR b <> retry_count")
def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status_log(L.transitions(updates(spark, sf_dir)))


@query("state_machine_violations", f"WITH {_MOVES} SELECT old_status, status, count(*) AS n FROM moves WHERE NOT legal GROUP BY ALL")
def state_machine_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.transitions(updates(spark, sf_dir)).where("not legal").groupBy("old_status", "status").agg(F.count(F.lit(1)).alias("n"))


@query("retry_candidates", f"WITH {FILES_SQL} SELECT project_guid, path FROM files WHERE ((status = 'failed' AND {NOW} - status_updated_at > 3600) OR (status = 'indexing' AND {NOW} - status_updated_at > 7200)) AND retry_count < 3")
def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.retry_candidates(files(spark, sf_dir), NOW, 3600, 7200, 3).select("project_guid", "path")


_RUNS = "runs AS (SELECT concat('m', user_id % 3) AS model, event_type AS effort, CASE WHEN event_id % 4 = 0 THEN 'challenge' ELSE 'research' END AS kind, floor(epoch(ts))::BIGINT AS created_at, (value * 1000)::BIGINT AS elapsed_ms FROM events)"


@query("observed_cost", f"""WITH {_RUNS}, p AS (SELECT model, effort, elapsed_ms, count(*) OVER (PARTITION BY model, effort) AS n, row_number() OVER (PARTITION BY model, effort ORDER BY elapsed_ms) AS k FROM runs WHERE kind = 'research' AND created_at >= (SELECT max(floor(epoch(ts))::BIGINT) FROM events) - 2592000)
SELECT model, effort, count(*) AS runs, ceil(max(elapsed_ms) FILTER (k = least(greatest(ceil(n * 0.5), 1), n)) / 1000)::BIGINT AS p50_s, ceil(max(elapsed_ms) FILTER (k = least(greatest(ceil(n * 0.9), 1), n)) / 1000)::BIGINT AS p90_s FROM p GROUP BY model, effort HAVING count(*) >= 3""")
def observed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max(F.unix_timestamp("ts")).alias("t")).first().t
    kind = F.when(F.col("event_id") % 4 == 0, "challenge").otherwise("research")
    runs = e.select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("effort"), kind.alias("kind"), F.unix_timestamp("ts").alias("created_at"), F.round(F.col("value") * 1000).cast("long").alias("elapsed_ms"))
    return L.observed_cost(runs, now or 0, 30 * 86400, 3)


@query("histogram_buckets", "WITH b AS (SELECT i, CASE WHEN i < 12 THEN 0.5::DOUBLE * pow(2, i) END AS le FROM range(13) t(i)) SELECT le, (SELECT count(*) FROM events WHERE value IS NOT NULL AND (le IS NULL OR value <= le)) AS count FROM b")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.histogram(table(spark, sf_dir, "events"), "value", 0.5, 2.0, 12)


@query("prune_orphans", f"WITH {FILES_SQL}, {CHUNKS_SQL} SELECT project_guid, path FROM files f WHERE status = 'deleted' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.path = f.path AND c.project_guid = f.project_guid AND c.status = 'active')")
def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prune_files(files(spark, sf_dir), chunks(spark, sf_dir).where("status = 'active'")).select("project_guid", "path")


@query("gc_phases", f"""WITH {FILES_SQL}, {CHUNKS_SQL}, {_UPD}, gone AS (SELECT path, n FROM chunks WHERE status = 'deleted' AND n % 2 = 0), kept AS (SELECT path FROM chunks ANTI JOIN gone USING (path, n) WHERE n < 2)
SELECT 1 AS phase, 'chunks' AS name, (SELECT count(*) FROM gone) AS removed UNION ALL SELECT 2, 'files', (SELECT count(*) FROM files WHERE status = 'deleted' AND path NOT IN (SELECT path FROM (SELECT path FROM chunks ANTI JOIN gone USING (path, n))))
UNION ALL SELECT 3, 'status_log', (SELECT count(*) FROM upd WHERE at_s < (SELECT max(at_s) FROM upd) - 864000) UNION ALL SELECT 4, 'research', (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0 AND floor(epoch(o_orderdate))::BIGINT < (SELECT max(at_s) FROM upd))""")
def gc_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("chunk", F.concat_ws("#", "path", "n"))
    log = updates(spark, sf_dir)
    now = log.agg(F.max("at").alias("t")).first().t or 0
    runs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.unix_timestamp("o_orderdate")).alias("expires_at"))
    confirmed = c.where("status = 'deleted' and n % 2 = 0").select("chunk")
    return L.gc_phases(files(spark, sf_dir), c, log, runs, confirmed, now, 10)


@query("collection_health", f"""WITH {CHUNKS_SQL}, c AS (SELECT project_guid, count(*) AS chunks FROM chunks WHERE status = 'active' GROUP BY 1), v AS (SELECT project_guid, count(*) AS vectors FROM chunks WHERE status = 'active' AND project_guid <> 'src3' AND (project_guid = 'src1' OR n < 5) GROUP BY 1)
SELECT project_guid, chunks, vectors, coalesce(chunks <> vectors, false) AS stale FROM c LEFT JOIN v USING (project_guid)""")
def collection_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return L.collection_health(c, c.where("status = 'active' and project_guid <> 'src3' and (project_guid = 'src1' or n < 5)"))


def _action(name: str, changed: str, status: str, retry: str) -> None:
    @query(f"files_{name}", f"WITH {FILES_SQL} SELECT doc_id, {status} AS status, {retry} AS retry_count, {changed} AS changed FROM files")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = files(spark, sf_dir)
        return L.apply_action(f, F.col("programming_language") == "fr", name).select("doc_id", "status", "retry_count", "changed")


_action("cancel", "programming_language = 'fr' AND status = 'indexing'", "CASE WHEN programming_language = 'fr' AND status = 'indexing' THEN 'cancelled' ELSE status END", "retry_count")
_action("delete", "programming_language = 'fr' AND status <> 'deleted'", "CASE WHEN programming_language = 'fr' THEN 'deleted' ELSE status END", "retry_count")
_action("requeue", "programming_language = 'fr' AND status = 'failed'", "status", "CASE WHEN programming_language = 'fr' AND status = 'failed' THEN 0 ELSE retry_count END")


@query("pin_runs", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE floor(epoch(o_orderdate))::BIGINT + 86400 END AS expires_at FROM orders")
def pin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.unix_timestamp("o_orderdate").alias("created_at"))
    return L.pin(o.withColumn("expires_at", F.col("created_at") + 86400), F.col("o_orderstatus") == "P", True, 86400).select("id", "expires_at")


@query("health_fold", "SELECT c_custkey // 3 AS node, CASE max(CASE WHEN c_acctbal > 0 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'ok' END AS verdict FROM customer GROUP BY 1")
def health_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return L.health(c.select(F.expr("c_custkey div 3").alias("node"), (F.col("c_acctbal") > 0).alias("ok"), (F.col("c_mktsegment") == "BUILDING").alias("required")), "node")


@query("freshness_probe", f"WITH {FILES_SQL}, a AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE sha256 END AS sha FROM files WHERE doc_id % 3 = 0) SELECT a.path, CASE WHEN f.path IS NULL THEN 'removed' WHEN status = 'indexing' THEN 'in_flight' WHEN f.sha256 <> a.sha THEN 'changed' ELSE 'fresh' END AS state FROM a LEFT JOIN files f ON f.path = a.path AND f.status <> 'deleted'")
def freshness_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return L.probe(f.where("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("sha256")).alias("sha256")), f)


@query("load_summary", "WITH r AS (SELECT user_id % 4 AS level, floor(epoch(ts))::BIGINT AS started, value AS ms, event_type <> 'error' AS ok FROM events), p AS (SELECT *, count(*) OVER (PARTITION BY level) AS n, row_number() OVER (PARTITION BY level ORDER BY ms) AS k FROM r) SELECT level, count(*) AS requests, count(*) FILTER (NOT ok) AS errors, max(started) - min(started) AS wall_s, " + ", ".join(f"max(ms) FILTER (k = greatest(ceil(n * {q}), 1)) AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", round(count(*) / greatest(max(started) - min(started), 1), 6) AS per_s FROM p GROUP BY level")
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return L.load_summary(e.select((F.col("user_id") % 4).alias("level"), F.unix_timestamp("ts").alias("started"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok")))


@query("drop_reasons", f"WITH {FILES_SQL} SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN status = 'deleted' THEN 'deleted' WHEN programming_language = 'es' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n, count(DISTINCT sha256) AS contents FROM files GROUP BY 1")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drop_reasons(files(spark, sf_dir), {"short": F.col("n_chars") < 200, "deleted": F.col("status") == "deleted", "language": F.col("programming_language") == "es"}, "sha256")


@query("cumulative_progress", f"WITH {CHUNKS_SQL}, b AS (SELECT path, n, length(code) AS size FROM chunks) SELECT path, n, sum(size) OVER (PARTITION BY path ORDER BY n)::BIGINT AS done FROM b")
def cumulative_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return chunks(spark, sf_dir).select("path", "n", F.sum(F.length("code")).over(Window.partitionBy("path").orderBy("n")).alias("done"))


@query("longest_chunks", f"WITH {CHUNKS_SQL} SELECT path, n, length(code) AS size FROM chunks ORDER BY size DESC, path, n LIMIT 25")
def longest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("path", "n", F.length("code").alias("size")).orderBy(F.desc("size"), "path", "n").limit(25)
