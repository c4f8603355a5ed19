"""Event-time queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import streams as S
from .standins import FILES_SQL, files

_KIND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'rename' ELSE 'modify' END"
_RAW = f"raw AS (SELECT event_id AS seq, floor(epoch(ts)) AS ts, {_KIND} AS kind, 'f' || user_id % 200 AS path, 'f' || (user_id % 200 + 1) AS \"to\" FROM events)"
_CLASSIFIED = f"{_RAW}, ev AS (SELECT seq, ts, 'delete' AS op, path FROM raw WHERE kind IN ('remove', 'rename') UNION ALL SELECT seq, ts, 'upsert', CASE WHEN kind = 'rename' THEN \"to\" ELSE path END FROM raw WHERE kind <> 'remove')"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = lambda k: F.concat(F.lit("f"), (F.col("user_id") % 200 + k).cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("ts"), F.expr(_KIND).alias("kind"), name(0).alias("path"), name(1).alias("to"))


@query("classify_events", f"WITH {_CLASSIFIED} SELECT seq, round(ts)::BIGINT AS ts, op, path FROM ev")
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.classify(raw(spark, sf_dir)).withColumn("ts", F.col("ts").cast("long"))


@query("last_per_flush", f"WITH {_CLASSIFIED} SELECT path, seq, max(op) AS op FROM ev e WHERE seq = (SELECT max(seq) FROM ev x WHERE x.path = e.path) GROUP BY path, seq")
def last_per_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_per_flush(S.classify(raw(spark, sf_dir)))


@query("debounce", f"""WITH RECURSIVE {_CLASSIFIED}, o AS (SELECT min(ts) AS open FROM ev UNION ALL SELECT (SELECT min(ts) FROM ev WHERE ts >= o.open + 3600) FROM o WHERE o.open IS NOT NULL),
k AS (SELECT e.path, o.open::DOUBLE AS open, e.ts::DOUBLE AS ts, e.seq, e.op, row_number() OVER (PARTITION BY e.path, o.open ORDER BY e.ts DESC, e.seq DESC, e.op DESC) AS k FROM o JOIN ev e ON e.ts >= o.open AND e.ts < o.open + 3600)
SELECT path, open, ts, seq, op FROM k WHERE k = 1""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window for all paths."""
    return S.debounced(S.classify(raw(spark, sf_dir)), 3600.0)


_PROBES = "p AS (SELECT user_id % 20 AS run, event_id % 7 AS path, event_id AS seq, CASE event_type WHEN 'error' THEN 'changed' WHEN 'signup' THEN CASE WHEN event_id % 11 = 0 THEN 'removed' END WHEN 'purchase' THEN 'in_flight' ELSE 'fresh' END AS state FROM events)"


@query("sticky_probes", f"WITH {_PROBES} SELECT run, path, seq, coalesce(bool_or(state = 'changed') OVER w, false) AS changed, coalesce(bool_or(state = 'removed') OVER w, false) AS removed, coalesce(last_value(state IGNORE NULLS) OVER w = 'in_flight', false) AS in_flight FROM p WINDOW w AS (PARTITION BY run, path ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def sticky_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr("CASE event_type WHEN 'error' THEN 'changed' WHEN 'signup' THEN CASE WHEN event_id % 11 = 0 THEN 'removed' END WHEN 'purchase' THEN 'in_flight' ELSE 'fresh' END")
    return S.sticky_probes(table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), (F.col("event_id") % 7).alias("path"), F.col("event_id").alias("seq"), state.alias("state")))


@query("tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("sessionize", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(table(spark, sf_dir, "events"), "6 hours")


_SAMPLES = "s AS (SELECT user_id % 50 AS key, floor(epoch(ts))::BIGINT AS t, max(event_id) AS value FROM events GROUP BY 1, 2)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("key"), F.unix_timestamp("ts").alias("t")).agg(F.max("event_id").alias("value"))


@query("rate_window", f"WITH {_SAMPLES}, x AS (SELECT *, coalesce(max(t) OVER o, min(t) OVER i) AS t0, coalesce(arg_max(value, t) OVER o, arg_min(value, t) OVER i) AS v0 FROM s WINDOW o AS (PARTITION BY key ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 20001 PRECEDING), i AS (PARTITION BY key ORDER BY t RANGE BETWEEN 20000 PRECEDING AND CURRENT ROW)) SELECT key, t, value, round(CASE WHEN t > t0 THEN (value - v0) / (t - t0) ELSE 0 END, 6) AS per_second FROM x")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rate(samples(spark, sf_dir), 20000).withColumn("per_second", F.round("per_second", 6))


@query("counter_increase", f"WITH {_SAMPLES}, d AS (SELECT key, value, lag(value) OVER (PARTITION BY key ORDER BY t) AS b FROM s) SELECT key, sum(CASE WHEN b IS NULL THEN 0 WHEN value >= b THEN value - b ELSE value END)::BIGINT AS increase FROM d GROUP BY key")
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.increase(samples(spark, sf_dir))


_EVENT = "CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'indexed' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'error' ELSE 'prepared' END"


@query("progress_fold", f"WITH e AS (SELECT user_id % 30 AS run, 'l' || event_id % 4 AS language, {_EVENT} AS event, event_id % 9 AS chunks FROM events) SELECT run, language, count(*) FILTER (event = 'indexed') AS indexed, count(*) FILTER (event = 'skipped') AS skipped, coalesce(sum(chunks) FILTER (event = 'indexed'), 0)::BIGINT AS chunks, count(*) FILTER (event = 'error') AS errors FROM e GROUP BY ALL")
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return S.fold_progress(e.select((F.col("user_id") % 30).alias("run"), F.concat(F.lit("l"), F.col("event_id") % 4).alias("language"), F.expr(_EVENT).alias("event"), (F.col("event_id") % 9).alias("chunks")))


@query("overdue_files", f"WITH {FILES_SQL} SELECT path, status FROM files WHERE (status = 'indexing' AND status_updated_at < 1700030000 - 7200) OR (status = 'failed' AND status_updated_at < 1700030000 - 600)")
def overdue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overdue(files(spark, sf_dir), 1700030000, {"indexing": 7200, "failed": 600}).select("path", "status")


@query("admission", "WITH r AS (SELECT user_id % 5 AS project_guid, user_id % 97 AS path, floor(epoch(ts))::BIGINT AS arrived, event_id AS id FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY project_guid, path ORDER BY arrived, id) = 1 AS f FROM r) SELECT id, f AND row_number() OVER (PARTITION BY project_guid, f ORDER BY arrived, id) <= 10 AS admitted FROM f")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("project_guid"), (F.col("user_id") % 97).alias("path"), F.unix_timestamp("ts").alias("arrived"), F.col("event_id").alias("id"))
    return S.admit(r, 10).select("id", "admitted")
