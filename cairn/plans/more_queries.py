"""Attribute filters, reports and stream checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import lifecycle as L
from ..operators import provenance as P
from ..operators import reconcile as R
from ..operators import retrieve as V
from ..registry import only, query, table
from ..streaming import streams as S
from .evaluate_queries import _RANKED, gold, results
from .provenance_queries import _CIT, _states, verdicts
from .reconcile_queries import _MANIFEST, manifest
from .retrieve_queries import _SYMBOLS_SQL, _symbols
from .standins import CHUNKS_SQL, FILES_SQL, chunks, files


@query("runs_by_attributes", """WITH r AS (SELECT o_orderkey AS seq, o_orderstatus = 'F' AS stale, o_orderkey % 3 = 0 AS pinned, o_orderkey % 5 <> 0 AS valid, o_orderkey % 7 = 0 AS partial, CASE WHEN o_orderkey % 2 = 0 THEN 'challenge' ELSE 'research' END AS kind, o_custkey % 4 AS challenged FROM orders)
(SELECT 'a' AS page, seq FROM r WHERE NOT stale AND pinned AND valid AND NOT partial AND kind = 'challenge' AND challenged = 2 AND seq < 5000 ORDER BY seq DESC LIMIT 12) UNION ALL (SELECT 'b', seq FROM r WHERE stale AND NOT pinned ORDER BY seq DESC LIMIT 7) UNION ALL (SELECT 'c', seq FROM r ORDER BY seq DESC LIMIT 3)""")
def runs_by_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("seq"), (F.col("o_orderstatus") == "F").alias("stale"), (k % 3 == 0).alias("pinned"), (k % 5 != 0).alias("valid"), (k % 7 == 0).alias("partial"), F.when(k % 2 == 0, "challenge").otherwise("research").alias("kind"), (F.col("o_custkey") % 4).alias("challenged"))
    page = lambda name, df: df.select(F.lit(name).alias("page"), "seq")
    a = P.filtered_runs(r, 12, 5000, stale=False, pinned=True, valid=True, partial=False, kind="challenge", challenged=2)
    return page("a", a).unionByName(page("b", P.filtered_runs(r, 7, stale=True, pinned=False))).unionByName(page("c", P.filtered_runs(r, 3, kind=None)))


@query("run_summaries", "SELECT o_orderkey AS run, o_orderkey % 3 = 0 AS pinned, o_orderstatus <> 'F' AS partial FROM orders")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("run"), F.when(k % 3 != 0, F.lit(1)).alias("expires_at"), F.when(F.col("o_orderstatus") == "F", "finalized").otherwise("cut").alias("done"), F.col("o_orderpriority").alias("report"))
    return P.run_summaries(r).drop("expires_at", "done")


@query("citation_report", f"""WITH {_CIT}, f AS (SELECT p_partkey AS path, p_size % 3 AS sha FROM part WHERE p_partkey % 10 <> 0), st AS (SELECT l_orderkey AS run, count(*) FILTER (f.path IS NULL OR f.sha <> l_suppkey % 3) AS stale FROM lineitem LEFT JOIN f ON f.path = l_partkey WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY ALL HAVING count(*) = 1) GROUP BY 1)
SELECT run, count(*) AS total, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'path_only') AS path_only, count(*) FILTER (verdict = 'unverified') AS unverified, any_value(stale) AS stale FROM verdicts JOIN st USING (run) WHERE (run, ord) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY ALL HAVING count(*) = 1) GROUP BY run""")
def citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over citations whose place in their run is their own."""
    once = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("ord")).count().where("count = 1").select("run", "ord")
    return P.citation_report(verdicts(spark, sf_dir).join(once, ["run", "ord"]), _states(spark, sf_dir))


@query("symbols_by_project", "SELECT p_size % 5 AS project_guid, count(*) AS n FROM part GROUP BY 1")
def symbols_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_by(table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("project_guid")), "project_guid")


@query("refusals", "SELECT user_id % 3 AS corpus, event_type AS refusal, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return E.refusals(e.select((F.col("user_id") % 3).alias("corpus"), F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")).alias("refusal")))


@query("accuracy_at", f"WITH {_RANKED}, n AS (SELECT q, count(*) AS n FROM gold GROUP BY q), h AS (SELECT q, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 10) AS h10 FROM ranked SEMI JOIN gold USING (q, path) GROUP BY q) SELECT q, (coalesce(h1, 0) = n)::INT AS acc1, (coalesce(h3, 0) = n)::INT AS acc3, (coalesce(h10, 0) = n)::INT AS acc10 FROM n LEFT JOIN h USING (q)")
def accuracy_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy_at(E.ranked_files(results(spark, sf_dir)), gold(spark, sf_dir), [1, 3, 10])


@query("definition_counts", f"WITH {_SYMBOLS_SQL}, n AS (SELECT name, kind FROM symbols WHERE start_line = 3) SELECT count(*) FILTER (path LIKE 'p/1/%') AS total, count(*) FILTER (path NOT LIKE 'p/1/%') AS out_of_scope FROM symbols s JOIN n ON n.name = s.name AND n.kind = s.kind")
def definition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    name, kind = only(s.where("start_line = 3"), "name", "kind")
    return V.definition_counts(s, name or "", F.col("path").startswith("p/1/"), kind or "")


@query("best_per_chunk", """WITH r AS (SELECT 'l' || l_linenumber % 2 AS leg, l_orderkey AS q, l_partkey % 3 AS path, 1 AS start_line, 2 AS end_line, max(l_quantity)::DOUBLE AS score FROM lineitem GROUP BY ALL)
SELECT leg, q, path, start_line, end_line, score, row_number() OVER (PARTITION BY leg, q ORDER BY score DESC, path) AS rank FROM r""")
def best_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return V.best_per_chunk(li.select(F.concat(F.lit("l"), (F.col("l_linenumber") % 2).cast("string")).alias("leg"), F.col("l_orderkey").alias("q"), (F.col("l_partkey") % 3).alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.col("l_quantity").cast("double").alias("score")))


_NAMES = "CASE doc_id % 4 WHEN 0 THEN concat(md5(source), '_qwen_v3') WHEN 1 THEN concat(md5(source), '_bge_v3') WHEN 2 THEN concat(md5(source), '_else_v3') ELSE concat(md5(source), '_v1') END"


@query("collection_report", f"""WITH {CHUNKS_SQL}, c AS (SELECT project_guid, count(*) AS n, count(*) FILTER (n < 5 OR project_guid = 'src1') AS v FROM chunks WHERE status = 'active' GROUP BY 1), k AS (SELECT DISTINCT doc_id % 4 AS m, CASE WHEN doc_id % 5 = 0 THEN 'gone' ELSE source END AS project_guid, {_NAMES} AS name FROM documents),
o AS (SELECT k.*, p.project_guid IS NOT NULL AS known FROM k LEFT JOIN (SELECT DISTINCT project_guid FROM chunks) p USING (project_guid))
SELECT 'stale' AS kind, count(*) FILTER (v > 0 AND n <> v) AS n FROM c UNION ALL SELECT 'orphaned', count(*) FILTER (NOT known OR m = 2) FROM o UNION ALL SELECT 'other_model', count(*) FILTER (known AND m = 1) FROM o""")
def collection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    k = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 == 0, "gone").otherwise(F.col("source")).alias("project_guid"), F.expr(_NAMES).alias("name")).distinct()
    return L.collection_report(c, c.where("status = 'active' and (n < 5 or project_guid = 'src1')"), k, T.collection_class(F.col("name"), ["qwen", "bge"], "qwen", "v3"))


@query("skip_reasons", f"""WITH {FILES_SQL}, {_MANIFEST}, s AS (SELECT path, sha256, status, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'c1' END AS v FROM files), d AS (SELECT m.path, status, s.sha256 IS NULL AS fresh, coalesce(lower(m.sha256) = lower(s.sha256) AND v = 'c1' AND status = 'indexed', false) AS same FROM manifest m LEFT JOIN s USING (path))
SELECT path, CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN status = 'indexing' THEN 'in_flight' WHEN same THEN 'unchanged' ELSE 'needs_full_reindex' END AS reason FROM d""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a pass over symbols only."""
    f = files(spark, sf_dir)
    s = f.select("path", "sha256", "status", F.when(F.col("doc_id") % 4 != 0, "c1").alias("chunks_version"))
    d = R.skip_decision(manifest(spark, sf_dir), s, {"chunks_version": "c1"}).join(f.select("path", "status"), "path", "left")
    return d.select("path", R.skip_reason(F.col("decision"), F.col("status"), symbols_only=True).alias("reason"))


@query("pending_events", """WITH e AS (SELECT event_id AS seq, event_type, 'f' || user_id % 9 || CASE user_id % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.bin' ELSE '' END AS path FROM events)
SELECT seq, 'upsert' AS op, path FROM e WHERE event_type <> 'error' AND path LIKE '%.rs' UNION ALL SELECT seq, 'delete', path FROM e WHERE event_type = 'error'""")
def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    path = F.concat(F.lit("f"), (u % 9).cast("string"), F.when(u % 3 == 0, ".rs").when(u % 3 == 1, ".bin").otherwise(""))
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit(0.0).alias("ts"), F.when(F.col("event_type") == "error", "remove").otherwise("modify").alias("kind"), path.alias("path"), path.alias("to"))
    return S.pending(raw).select("seq", "op", "path")


_EVENT = "CASE WHEN event_type = 'signup' THEN 'started' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'done' ELSE 'indexed' END"


@query("progress_faults", f"""WITH e AS (SELECT user_id AS run, event_id AS seq, {_EVENT} AS event FROM events), b AS (SELECT run, arg_min(event, seq) AS f, arg_max(event, seq) AS l, count(*) FILTER (event IN ('done', 'failed')) AS n FROM e GROUP BY run)
SELECT * FROM (SELECT run, CASE WHEN f <> 'started' THEN 'not_started' WHEN n = 0 THEN 'no_end' WHEN n > 1 THEN 'several_ends' WHEN l NOT IN ('done', 'failed') THEN 'events_after_end' END AS fault FROM b) WHERE fault IS NOT NULL""")
def progress_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.progress_faults(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event")))


@query("bucket_quantile", """WITH b AS (SELECT event_type AS key, le, (SELECT count(*) FROM events x WHERE x.event_type = e.event_type AND (le IS NULL OR x.value <= le)) AS count FROM (SELECT DISTINCT event_type FROM events) e, (SELECT unnest([10.0::DOUBLE, 40.0, 90.0, NULL]) AS le)),
p AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(count) OVER w, 0) AS before, 0.9::DOUBLE * max(count) OVER (PARTITION BY key) AS r FROM b WINDOW w AS (PARTITION BY key ORDER BY le NULLS LAST))
SELECT key, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (r - before) / (count - before) END, 6) AS value FROM p WHERE count >= r AND before < r""")
def bucket_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bounds = [10.0, 40.0, 90.0]
    rows = F.array(*[F.struct(F.lit(b).alias("le"), (F.col("value") <= b).cast("long").alias("n")) for b in bounds], F.struct(F.lit(None).cast("double").alias("le"), F.lit(1).cast("long").alias("n")))
    b = e.where("value is not null").select(F.col("event_type").alias("key"), F.explode(rows).alias("b")).groupBy("key", "b.le").agg(F.sum("b.n").alias("count"))
    return S.bucket_quantile(b, 0.9).withColumn("value", F.round("value", 6))


@query("outline_scope", f"""WITH {FILES_SQL}, s AS (SELECT path, 'n' || (doc_id % 3) AS name, doc_id % 7 AS start_line FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT path, 'm', 3 FROM files WHERE doc_id % 6 = 0), a AS (SELECT path FROM files WHERE doc_id % 5 = 0 UNION ALL SELECT 'none/' || doc_id FROM files WHERE doc_id % 50 = 0)
SELECT a.path, row_number() OVER (PARTITION BY a.path ORDER BY start_line, name) AS ord, name, start_line, programming_language, f.path IS NOT NULL AS indexed, a.path LIKE 'src/en/%' AS in_scope, count(name) OVER (PARTITION BY a.path) AS total FROM a LEFT JOIN files f ON f.path = a.path LEFT JOIN s ON s.path = a.path""")
def outline_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, d = files(spark, sf_dir), F.col("doc_id")
    s = f.where("doc_id % 2 = 0").select("path", F.concat(F.lit("n"), (d % 3).cast("string")).alias("name"), (d % 7).alias("start_line"))
    s = s.unionByName(f.where("doc_id % 6 = 0").select("path", F.lit("m").alias("name"), F.lit(3).cast("long").alias("start_line")))
    asked = f.where("doc_id % 5 = 0").select("path").unionByName(f.where("doc_id % 50 = 0").select(F.concat(F.lit("none/"), d.cast("string")).alias("path")))
    return V.outline(asked, f, s, F.col("path").startswith("src/en/"))


@query("paired_deltas", """WITH o AS (SELECT o_orderkey AS q, o_totalprice::DOUBLE AS v FROM orders) SELECT a.q, round(b.v * 2 - a.v, 4) AS d1, round(c.v - 1 - a.v, 4) AS d2 FROM o a JOIN o b ON b.q = a.q AND b.q % 2 = 0 JOIN o c ON c.q = a.q AND c.q % 3 = 0""")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_totalprice").cast("double").alias("value"))
    d = E.paired_deltas(o, o.where("q % 2 = 0").withColumn("value", F.col("value") * 2), o.where("q % 3 = 0").withColumn("value", F.col("value") - 1))
    return d.select("q", F.round("d1", 4).alias("d1"), F.round("d2", 4).alias("d2"))


@query("names_in_gold", """WITH p AS (SELECT p_partkey AS k, 'f' || p_partkey AS path, replace(p_name, ' ', '_') || ' ' || split_part(p_name, ' ', 1) AS text FROM part), a AS (SELECT k AS q, unnest([split_part(split_part(text, ' ', 1), '_', 1), split_part(text, ' ', 1), 'missing']) AS name, unnest([path, path, path]) AS gold FROM p WHERE k % 9 = 0),
w AS (SELECT DISTINCT path, unnest(string_split(text, ' ')) AS name FROM p), d AS (SELECT name, count(*) AS df FROM w GROUP BY name), g AS (SELECT DISTINCT a.q FROM a JOIN w ON w.name = a.name AND w.path = 'f' || (a.q + a.q % 2))
SELECT a.q, a.q IN (SELECT q FROM g) AS in_gold, count(df) AS present, min(df) AS df_min FROM a LEFT JOIN d USING (name) GROUP BY a.q""")
def names_in_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    whole, first = F.replace("p_name", F.lit(" "), F.lit("_")), F.split_part("p_name", F.lit(" "), F.lit(1))
    p = table(spark, sf_dir, "part").select(k, F.concat(F.lit("f"), k.cast("string")).alias("path"), F.concat(whole, F.lit(" "), first).alias("text"), F.array(first, whole, F.lit("missing")).alias("names"))
    asked = p.where("p_partkey % 9 = 0").select(k.alias("q"), "names", F.array(F.concat(F.lit("f"), (k + k % 2).cast("string"))).alias("gold"))
    return C.names_in_gold(asked, p)


@query("dataset_drops", """WITH r AS (SELECT o_orderkey AS k, o_custkey % 40 AS commit, o_orderpriority AS dataset, CASE WHEN o_orderkey % 5 = 0 THEN 'no_patch' WHEN o_orderkey % 7 = 0 THEN 'short_query' END AS reason FROM orders), kept AS (SELECT commit, count(*) AS c, count(DISTINCT dataset) AS d FROM r WHERE reason IS NULL GROUP BY commit)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'kept', count(*) FROM kept UNION ALL SELECT 'kept_by_dataset', sum(d)::BIGINT FROM kept UNION ALL SELECT 'merged', (sum(c) - count(*))::BIGINT FROM kept""")
def dataset_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 40).alias("commit"), F.col("o_orderpriority").alias("dataset"))
    return C.drops(r, {"no_patch": k % 5 == 0, "short_query": k % 7 == 0}, ["commit"])
