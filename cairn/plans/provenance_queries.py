"""Provenance queries: conversations are runs (their context is arithmetic on the id), lineitems citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import provenance as P
from ..registry import query, table
from .standins import CHUNKS_SQL, chunks

_VERDICT = "CASE run % 4 WHEN 0 THEN 'refuted' WHEN 1 THEN 'disputed' WHEN 2 THEN 'confirmed' END"
_RUNS = f"""ids AS (SELECT conv_id AS run, count(*) AS turns FROM conversations GROUP BY conv_id), runs AS (SELECT run, turns, run % 17 = 0 AS stale, CASE WHEN run % 5 = 0 THEN 'challenge' ELSE 'research' END AS kind,
  CASE WHEN run % 6 = 0 THEN 'budget' ELSE 'finalized' END AS done, CASE WHEN run % 5 = 0 THEN {_VERDICT} END AS verdict FROM ids WHERE run % 29 <> 28),
edges AS (SELECT run, run // 2 AS parent FROM runs WHERE run >= 2 UNION SELECT run, run // 3 FROM runs WHERE run >= 3 AND run % 2 = 0)"""
_CLOSURE = f"""{_RUNS}, reach AS (SELECT run, parent AS ancestor FROM edges UNION SELECT r.run, e.parent FROM reach r JOIN edges e ON r.ancestor = e.run)"""
_VALID = f"""{_CLOSURE}, s AS (SELECT reach.run, bool_or(a.run IS NULL) AS gone, bool_or(coalesce(a.stale, false)) AS bad FROM reach LEFT JOIN runs a ON a.run = reach.ancestor GROUP BY reach.run),
valid AS (SELECT run, reason IS NULL AS valid, reason AS invalid_reason FROM (SELECT r.run, CASE WHEN stale THEN 'stale' WHEN gone THEN 'context_deleted' WHEN bad THEN 'context_invalid' END AS reason FROM runs r LEFT JOIN s USING (run)))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run")).agg(F.count(F.lit(1)).alias("turns")).where("run % 29 <> 28")
    return r.select("run", "turns", (F.col("run") % 17 == 0).alias("stale"), F.expr("if(run % 5 = 0, 'challenge', 'research')").alias("kind"), F.expr("if(run % 6 = 0, 'budget', 'finalized')").alias("done"), F.expr(f"CASE WHEN run % 5 = 0 THEN {_VERDICT} END").alias("verdict"))


def edges(r: DataFrame) -> DataFrame:
    two = r.where("run >= 2").select("run", F.expr("run div 2").alias("parent"))
    return two.union(r.where("run >= 3 and run % 2 = 0").select("run", F.expr("run div 3"))).distinct()


@query("run_validity", f"WITH RECURSIVE {_VALID} SELECT run, valid, invalid_reason FROM valid")
def run_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return P.validity(r, edges(r))


@query("context_degrees", f"WITH RECURSIVE {_CLOSURE} SELECT run, (SELECT count(*) FROM edges e WHERE e.run = r.run) AS \"references\", (SELECT count(*) FROM edges e WHERE e.parent = r.run) AS referenced_by, coalesce((SELECT list_sort(list(DISTINCT ancestor)) FROM reach x WHERE x.run = r.run), []) AS context FROM runs r")
def context_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return P.context_degrees(r, edges(r))


@query("run_trust", f"""WITH RECURSIVE {_VALID}, c AS (SELECT run // 5 AS challenged, verdict FROM runs JOIN valid USING (run) WHERE kind = 'challenge' AND valid AND verdict IS NOT NULL)
SELECT run, coalesce((SELECT CASE max(CASE verdict WHEN 'refuted' THEN 3 WHEN 'disputed' THEN 2 ELSE 1 END) WHEN 3 THEN 'refuted' WHEN 2 THEN 'disputed' WHEN 1 THEN 'confirmed' END FROM c WHERE challenged = r.run), 'unchallenged') AS trust FROM runs r""")
def run_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    c = r.where("kind = 'challenge'").join(P.validity(r, edges(r)), "run").select(F.expr("run div 5").alias("challenged"), "verdict", "valid")
    return P.trust(r, c)


@query("corpus_totals", f"""WITH RECURSIVE {_VALID} SELECT count(*) AS total, count(*) FILTER (valid) AS current, count(*) FILTER (kind = 'challenge') AS challenges, count(*) FILTER (stale) AS stale, count(*) FILTER (NOT valid) AS gc_invalid,
count(*) FILTER (done <> 'finalized') AS gc_partial, count(*) FILTER (kind = 'challenge' AND verdict IS NULL) AS gc_inconclusive, count(*) FILTER (stale OR NOT valid OR done <> 'finalized' OR (kind = 'challenge' AND verdict IS NULL)) AS gc_candidates FROM runs JOIN valid USING (run)""")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return P.corpus_totals(r.join(P.validity(r, edges(r)), "run"))


@query("run_list_filtered", f"WITH RECURSIVE {_VALID} SELECT run, kind, done <> 'finalized' AS partial FROM runs JOIN valid USING (run) WHERE valid AND kind = 'research' AND run < 100 ORDER BY run DESC LIMIT 20")
def run_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    hit = r.join(P.validity(r, edges(r)), "run").where("valid and kind = 'research' and run < 100")
    return hit.orderBy(F.desc("run")).limit(20).select("run", "kind", (F.col("done") != "finalized").alias("partial"))


@query("keyset_page", "WITH p AS (SELECT o_orderkey AS seq, o_custkey FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 50) SELECT seq, o_custkey, CASE WHEN count(*) OVER () = 50 THEN min(seq) OVER () END AS next_before FROM p")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keyset_page(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey"), 50, 500)


_CIT = """cit AS (SELECT l_orderkey AS run, l_linenumber AS ord, l_partkey % 4 AS path, l_suppkey % 50 AS s, l_suppkey % 50 + 5 AS e FROM lineitem),
ev AS (SELECT l_orderkey AS run, l_partkey % 4 AS path, l_partkey % 50 AS s, l_partkey % 50 + 8 AS e FROM lineitem WHERE l_linenumber % 2 = 0),
verdicts AS (SELECT c.run, c.ord, c.path, CASE WHEN NOT EXISTS (SELECT 1 FROM ev WHERE ev.run = c.run AND ev.path = c.path) THEN 'unverified' WHEN EXISTS (SELECT 1 FROM ev WHERE ev.run = c.run AND ev.path = c.path AND ev.s <= c.e AND ev.e >= c.s) THEN 'verified' ELSE 'path_only' END AS verdict FROM cit c)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 4).alias("path"), (F.col("l_suppkey") % 50).alias("start"), (F.col("l_suppkey") % 50 + 5).alias("end"))
    span = F.struct((F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + 8).alias("end"))
    e = li.where("l_linenumber % 2 = 0").groupBy(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 4).alias("path")).agg(F.collect_set(span).alias("spans"))
    return P.citation_verdicts(c, e)


@query("citation_verdicts", f"WITH {_CIT} SELECT run, ord, path, verdict FROM verdicts")
def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir)


@query("citation_counters", f"WITH {_CIT} SELECT run, count(*) AS total, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'path_only') AS path_only, count(*) FILTER (verdict = 'unverified') AS unverified FROM verdicts GROUP BY run")
def citation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.citation_counters(verdicts(spark, sf_dir))


@query("verdict_cap", f"""WITH {_CIT}, n AS (SELECT run, count(*) FILTER (verdict = 'verified') AS v, count(*) FILTER (verdict = 'unverified') AS u FROM verdicts GROUP BY run), x AS (SELECT run, v, u, {_VERDICT} AS verdict FROM n)
SELECT run, CASE WHEN v > 0 AND u <= v THEN verdict WHEN verdict IN ('refuted', 'disputed') THEN 'disputed' END AS capped FROM x""")
def verdict_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.citation_counters(verdicts(spark, sf_dir)).select("run", P.verdict_cap(F.expr(_VERDICT), F.col("verified"), F.col("unverified")).alias("capped"))


@query("read_chunks_overlap", f"""WITH {CHUNKS_SQL}, a AS (SELECT DISTINCT path, 2 + doc_id % 5 AS f, 6 + doc_id % 9 AS t FROM chunks), h AS (SELECT c.path, start_line, end_line, row_number() OVER (PARTITION BY c.path, f, t ORDER BY start_line, end_line) AS k FROM chunks c JOIN a ON a.path = c.path AND start_line <= t AND end_line >= f WHERE status = 'active')
SELECT path, start_line, end_line, k FROM h WHERE k <= 8""")
def read_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    asked = c.select("path", (F.col("doc_id") % 5 + 2).alias("from"), (F.col("doc_id") % 9 + 6).alias("to")).distinct()
    return P.read_chunks(c, asked).select("path", "start_line", "end_line", "k")


@query("stale_runs", "WITH b AS (SELECT l_orderkey AS run, l_partkey AS path, l_suppkey % 3 AS sha FROM lineitem), f AS (SELECT p_partkey AS path, p_size % 3 AS sha FROM part WHERE p_partkey % 10 <> 0) SELECT DISTINCT run FROM b LEFT JOIN f ON f.path = b.path WHERE f.sha IS NULL OR f.sha <> b.sha")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("path"), (F.col("l_suppkey") % 3).alias("sha"))
    f = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("path"), (F.col("p_size") % 3).alias("now"))
    return P.stale_runs(b.withColumnRenamed("sha", "sha256"), f.withColumnRenamed("now", "sha256"))


@query("file_freshness", "WITH f AS (SELECT p_partkey AS path, p_size % 3 AS sha FROM part WHERE p_partkey % 10 <> 0) SELECT l_orderkey AS run, l_linenumber AS ord, CASE WHEN f.path IS NULL THEN 'removed' WHEN f.sha <> l_suppkey % 3 THEN 'changed' ELSE 'fresh' END AS state FROM lineitem LEFT JOIN f ON f.path = l_partkey")
def file_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("run", "ord", "state")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("path"), (F.col("p_size") % 3).alias("sha256"))
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("path"), (F.col("l_suppkey") % 3).alias("sha256"))
    return P.file_states(cited, f)


@query("run_sequences", "WITH o AS (SELECT o_custkey AS project_guid, floor(epoch(o_orderdate))::BIGINT AS created_at, o_orderkey AS id FROM orders), s AS (SELECT project_guid, count(*) AS top FROM o WHERE id % 2 = 0 GROUP BY 1) SELECT o.project_guid, id, coalesce(top, 0) + row_number() OVER (PARTITION BY o.project_guid ORDER BY created_at, id) AS seq, created_at + 604800 AS expires_at FROM o LEFT JOIN s USING (project_guid) WHERE id % 2 = 1")
def run_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_guid"), F.unix_timestamp("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    stored = o.where("id % 2 = 0").withColumn("seq", F.row_number().over(Window.partitionBy("project_guid").orderBy("id")))
    return P.insert_runs(stored, o.where("id % 2 = 1"), 604800).drop("created_at")


@query("challenge_subjects", f"WITH {_RUNS} SELECT c.run, c.run // 5 AS challenged, s.turns AS subject_turns, s.run IS NULL AS subject_deleted FROM runs c LEFT JOIN runs s ON s.run = c.run // 5 WHERE c.kind = 'challenge'")
def challenge_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    r = r.withColumn("challenged", F.when(F.col("kind") == "challenge", F.expr("run div 5")))
    return P.challenge_subjects(r, ["turns"])


@query("standing_challenges", "WITH c AS (SELECT user_id % 300 AS challenged, event_id AS seq, CASE event_type WHEN 'error' THEN 'refuted' WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'disputed' END AS verdict FROM events) SELECT challenged, seq, verdict FROM (SELECT *, row_number() OVER (PARTITION BY challenged ORDER BY seq DESC) AS k FROM c WHERE verdict IS NOT NULL) WHERE k = 1")
def standing_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("CASE event_type WHEN 'error' THEN 'refuted' WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'disputed' END")
    return P.standing_challenges(table(spark, sf_dir, "events").select((F.col("user_id") % 300).alias("challenged"), F.col("event_id").alias("seq"), v.alias("verdict")))


@query("offline_verification", f"""WITH {_CIT}, n AS (SELECT run, count(*) FILTER (verdict = 'verified') AS v, count(*) FILTER (verdict = 'path_only') AS p, count(*) FILTER (verdict = 'unverified') AS u FROM verdicts GROUP BY run), old AS (SELECT run, v + (run % 7 = 0)::INT AS v, p, u FROM n), new AS (SELECT * FROM n WHERE run % 5 <> 0)
SELECT old.run, coalesce((old.v, old.p, old.u) = (new.v, new.p, new.u), false) AS matches, new.run IS NOT NULL AS spans_available FROM old LEFT JOIN new USING (run)""")
def offline_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.citation_counters(verdicts(spark, sf_dir))
    return P.verification(n.withColumn("verified", F.col("verified") + (F.col("run") % 7 == 0).cast("int")), n.where("run % 5 <> 0"))


@query("citation_excerpts", f"""WITH {CHUNKS_SQL}, v AS (SELECT DISTINCT doc_id % 50 AS run, path, 2 AS s, 8 AS e FROM chunks), h AS (SELECT DISTINCT run, c.path, start_line, strlen(code) AS bytes FROM v JOIN chunks c ON c.path = v.path AND start_line <= e AND end_line >= s WHERE status = 'active'),
t AS (SELECT *, sum(bytes) OVER (PARTITION BY run ORDER BY path, start_line) AS t FROM h) SELECT run, path, start_line, bytes FROM t WHERE t <= 8000""")
def citation_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    v = c.select((F.col("doc_id") % 50).alias("run"), "path", F.lit(2).alias("start"), F.lit(8).alias("end")).distinct()
    return P.excerpts(v, c, 8000)


@query("browse_runs", f"WITH RECURSIVE {_VALID} SELECT run, turns FROM runs JOIN valid USING (run) WHERE valid AND run NOT IN (3, 4, 8) ORDER BY run DESC LIMIT 15")
def browse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    seen = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (3, 4, 8)])).alias("run"))
    return r.join(P.validity(r, edges(r)).where("valid"), "run", "left_semi").join(seen, "run", "left_anti").orderBy(F.desc("run")).limit(15).select("run", "turns")
