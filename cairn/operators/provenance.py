"""Stored runs: citations, staleness, transitive validity, trust, paging."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = ("unchallenged", "confirmed", "disputed", "refuted")


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; a temporary one where none is set, in local mode."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-"))
    return df.checkpoint(eager=True)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (a_end >= b_start)


def read_chunks(chunks: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    """The first ``limit`` active chunks that overlap each asked span (path, from, to)."""
    hit = chunks.where("status = 'active'").join(asked, "path").where(overlaps(F.col("start_line"), F.col("end_line"), F.col("from"), F.col("to")))
    k = F.row_number().over(Window.partitionBy("path", "from", "to").orderBy("start_line", "end_line"))
    return hit.withColumn("k", k).where(F.col("k") <= limit)


def citation_verdicts(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """run, ord, path, verdict: verified where a shown span of the path overlaps, path_only where only the path was shown.

    citations: run, ord, path, start, end; evidence: run, path, spans (array of struct start, end), a row per run and
    path, so the join keeps one row per citation and the overlap is tested inside the array.
    """
    j = citations.join(evidence, ["run", "path"], "left")
    hit = F.exists("spans", lambda s: overlaps(s["start"], s["end"], F.col("start"), F.col("end")))
    return j.select("run", "ord", "path", F.when(F.col("spans").isNull(), "unverified").when(hit, "verified").otherwise("path_only").alias("verdict"))


def citation_counters(verdicts: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return verdicts.groupBy("run").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(v == x).alias(x) for x in ("verified", "path_only", "unverified")])


def ancestors(edges: DataFrame) -> DataFrame:
    """(run, ancestor): the closure of (run, parent) by doubling, so a chain of n takes log2(n) joins."""
    known, n = settle(edges.select("run", F.col("parent").alias("ancestor")).distinct()), -1
    while (now := known.count()) != n:
        n = now
        step = known.select("run", F.col("ancestor").alias("_via")).join(known.select(F.col("run").alias("_via"), "ancestor"), "_via").select("run", "ancestor")
        known = settle(known.union(step).distinct())
    return known


def validity(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """run, valid, invalid_reason; runs: run, stale. Own staleness comes first, then deleted, then stale ancestors.

    Two flags per run travel along the edges until no run gains one; the closure itself is never built. A round moves
    only what the round before found.
    """
    e = settle(edges.select("run", "parent").distinct())
    flags = lambda gone, bad: (F.max(gone).alias("_gone"), F.max(bad).alias("_bad"))
    state = runs.select(F.col("run").alias("parent"), "stale")
    new = settle(e.join(state, "parent", "left").groupBy("run").agg(*flags(F.col("stale").isNull(), F.coalesce("stale", F.lit(False)))).where("_gone or _bad"))
    seen = new
    while not new.isEmpty():
        up = e.join(new.withColumnRenamed("run", "parent"), "parent").groupBy("run").agg(*flags("_gone", "_bad"))
        old = seen.select("run", F.col("_gone").alias("_g"), F.col("_bad").alias("_b"))
        more = (F.col("_gone") & ~F.coalesce("_g", F.lit(False))) | (F.col("_bad") & ~F.coalesce("_b", F.lit(False)))
        new = settle(up.join(old, "run", "left").where(more).select("run", "_gone", "_bad"))
        seen = settle(seen.unionByName(new).groupBy("run").agg(*flags("_gone", "_bad")))
    j = runs.join(seen, "run", "left")
    reason = F.when(F.col("stale"), "stale").when(F.col("_gone"), "context_deleted").when(F.col("_bad"), "context_invalid")
    return j.select("run", reason.isNull().alias("valid"), reason.alias("invalid_reason"))


def context_degrees(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """run, references, referenced_by, context (ancestors, the oldest first)."""
    e = edges.distinct()
    out, back = e.groupBy("run").agg(F.count(F.lit(1)).alias("references")), e.groupBy(F.col("parent").alias("run")).agg(F.count(F.lit(1)).alias("referenced_by"))
    ctx = ancestors(edges).groupBy("run").agg(F.array_sort(F.collect_set("ancestor")).alias("context"))
    j = runs.select("run").join(out, "run", "left").join(back, "run", "left").join(ctx, "run", "left")
    return j.select("run", F.coalesce("references", F.lit(0)).alias("references"), F.coalesce("referenced_by", F.lit(0)).alias("referenced_by"), F.coalesce("context", F.array().cast("array<bigint>")).alias("context"))


def trust(runs: DataFrame, challenges: DataFrame) -> DataFrame:
    """run, trust: the gravest verdict of its valid challenges; challenges: challenged, verdict (null: inconclusive), valid."""
    rank = F.create_map(*[x for i, s in enumerate(SEVERITY) for x in (F.lit(s), F.lit(i))])
    worst = challenges.where("valid and verdict is not null").groupBy(F.col("challenged").alias("run")).agg(F.max(rank[F.col("verdict")]).alias("_w"))
    names = F.array(*[F.lit(s) for s in SEVERITY])
    return runs.select("run").join(worst, "run", "left").select("run", F.element_at(names, F.coalesce("_w", F.lit(0)) + 1).alias("trust"))


def verdict_cap(verdict: Column, verified: Column, unverified: Column) -> Column:
    """A verdict without grounds: refuted becomes disputed, confirmed becomes nothing."""
    grounded = (verified > 0) & (unverified <= verified)
    return F.when(grounded, verdict).when(verdict == "refuted", "disputed").when(verdict == "disputed", "disputed")


def keyset_page(rows: DataFrame, limit: int, before: int | None = None, key: str = "seq") -> DataFrame:
    """The page of rows below ``before``, newest first, with the cursor of the next one (null on a short page)."""
    page = (rows.where(F.col(key) < before) if before is not None else rows).orderBy(F.desc(key)).limit(limit)
    cursor = page.agg(F.when(F.count(F.lit(1)) == limit, F.min(key)).alias("c")).first().c
    return page.withColumn("next_before", F.lit(cursor).cast(rows.schema[key].dataType))


def corpus_totals(state: DataFrame) -> DataFrame:
    """One row of counts; the collectable runs are a union, never a sum. state: stale, valid, kind, done."""
    stale, invalid, partial = F.col("stale"), ~F.col("valid"), F.col("done") != "finalized"
    inconclusive = (F.col("kind") == "challenge") & F.col("verdict").isNull()
    c = F.count_if
    return state.agg(
        F.count(F.lit(1)).alias("total"), c(F.col("valid")).alias("current"), c(F.col("kind") == "challenge").alias("challenges"), c(stale).alias("stale"), c(invalid).alias("gc_invalid"),
        c(partial).alias("gc_partial"), c(inconclusive).alias("gc_inconclusive"), c(stale | invalid | partial | inconclusive).alias("gc_candidates"),
    )


def insert_runs(stored: DataFrame, new: DataFrame, retention: int) -> DataFrame:
    """New runs get the next numbers of their project and an expiry. new: project_guid, created_at, id."""
    top = stored.groupBy("project_guid").agg(F.max("seq").alias("_top"))
    k = F.row_number().over(Window.partitionBy("project_guid").orderBy("created_at", "id"))
    return new.withColumn("_k", k).join(top, "project_guid", "left").withColumn("seq", F.coalesce("_top", F.lit(0)) + F.col("_k")).withColumn("expires_at", F.col("created_at") + retention).drop("_k", "_top")


def excerpts(verified: DataFrame, chunks: DataFrame, cap: int) -> DataFrame:
    """run, path, start_line, bytes of the active chunks under verified citations, in order, whole, up to ``cap`` bytes a run."""
    hit = verified.join(chunks.where("status = 'active'"), "path").where(overlaps(F.col("start_line"), F.col("end_line"), F.col("start"), F.col("end")))
    once = hit.select("run", "path", "start_line", F.octet_length("code").alias("bytes")).distinct()
    order = Window.partitionBy("run").orderBy("path", "start_line")
    return once.withColumn("_t", F.sum("bytes").over(order)).where(F.col("_t") <= cap).drop("_t")


def standing_challenges(challenges: DataFrame) -> DataFrame:
    """The newest challenge with a verdict of each run; an inconclusive one never replaces it. challenges: challenged, seq, verdict."""
    k = F.row_number().over(Window.partitionBy("challenged").orderBy(F.desc("seq")))
    return challenges.where("verdict is not null").withColumn("k", k).where("k = 1").drop("k")


def verification(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """run, matches, spans_available: recorded counters against those of the evidence; both run, verified, path_only, unverified."""
    r = recomputed.select("run", *[F.col(c).alias(f"_{c}") for c in ("verified", "path_only", "unverified")])
    j = recorded.join(r, "run", "left")
    same = (F.col("verified") == F.col("_verified")) & (F.col("path_only") == F.col("_path_only")) & (F.col("unverified") == F.col("_unverified"))
    return j.select("run", F.coalesce(same, F.lit(False)).alias("matches"), F.col("_verified").isNotNull().alias("spans_available"))


def run_journal(stored: dict[str, DataFrame], new: dict[str, DataFrame], retention: int) -> dict[str, DataFrame]:
    """What is to be appended to the run table and to its four child tables, and what a new challenge replaces.

    new: runs (project_guid, created_at, id, challenged: null unless it is a challenge, verdict) and the children
    citations, evidence, turns and context, each with the id of its run. Children of unknown runs are refused. replaced
    has the ids of older challenges of the same run: a new one with a verdict stands in their place.
    """
    runs = insert_runs(stored["runs"], new["runs"], retention)
    children = {k: new[k] for k in ("citations", "evidence", "turns", "context")}
    for name, rows in children.items():
        if not rows.join(new["runs"].select("id"), "id", "left_anti").isEmpty():
            raise ValueError(f"{name} of a run that is not inserted with them")
    judged = new["runs"].where("challenged is not null and verdict is not null").select("challenged").distinct()
    old = stored["runs"].where("challenged is not null").join(judged, "challenged", "left_semi").select("id")
    return {"runs": runs, **children, "replaced": old}


def run_summaries(runs: DataFrame) -> DataFrame:
    """What a list of runs shows: everything but the report, which the scan then never reads, and pinned and partial."""
    return runs.drop("report").withColumn("pinned", F.col("expires_at").isNull()).withColumn("partial", F.col("done") != "finalized")


def filtered_runs(runs: DataFrame, limit: int, before: int | None = None, **wanted: bool | str | int | None) -> DataFrame:
    """The newest ``limit`` runs below ``before`` with all wanted attributes; the filters come before the limit.

    wanted: stale, pinned, valid, partial (booleans), kind, challenged; None asks for nothing. runs: seq and these.
    """
    unknown = set(wanted) - {"stale", "pinned", "valid", "partial", "kind", "challenged"}
    if unknown:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    out = runs if before is None else runs.where(F.col("seq") < before)
    for name, value in wanted.items():
        out = out if value is None else out.where(F.col(name) == F.lit(value))
    return out.orderBy(F.desc("seq")).limit(limit)


def file_states(cited: DataFrame, files: DataFrame) -> DataFrame:
    """cited (with path, sha256) and state: fresh, changed or removed against files (path, sha256)."""
    j = cited.join(files.select("path", F.col("sha256").alias("_now")), "path", "left")
    return j.withColumn("state", F.when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("sha256"), "changed").otherwise("fresh")).drop("_now")


def stale_runs(cited: DataFrame, files: DataFrame) -> DataFrame:
    """The runs (run) of whose cited files one at least is not fresh."""
    return file_states(cited, files).where("state <> 'fresh'").select("run").distinct()


def citation_report(verdicts: DataFrame, states: DataFrame) -> DataFrame:
    """The counters of each run's citations, and beside them stale: those whose file is not fresh. Repeats count.

    verdicts: run, ord, verdict; states: run, ord, state.
    """
    j = verdicts.join(states.select("run", "ord", "state"), ["run", "ord"], "left")
    v = F.col("verdict")
    return j.groupBy("run").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(v == x).alias(x) for x in ("verified", "path_only", "unverified")], F.count_if(F.col("state") != "fresh").alias("stale"))


def challenge_subjects(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Challenges (run, challenged) with ``columns`` of their subject, and whether it is gone."""
    subject = runs.select(F.col("run").alias("challenged"), *[F.col(c).alias(f"subject_{c}") for c in columns], F.lit(True).alias("_there"))
    c = runs.where("challenged is not null").select("run", "challenged")
    return c.join(subject, "challenged", "left").withColumn("subject_deleted", F.col("_there").isNull()).drop("_there")


def run_detail(runs: DataFrame, run: Column, most: int, marker: str = "[truncated]") -> DataFrame:
    """The run with its report, cut to ``most`` characters with a marker, and whether it was cut."""
    cut = F.length("report") > most
    return runs.where(run).withColumn("report", F.when(cut, F.concat(F.left("report", F.lit(most)), F.lit(marker))).otherwise(F.col("report"))).withColumn("truncated", F.coalesce(cut, F.lit(False)))
