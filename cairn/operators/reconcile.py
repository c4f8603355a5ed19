"""Drift, history and equivalence of index states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` without an equal one in ``b`` (same columns); nulls match no row."""
    return a.join(b, a.columns, "left_anti")


def drift(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, bucket: files that agree are left out.

    indexing: in flight, whatever the tree has. orphaned: indexed, absent from the tree. missing: in the tree, not
    indexed (never, failed, cancelled or deleted). stale: indexed with another hash.
    """
    m, f = manifest.select("path", F.lower("sha256").alias("_new")), files.select("path", F.lower("sha256").alias("_old"), "status")
    both = m.join(f, "path", "full_outer")
    indexed = F.coalesce(F.col("status") == "indexed", F.lit(False))
    bucket = (
        F.when(F.col("status") == "indexing", "indexing")
        .when(F.col("_new").isNull(), F.when(indexed, "orphaned"))
        .when(~indexed, "missing")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "stale")
    )
    return both.select("path", bucket.alias("bucket")).where("bucket is not null")


def history_sync(posted: DataFrame, stored: DataFrame, since: int | None) -> DataFrame:
    """project_guid, sha, change: indexed, unchanged or removed; ``since`` bounds only what is removed."""
    key = ["project_guid", "sha"]
    both = posted.select(*key, F.lit(True).alias("_p")).join(stored.select(*key, "committed_at", F.lit(True).alias("_s")), key, "full_outer")
    change = F.when(F.col("_s").isNull(), "indexed").when(F.col("_p").isNotNull(), "unchanged").when(F.lit(since is None) | (F.col("committed_at") >= (since or 0)), "removed")
    return both.select(*key, change.alias("change")).where("change is not null")


def keep_last(commits: DataFrame, n: int, older_than: int | None) -> DataFrame:
    """Commits to delete: beyond the newest ``n`` of their project and, where given, older than a time."""
    rank = F.row_number().over(Window.partitionBy("project_guid").orderBy(F.desc("committed_at"), F.desc("sha")))
    out = commits.withColumn("rank", rank).where(F.col("rank") > n)
    return out.where(F.col("committed_at") < older_than) if older_than is not None else out


def file_history(commits: DataFrame, touched: DataFrame, files: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """The newest commits that touch each asked path, with the total and whether the path is indexed (it may not be)."""
    known = files.select("path", F.lit(True).alias("_known"))
    hits = touched.join(paths, "path", "left_semi").join(commits, "sha")
    w = Window.partitionBy("path")
    rank = F.row_number().over(w.orderBy(F.desc("committed_at"), F.desc("sha")))
    out = hits.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("rank", rank).where(F.col("rank") <= limit)
    return out.join(known, "path", "left").select("path", "sha", "committed_at", "total", F.substring(F.col("sha").cast("string"), 1, 8).alias("short_sha"), F.coalesce("_known", F.lit(False)).alias("path_indexed"))


def equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, problem: only_a, only_b or spans where two states of an index (path, start_line, end_line) differ."""
    spans = lambda df, name: df.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias(name))
    both = spans(a, "_a").join(spans(b, "_b"), "path", "full_outer")
    return both.select("path", F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("_a") != F.col("_b"), "spans").alias("problem")).where("problem is not null")


def merge_labels(instances: DataFrame) -> DataFrame:
    """Instances of the same commit and gold set become one: base_commit, gold, datasets (sorted), n."""
    keyed = instances.withColumn("gold", F.array_sort(F.array_distinct("gold")))
    return keyed.groupBy("base_commit", "gold").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"), F.count(F.lit(1)).alias("n"))


def skip_decision(posted: DataFrame, stored: DataFrame, versions: dict[str, str]) -> DataFrame:
    """path, decision: what an indexing pass does. A null version never matches, so it heals itself."""
    s = stored.select("path", F.col("sha256").alias("_sha"), "status", *versions)
    j = posted.join(s, "path", "left")
    same = {k: F.coalesce(F.col(k) == v, F.lit(False)) for k, v in versions.items()}
    content = F.coalesce(F.lower("sha256") == F.lower("_sha"), F.lit(False))
    symbols = same.pop("symbols_version", F.lit(True))
    rest = F.lit(True)
    for c in same.values():
        rest = rest & c
    decision = F.when(F.col("status") == "indexing", "in_flight").when(content & rest & symbols & (F.col("status") == "indexed"), "unchanged").when(content & rest & (F.col("status") == "indexed"), "symbols_only").when(F.col("_sha").isNull(), "new").otherwise("full")
    return j.select("path", decision.alias("decision"))


def skip_reason(decision: Column, status: Column, symbols_only: bool = False) -> Column:
    """Why a file is skipped: unchanged, in_flight, cancelled, or needs_full_reindex where only symbols were asked and more
    has changed; null where it is worked on."""
    full = decision.isin("full", "new") if symbols_only else F.lit(False)
    return F.when(status == "cancelled", "cancelled").when(decision.isin("unchanged", "in_flight"), decision).when(full, "needs_full_reindex")


def registry_differences(compiled: DataFrame, stored: DataFrame) -> DataFrame:
    """id, dim, side of entries that only one registry has; empty when they agree."""
    only = lambda a, b, side: a.select("id", "dim").exceptAll(b.select("id", "dim")).withColumn("side", F.lit(side))
    return only(compiled, stored, "compiled").unionByName(only(stored, compiled, "stored"))


def requests_in_order(rows: DataFrame) -> DataFrame:
    """batch, ok, values: answers put back by their asserted index; a missing or repeated index refuses the batch."""
    g = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("r"))
    index = F.transform("r", lambda x: x["index"])
    ok = index == F.sequence(F.lit(0), F.size("r") - 1)
    return g.select("batch", ok.alias("ok"), F.when(ok, F.transform("r", lambda x: x["value"])).alias("values"))
