"""File states, audit log, retries, garbage collection and inventories. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("just_uploaded", "indexing", "indexed", "failed", "cancelled", "deleted")


def legal(old: Column, new: Column) -> Column:
    """Files begin as just_uploaded or indexing; anything may be indexed again or deleted; indexing ends in three ways.
    A file stays in its status only as indexing or deleted."""
    start = old.isNull() & new.isin("just_uploaded", "indexing")
    return F.coalesce(start | new.isin("indexing", "deleted") & old.isNotNull() | (old == "indexing") & new.isin("indexed", "cancelled", "failed"), F.lit(False))


def transitions(updates: DataFrame, key: str = "file", order: str = "id") -> DataFrame:
    """Each update with the status before it and the retry counter after it: failures count up, indexed resets."""
    w = Window.partitionBy(key).orderBy(order)
    old = updates.withColumn("old_status", F.lag("status").over(w))
    era = F.sum((F.col("status") == "indexed").cast("int")).over(w)
    old = old.withColumn("_era", era)
    retry = F.sum((F.col("status") == "failed").cast("long")).over(Window.partitionBy(key, "_era").orderBy(order))
    return old.withColumn("retry_count", retry).drop("_era").withColumn("legal", legal(F.col("old_status"), F.col("status")))


def status_log(moves: DataFrame, key: str = "file", order: str = "id") -> DataFrame:
    """Log rows only where the status or the retry counter changed."""
    before = F.lag("retry_count").over(Window.partitionBy(key).orderBy(order))
    return moves.withColumn("_b", before).where("old_status is null or old_status <> status or _b <> retry_count").select(key, order, "old_status", F.col("status").alias("new_status"), "retry_count")


def retry_candidates(files: DataFrame, now: int, interval: int, grace: int, max_retries: int) -> DataFrame:
    """Failed files whose interval is over, and files stuck in indexing beyond the grace; retries must be left."""
    age = F.lit(now) - F.col("status_updated_at")
    return files.where(((F.col("status") == "failed") & (age > interval) | (F.col("status") == "indexing") & (age > grace)) & (F.col("retry_count") < max_retries))


def status_pivot(files: DataFrame, key: str = "project_guid") -> DataFrame:
    return files.groupBy(key).pivot("status", list(STATUSES)).count().na.fill(0)


def language_inventory(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per project and language: files, indexed files, active and deleted chunks; languages without chunks stay.

    A chunk's language is its file's (project_guid, path); chunks of no file count nowhere.
    """
    f = files.groupBy("project_guid", "programming_language").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "indexed").alias("indexed_files"))
    # by file first: a file's chunks meet its row once
    by = chunks.groupBy("project_guid", "path").agg(F.count_if(F.col("status") == "active").alias("_a"), F.count_if(F.col("status") == "deleted").alias("_d"))
    by = files.select("project_guid", "path", "programming_language").join(by, ["project_guid", "path"])
    c = by.groupBy("project_guid", "programming_language").agg(F.sum("_a").alias("chunks_active"), F.sum("_d").alias("chunks_deleted"))
    return f.join(c, ["project_guid", "programming_language"], "left").na.fill(0)


def state_snapshot(files: DataFrame, chunks: DataFrame, max_retries: int = 3) -> DataFrame:
    """Per project: the last indexing, files failed for good, files in indexing, languages and active chunks."""
    on = F.col("status")
    out = files.groupBy("project_guid").agg(
        F.max(F.when(on == "indexed", F.col("status_updated_at"))).alias("last_indexed"), F.count_if((on == "failed") & (F.col("retry_count") >= max_retries)).alias("permanently_failed"),
        F.count_if(on == "indexing").alias("indexing"), F.count_distinct("programming_language").alias("languages"),
    )
    active = chunks.where("status = 'active'").groupBy("project_guid").agg(F.count(F.lit(1)).alias("active_chunks"))
    return out.join(active, "project_guid", "left").na.fill(0, ["active_chunks"])


def observed_cost(runs: DataFrame, now: int, window_s: int, least_runs: int) -> DataFrame:
    """model, effort, runs, p50_s, p90_s: nearest-rank quantiles of elapsed_ms in the window, seconds rounded up."""
    recent = runs.where((F.col("kind") == "research") & (F.col("created_at") >= now - window_s))
    pick = lambda q: F.ceil(F.get("p", F.lit(q)) / 1000).cast("long")
    return nearest_rank(recent, ["model", "effort"], "elapsed_ms", [0.5, 0.9], "runs").where(F.col("runs") >= least_runs).select("model", "effort", "runs", pick(0).alias("p50_s"), pick(1).alias("p90_s"))


def nearest_rank(values: DataFrame, keys: list[str], column: str, shares: list[float], n: str = "n") -> DataFrame:
    """The keys, the rows and p, an array of nearest-rank quantiles: the least values that ``shares`` of the rows reach.

    Equal values are counted before they are shuffled, and a key's counts are its row: one per distinct value, not per
    row. The mark of a share is 1 at least.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    run = counted.withColumn("_upto", F.sum("_c").over(w.orderBy(column))).withColumn("_n", F.sum("_c").over(w))
    at = [F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_n") * s), F.lit(1)), F.col(column))) for s in shares]
    return run.groupBy(*keys).agg(F.sum("_c").alias(n), F.array(*at).alias("p"))


def linear_histogram(values: DataFrame, column: str, start: float, width: float, n: int) -> DataFrame:
    """le, count: cumulative buckets of equal width; the last one has no bound."""
    return _histogram(values, column, [start + width * i for i in range(n)])


def histogram(values: DataFrame, column: str, start: float, factor: float, n: int) -> DataFrame:
    """le, count: cumulative exponential buckets; the last one has no bound."""
    return _histogram(values, column, [start * factor**i for i in range(n)])


def _histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    n = len(bounds)
    edges = F.array(*[F.lit(b) for b in bounds])
    first = F.size(F.filter(edges, lambda b: b < F.col(column)))
    counts = values.where(F.col(column).isNotNull()).groupBy(first.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    rows = values.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("i"), F.get(edges, F.col("id").cast("int")).alias("le"))
    run = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a row per bucket
    return rows.join(counts, "i", "left").select("le", F.sum(F.coalesce("n", F.lit(0))).over(run).alias("count"))


def prune_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Deleted files of which no chunk is left."""
    return files.where("status = 'deleted'").join(chunks, ["project_guid", "path"], "left_anti")


def gc_phases(files: DataFrame, chunks: DataFrame, log: DataFrame, runs: DataFrame, confirmed: DataFrame, now: int, retention_days: int) -> DataFrame:
    """phase, removed: chunks whose vectors are confirmed gone, then files without chunks, old log rows, expired runs."""
    gone = chunks.where("status = 'deleted'").join(confirmed, "chunk", "left_semi")
    left = chunks.join(gone.select("chunk"), "chunk", "left_anti")
    count = lambda df, k, name: df.agg(F.count(F.lit(1)).alias("removed")).select(F.lit(k).alias("phase"), F.lit(name).alias("name"), "removed")
    old = log.where(F.col("at") < now - retention_days * 86400)
    expired = runs.where(F.col("expires_at") < now)  # a pinned run has no expiry
    return count(gone, 1, "chunks").unionAll(count(prune_files(files, left), 2, "files")).unionAll(count(old, 3, "status_log")).unionAll(count(expired, 4, "research"))


def collection_health(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """project_guid, chunks, vectors, stale: a project unknown to the store is not counted as zero vectors."""
    c = chunks.where("status = 'active'").groupBy("project_guid").agg(F.count(F.lit(1)).alias("chunks"))
    v = vectors.groupBy("project_guid").agg(F.count(F.lit(1)).alias("vectors"))
    return c.join(v, "project_guid", "left").withColumn("stale", F.coalesce(F.col("chunks") != F.col("vectors"), F.lit(False)))


def apply_action(files: DataFrame, selector: Column, action: str) -> DataFrame:
    """Files after cancel, delete or requeue of what the selector picks; changed tells which rows moved.

    Cancel ends files in indexing, delete marks any, requeue resets the retries of failed files and keeps their status.
    """
    on = {"cancel": selector & (F.col("status") == "indexing"), "delete": selector & (F.col("status") != "deleted"), "requeue": selector & (F.col("status") == "failed")}[action]
    status = {"cancel": F.lit("cancelled"), "delete": F.lit("deleted"), "requeue": F.col("status")}[action]
    out = files.withColumn("changed", on)
    if action == "requeue":
        return out.withColumn("retry_count", F.when(on, 0).otherwise(F.col("retry_count")))
    return out.withColumn("status", F.when(on, status).otherwise(F.col("status")))


def pin(runs: DataFrame, selector: Column, pinned: bool, retention: int) -> DataFrame:
    """A pinned run has no expiry; unpinning counts it from its creation."""
    return runs.withColumn("expires_at", F.when(selector, F.lit(None).cast("long") if pinned else F.col("created_at") + retention).otherwise(F.col("expires_at")))


def health(checks: DataFrame, key: str) -> DataFrame:
    """key, verdict: a failed required check is unhealthy, a failed optional one degraded. checks: required, ok."""
    grave = F.max(F.when(F.col("ok"), 0).when(F.col("required"), 2).otherwise(1))
    return checks.groupBy(key).agg(F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("unhealthy")), grave + 1).alias("verdict"))


def probe(asked: DataFrame, files: DataFrame) -> DataFrame:
    """path, state of the asked paths only: removed, in_flight, changed or fresh. asked: path, sha256."""
    f = files.where("status <> 'deleted'").select("path", F.col("sha256").alias("_now"), "status")
    j = asked.join(f, "path", "left")
    return j.select("path", F.when(F.col("_now").isNull(), "removed").when(F.col("status") == "indexing", "in_flight").when(F.col("_now") != F.col("sha256"), "changed").otherwise("fresh").alias("state"))


def load_summary(requests: DataFrame) -> DataFrame:
    """level, requests, errors, wall_s, per_s and nearest-rank p50/p90/p95/p99 of ms; requests: level, started, ms, ok."""
    shares = [0.5, 0.9, 0.95, 0.99]
    out = requests.groupBy("level").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("errors"), (F.max("started") - F.min("started")).alias("wall_s"))
    out = out.join(nearest_rank(requests, ["level"], "ms", shares).drop("n"), "level", "left")
    out = out.select("level", "requests", "errors", "wall_s", *[F.get("p", F.lit(i)).alias(f"p{round(q * 100)}") for i, q in enumerate(shares)])
    return out.withColumn("per_s", F.round(F.col("requests") / F.greatest("wall_s", F.lit(1)), 6))


#: HTTP statuses whose errors are told apart.
TOLD_STATUSES = (429, 499, 500, 503)


def load_figures(requests: DataFrame) -> DataFrame:
    """Per level: requests, files, bytes, chunks, wall_s, chunks_per_s, files_per_s, mb_per_s (2**20 bytes), errors by
    status and the least number of free connections; requests: level, started, ended (ms), status, files, bytes, chunks,
    pool. Rates are null where no time passed."""
    n = lambda on: F.count_if(F.coalesce(on, F.lit(False)))
    out = requests.groupBy("level").agg(
        F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in ("files", "bytes", "chunks")], F.round((F.max("ended") - F.min("started")) / 1000, 3).alias("wall_s"),
        *[n(F.col("status") == s).alias(f"err_{s}") for s in TOLD_STATUSES], n((F.col("status") >= 400) & ~F.col("status").isin(*TOLD_STATUSES)).alias("err_other"), F.min("pool").alias("min_pool"),
    )
    rate = lambda c, digits: F.round(c / F.nullif(F.col("wall_s"), F.lit(0.0)), digits)
    return out.withColumns({"chunks_per_s": rate(F.col("chunks"), 2), "files_per_s": rate(F.col("files"), 2), "mb_per_s": rate(F.col("bytes") / 1048576, 3)})


def confirm_writes(files: DataFrame, done: DataFrame, model: str, now: int) -> DataFrame:
    """Files after terminal writes for ``done`` (project_guid, path), and applied: only files still in indexing end.

    What was cancelled or deleted meanwhile keeps its state; applied is null for files that ``done`` does not name.
    """
    asked = done.select("project_guid", "path", F.lit(True).alias("_asked")).distinct()
    j = files.join(asked, ["project_guid", "path"], "left")
    on = F.coalesce("_asked", F.lit(False)) & (F.col("status") == "indexing")
    out = j.withColumn("applied", F.when(F.col("_asked"), on))
    new = {"embedded_model_id": F.lit(model), "retry_count": F.lit(0), "status_updated_at": F.lit(now), "status": F.lit("indexed")}
    for name, value in new.items():
        old = F.col(name) if name in files.columns else F.lit(None)
        out = out.withColumn(name, F.when(F.coalesce("applied", F.lit(False)), value).otherwise(old))
    return out.drop("_asked")


def stored_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """length of every stored file; no contents are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("length")


def global_counts(files: DataFrame, log: DataFrame, runs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """name, n: projects, status_log, runs, pinned_runs (no expiry) and stale_runs (stale) of the whole database, and with
    ``stored`` (length of each file of it) its bytes."""
    named = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    each = [
        named(files, "projects", F.count_distinct("project_guid")), named(log, "status_log", F.count(F.lit(1))),
        runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("expires_at").isNull()).alias("pinned_runs"), F.count_if("stale").alias("stale_runs")).unpivot([], ["runs", "pinned_runs", "stale_runs"], "name", "n"),
    ]
    out = each[0].unionByName(each[1]).unionByName(each[2])
    return out.unionByName(named(stored, "bytes", F.coalesce(F.sum("length"), F.lit(0)))) if stored is not None else out


def runtime_status(files: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: claims held, files in indexing, and the files of each status as a map."""
    by = files.where("status is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    both = by.unionByName(claims.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("status"), "n"))  # a row per status
    told = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("status").isNotNull(), F.struct("status", "n"))))).alias("files")
    one = both.agg(F.max(F.when(F.col("status").isNull(), F.col("n"))).alias("claims"), told)
    return one.select("claims", F.coalesce(F.col("files")["indexing"], F.lit(0)).alias("indexing"), "files")


def active_runs(runs: DataFrame, now: int) -> DataFrame:
    """Runs that have not ended, the oldest first: id, age_s."""
    return runs.where("ended_at is null").select("id", (F.lit(now) - F.col("started_at")).alias("age_s")).orderBy(F.desc("age_s"), "id")


def response_map(chunks: DataFrame, request: str) -> DataFrame:
    """files: language to path to number of chunks, one row per ``request``; a request names a bounded list of files."""
    per = chunks.groupBy(request, "programming_language", "path").agg(F.count("chunk").alias("n"))
    paths = per.groupBy(request, "programming_language").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "n")))).alias("paths"))
    return paths.groupBy(request).agg(F.map_from_entries(F.collect_list(F.struct("programming_language", "paths"))).alias("files"))


def tally(responses: DataFrame, request: str) -> DataFrame:
    """chunks and too_short (files without any) of each response map."""
    counts = F.flatten(F.transform(F.map_values("files"), F.map_values))
    return responses.select(request, F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n).alias("chunks"), F.size(F.filter(counts, lambda n: n == 0)).cast("long").alias("too_short"))


def drop_reasons(records: DataFrame, rules: dict[str, Column], content: str) -> DataFrame:
    """reason, n, contents: the first rule that holds drops a record; what none drops is kept. One row per reason."""
    reason = F.coalesce(*[F.when(on, name) for name, on in rules.items()], F.lit("kept"))
    return records.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(content).alias("contents"))


def counts_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows of each combination of keys, counted within tasks first: files by status, symbols by project, and so on."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def file_listing(files: DataFrame, chunks: DataFrame, statuses: list[str], language: str | None = None) -> DataFrame:
    """path, status, chunk_count of the files in some statuses, of one language if one is asked; files without chunks count 0."""
    f = files.where(F.col("status").isin(statuses))
    f = f if language is None else f.where(F.col("programming_language") == language)
    c = chunks.where("status = 'active'").groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"))
    return f.join(c, "path", "left").select("path", "status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def list_paths(files: DataFrame, on: Column, limit: int) -> DataFrame:
    """The first ``limit`` paths for which ``on`` holds, and how many there are."""
    hit = files.where(on).select("path")
    total = hit.agg(F.count(F.lit(1)).alias("total"))  # one row
    return hit.orderBy("path").limit(limit).withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def granted(rows: DataFrame, projects: list[str], column: str = "project_guid") -> DataFrame:
    """Rows of the granted projects; dashes and case are ignored on both sides."""
    plain = [p.replace("-", "").lower() for p in projects]
    return rows.where(F.replace(F.lower(column), F.lit("-"), F.lit("")).isin(plain))


def attribute_search(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows of which any of the columns has ``needle``, whatever the case."""
    on = F.lit(False)
    for c in columns:
        on = on | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return rows.where(on)


def query_manifest(queries: DataFrame, key: str) -> DataFrame:
    """Of each set of queries (key, gold_files, overlap_bucket): instances, gold files, and instances by stratum as a map;
    those without a bucket are unbucketed."""
    by = queries.groupBy(key, F.coalesce("overlap_bucket", F.lit("unbucketed")).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.coalesce(F.array_size("gold_files"), F.lit(0))), F.lit(0)).alias("_g"))
    strata = F.map_from_entries(F.array_sort(F.collect_list(F.struct("_s", "_n")))).alias("strata")  # an entry per stratum
    return by.groupBy(key).agg(F.sum("_n").alias("instances"), F.sum("_g").alias("gold_files"), strata)


def artifact_manifest(files: DataFrame, key: str) -> DataFrame:
    """instances, chars, contents and the first hash of each group of artifacts."""
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("instances"), F.sum("n_chars").alias("chars"), F.count_distinct("sha256").alias("contents"), F.min("sha256").alias("first_sha"))


def collection_report(chunks: DataFrame, vectors: DataFrame, collections: DataFrame, classed: Column) -> DataFrame:
    """kind, n: stale projects (their counts differ), orphaned collections (of no known project) and those of another model.

    collections: name, project_guid; ``classed`` tells a collection's class from its name. A project that the store does
    not know is not stale.
    """
    stale = collection_health(chunks, vectors).agg(F.count_if("stale").alias("stale"))
    known = chunks.select("project_guid", F.lit(True).alias("_k")).distinct()
    c = collections.withColumn("_class", classed).join(known, "project_guid", "left")
    other = c.agg(F.count_if(F.col("_k").isNull() | (F.col("_class") == "foreign")).alias("orphaned"), F.count_if(F.col("_k").isNotNull() & (F.col("_class") == "other_model")).alias("other_model"))
    return stale.unpivot([], ["stale"], "kind", "n").unionByName(other.unpivot([], ["orphaned", "other_model"], "kind", "n"))
