"""Sinks over Parquet folders: vectors, journals, JSON lines. A keyed change rewrites only the partitions it touches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observe import counted
from ..operators.provenance import insert_runs, run_journal, settle


#: Folders into which the rows of a project fall by the hash of their key; a change rewrites only those it touches.
BUCKETS = 64


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, empty if it isn't there yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int"))


def _rewrite(df: DataFrame, path: str, partition: str) -> None:
    """Replace the folders that ``df`` has rows of. The rows are materialised first, as they come from the same files.

    The change is not atomic: a reader may find a folder between its old and its new files, and after a crash there the
    same change must be applied again, which an upsert or a deletion allows.
    """
    settle(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "_bucket").parquet(path)


def metered(df: DataFrame, write: Callable[[DataFrame], None], **figures: Column) -> dict[str, int]:
    """Write ``df`` and tell rows, millis and the named aggregates of what was written, from the writing pass itself."""
    seen, figures_of = counted(df, rows=F.count(F.lit(1)), **figures)
    began = time.monotonic()
    write(seen)
    return figures_of.get | {"millis": round((time.monotonic() - began) * 1000)}


def read_vectors(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored vectors, in the columns of ``like``; empty where there is no table."""
    schema = like.withColumn("_bucket", F.lit(0))
    return _stored(spark, path, schema).select(like.columns)


def count_vectors(spark: SparkSession, path: str, like: DataFrame, partition: str = "project_guid") -> DataFrame:
    """Vectors of each project; its rows are the list of projects."""
    return read_vectors(spark, path, like).groupBy(partition).agg(F.count(F.lit(1)).alias("vectors"))


def upsert_vectors(new: DataFrame, path: str, key: str = "chunk_guid", partition: str = "project_guid") -> dict[str, int]:
    """Insert or replace by project and key; running it twice changes nothing. Of rows that repeat a key one is stored.

    Tells the rows written, how many of them are new or replaced (``upserted``), and the milliseconds.
    """
    new = settle(_bucketed(new.dropDuplicates([partition, key]), key))
    old = _stored(new.sparkSession, path, new).join(new.select(partition, "_bucket").distinct(), [partition, "_bucket"], "left_semi")
    left, fresh = old.join(new.select(partition, key), [partition, key], "left_anti"), free_column("_fresh", new)
    both = settle(left.withColumn(fresh, F.lit(False)).unionByName(new.withColumn(fresh, F.lit(True))))
    write = lambda df: df.drop(fresh).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "_bucket").parquet(path)
    return metered(both, write, upserted=F.count_if(fresh))


def free_column(stem: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    return next(name for k in range(len(taken) + 1) if (name := f"{stem}{k or ''}").lower() not in taken)


def delete_vectors(gone: DataFrame, path: str, like: DataFrame, key: str = "chunk_guid", partition: str = "project_guid") -> int:
    """Remove keys (project_guid, key) and return how many rows were there; a missing table counts as success.

    A folder that loses all its rows is dropped.
    """
    spark, gone = gone.sparkSession, settle(_bucketed(gone.select(partition, key).distinct(), key))
    old = _stored(spark, path, like.withColumn("_bucket", F.lit(0)))
    touched = settle(old.join(gone.select(partition, "_bucket").distinct(), [partition, "_bucket"], "left_semi"))
    left = settle(touched.join(gone.select(partition, key), [partition, key], "left_anti"))
    hit = touched.count() - left.count()
    if hit:
        _rewrite(left, path, partition)
        folder = lambda df: df.select(partition, "_bucket").distinct()
        for r in folder(touched).join(folder(left), [partition, "_bucket"], "left_anti").collect():  # folders, not rows
            _remove(spark, f"{path}/{partition}={r[0]}/_bucket={r[1]}")
    return hit


def drop_project(spark: SparkSession, path: str, project: str, partition: str = "project_guid") -> None:
    """Drop one project; dropping what is not there is fine."""
    _remove(spark, f"{path}/{partition}={project}")


def _remove(spark: SparkSession, path: str) -> None:
    """Spark has no call that deletes a folder, so the file system that holds it is asked."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def embed_and_upsert(chunks: DataFrame, path: str, embed: Callable[[Column], Column], progress: Callable[[int, int], None] = lambda done, total: None, batches: int = 1, key: str = "chunk_guid", partition: str = "project_guid") -> int:
    """Embed chunks (key, project, code) and upsert their vectors in hashed batches; return the rows stored.

    Each batch is checked: as many rows with a vector as chunks. A batch that fails leaves the ones before it stored, and
    running the whole again changes nothing. ``progress`` hears the cumulative rows and the total.
    """
    chunks = settle(chunks.select(partition, key, "code").dropDuplicates([partition, key]))
    total, done = chunks.count(), 0
    for k in range(batches):
        own = chunks.where(F.pmod(F.xxhash64(F.lit("batch"), F.col(key).cast("string")), F.lit(batches)) == k) if batches > 1 else chunks
        vectors = settle(own.select(partition, key, embed(F.col("code")).alias("embedding")))
        n, whole = own.count(), vectors.where("embedding is not null").count()
        if n != whole:
            raise ValueError(f"batch {k}: {whole} vectors for {n} chunks")
        if n:
            upsert_vectors(vectors, path, key, partition)
            done += n
            progress(done, total)
    return done


def write_journal(stored: Callable[[str], DataFrame], new: dict[str, DataFrame], path: str, retention: int) -> dict[str, dict[str, int]]:
    """Append runs and their children to one folder per table; the replaced challenges' ids to ``superseded``.

    The children come first and the runs last: a run that can be read has all its rows. Tells rows and milliseconds of
    each table.
    """
    out = run_journal({"runs": stored("runs")}, new, retention)
    append = lambda name, df: metered(df, lambda x: x.write.mode("append").parquet(f"{path}/{name}"))
    told = {name: append(name, out[name]) for name in ("citations", "evidence", "turns", "context")}
    told["superseded"] = append("superseded", out["replaced"])
    told["runs"] = append("runs", settle(out["runs"]))
    return told


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The text exposition format, replacing what was there: the samples (name, labels: map, value) of a metric stand
    together under a line of its type (column kind; gauge where there is none), and a last line marks the end."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    line = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    kind = F.coalesce("kind", F.lit("gauge")) if "kind" in metrics.columns else F.lit("gauge")
    samples = metrics.select("name", F.lit(1).alias("_k"), line.alias("value"), kind.alias("_kind"))
    heads = samples.groupBy("name").agg(F.min("_kind").alias("_kind")).select("name", F.lit(0).alias("_k"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "_kind").alias("value"))
    end = metrics.sparkSession.range(1).select(F.lit(None).cast("string").alias("name"), F.lit(2).alias("_k"), F.lit("# EOF").alias("value"))
    rows = samples.drop("_kind").unionByName(heads).unionByName(end)
    # a row per sample: one file is what a scrape reads
    rows.repartition(1).sortWithinPartitions(F.asc_nulls_last("name"), "_k", "value").select("value").write.mode("overwrite").text(path)


def append_journal(runs: DataFrame, path: str, retention: int) -> None:
    """Append new runs (project_guid, created_at, id) with the next numbers of their projects."""
    like = runs.withColumn("seq", F.lit(0).cast("long")).withColumn("expires_at", F.lit(0).cast("long"))
    numbered = insert_runs(_stored(runs.sparkSession, path, like), runs, retention)
    settle(numbered.select(*[F.col(c).cast(t) for c, t in like.dtypes])).write.mode("append").parquet(path)


def write_scores(scores: DataFrame, metrics: list[str], path: str) -> None:
    """The scores of each query as JSON lines under ``path``/per_query, and their means, with n and the label, as one
    object under ``path``/summary. Scores of several labels are an error: they are compared, not averaged."""
    out = scores.agg(F.count_distinct("label").alias("_labels"), F.min("label").alias("label"), F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in sorted(metrics)])
    row = settle(out)
    labels = row.first()["_labels"]
    if labels > 1:
        raise ValueError(f"results carry {labels} labels; score one configuration at a time")
    write_json_lines(scores, f"{path}/per_query")
    row.drop("_labels").coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
