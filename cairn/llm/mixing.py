"""Mixing sources to target weights by capped water-filling.

Targets start in proportion to the weights. Every source whose target exceeds its cap (its words times the largest
number of epochs) is clamped there, and what it cannot take is shared among the others by weight, until none is above.
A target of 2.3 times a source's words takes each document twice and a seeded three tenths of the words a third time:
the documents of least hash, up to the one that crosses the mark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

#: A size is the number of these.
SIZED = r"[^\x20\x09-\x0D]+"
WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Hash ranges into which a source's words are counted before its mark is looked up.
RANGES_HEX = 3


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, SIZED, "x"), r"[^x]+", "")), F.lit(0)).cast("long")


def ranked(df: DataFrame, by: str) -> DataFrame:
    """``df`` with pos: its rows from 0 by code point, null last; range-partitioned, so no task sees all rows."""
    first = F.col(by).asc_nulls_last()
    parts = settle(df.repartitionByRange(first).withColumn("_part", F.spark_partition_id()))
    # one row per partition: bounded by their number
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(first))
    return parts.withColumn("_pos", within).join(F.broadcast(starts), "_part").withColumn("pos", F.col("_start") + F.col("_pos") - 1).drop("_part", "_pos", "_start")


def repeating_weights(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Weights dealt to the sources in turn, by code point, null last."""
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    return ranked(sources, "source").withColumn("weight", pick).drop("pos")


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Append target to (source, source_size, weight). Each round clamps at least one source and sums a small table."""
    cap = F.col("source_size") * epochs
    sources, clamped = settle(sources), F.lit(False)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    share, n_clamped = F.lit(0.0), 0
    while True:
        free = sources.where(~clamped).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("n")).first()
        taken = sources.where(clamped).agg(F.coalesce(F.sum(cap), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("n")).first()
        if not free.w or (n_clamped == taken.n and n_clamped > 0):
            break
        n_clamped = taken.n
        share = (F.col("weight") * F.lit(total - taken.c)).cast("double") / F.lit(float(free.w))
        # the level only rises, so what was clamped stays clamped; the plan stays one comparison deep
        rose = sources.where(share > cap).count()
        clamped = share > cap
        if rose == n_clamped:
            break
    return sources.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, weights: DataFrame | Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, reps, taken, and the columns ``carry``.

    ``weights`` is a table (source, weight) or numbers dealt to the sources in turn. A null source is a source. Null
    and empty texts have size 0 and are taken as often as their source's whole epochs; they add no words. The last
    repetition of a source takes whole documents by seeded hash of the id: a document belongs to it when its middle
    word lies before the mark, so a source misses its target by half a document at most. Ties of the hash go by id,
    then size; repeated rows may differ in taken, never in sum. Reruns agree. Only the named columns are read.
    """
    if not isinstance(weights, DataFrame) and not (weights and all(w > 0 for w in weights)):
        raise ValueError("weights must be positive")
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), h.alias("h"), *carry)
    # the texts are read once; what follows works on this narrow table
    sized = settle(sized.withColumn("range", F.conv(F.substring("h", 1, RANGES_HEX), 16, 10).cast("int")))
    ranges = settle(sized.groupBy("source", "range").agg(F.sum("size").alias("words")))
    sources = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    if isinstance(weights, DataFrame):
        w = weights.select(F.col("source").alias("_source"), F.col("weight").alias("weight"))
        weighed = sources.join(w, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0)))
    else:
        weighed = repeating_weights(sources, weights)
    goal = settle(water_fill(weighed, epochs))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))

    # the range in which a source's mark lies: at most 16**RANGES_HEX sums for each source
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    g = goal.select(F.col("source").alias("_source"), "source_size", "target", "whole", "part")
    same = F.col("source").eqNullSafe(F.col("_source"))
    marks = ranges.withColumn("upto", F.sum("words").over(along)).join(g.select("_source", "part"), same).where(F.col("upto") > F.col("part"))
    # the first range that passes the mark, and the words before it: running sums rise, so both are minima
    marks = marks.groupBy(F.col("_source").alias("_m")).agg(F.min("range").alias("mark"), F.min(F.col("upto") - F.col("words")).alias("before"))
    goal = settle(g.join(marks, F.col("_source").eqNullSafe(F.col("_m")), "left").drop("_m"))

    # not hinted: Spark broadcasts the sources' table if it is small, and splits a hot source's rows if not
    rows = sized.join(goal, same).drop("_source")
    at_mark = F.coalesce(F.col("range") == F.col("mark"), F.lit(False))
    ahead = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    crossing = rows.where(at_mark).withColumn("_end", F.sum("size").over(ahead) + F.col("before"))
    crossing = crossing.withColumn("more", F.col("_end") - F.col("size") + F.col("size") / 2 <= F.col("part")).drop("_end")
    clear = rows.where(~at_mark).withColumn("more", (F.col("part") > 0) & F.coalesce(F.col("range") < F.col("mark"), F.lit(True)))
    out = crossing.unionByName(clear).withColumn("reps", F.col("whole") + F.col("more").cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "reps", (F.col("reps") * F.col("size")).alias("taken"), *carry)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("reps")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SIZED}')), 0) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (  -- by fullness: everything before a source in this order is clamped before it is
  SELECT *, coalesce(sum(source_size * 3) OVER before, 0) AS c0, sum(weight) OVER rest AS w0, sum(source_size) OVER () AS total
  FROM w WINDOW before AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                rest AS (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, weight * (total - c0) > source_size * 3 * w0 AS full_ FROM o),
free AS (SELECT any_value(total) - coalesce(sum(source_size * 3) FILTER (full_), 0) AS rest, sum(weight) FILTER (NOT full_) AS wsum FROM l),
t AS (SELECT source, source_size, CASE WHEN full_ THEN CAST(source_size * 3 AS DOUBLE)
             ELSE CAST(weight * rest AS DOUBLE) / CAST(wsum AS DOUBLE) END AS target FROM l, free),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS part,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS e
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN part > 0 AND e - size + size / 2 <= part THEN 1 ELSE 0 END) AS taken
FROM r
"""
