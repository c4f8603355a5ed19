"""A corpus pipeline of five stages; each one's rows are written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, langid, mixing, ngram_join, sharding
from cairn.llm.common import checkpoint_dir, free_name, remove, settle, table


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, by place, and that column's name, which no other column has. Stages read
    written tables, so every reading numbers alike."""
    row = free_name("_row", docs)
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go: null texts, texts without a letter, texts unlike all languages.

    Each row is judged by its text alone, so repeated rows share their verdict; null ids, labels and sources reject
    nothing. Without any labelled text all rows go. Very long texts are read whole; all columns stay, whatever their
    names. An empty table stays empty. No shuffle of texts.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    return docs.where(~langid.identify(docs, model)["rejected"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at 0.8 or more, exactly one row stays: that of the smallest id.

    Null ids come after all others; of rows that repeat the smallest id the first by place stays. Texts without words
    link to nothing and stay, each row. Very long texts are compared whole; all columns stay, whatever their names. An
    empty table stays empty.
    """
    docs, row = numbered(docs)
    group = ngram_join.ngram_join(docs, id_col=row).select(F.col("doc_id").alias(row), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)).alias("first")
    # rows that link to nothing are their own class; only the others are looked up
    own = group.where(F.col(row) == F.col("class_id")).select(row)
    linked = settle(group.join(group.where(F.col(row) != F.col("class_id")).select("class_id").distinct(), "class_id", "left_semi"))
    best = docs.select("doc_id", row).join(linked, row).groupBy("class_id").agg(first).select(F.col(f"first.{row}").alias(row))
    keep = own.join(linked.select(row), row, "left_anti").unionByName(best)
    return docs.join(keep, row, "left_semi").drop(row)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go, each row by its text alone.

    Null and empty texts stay, whatever their id; repeated rows share their verdict; very long texts are read whole; all
    columns stay, whatever their names; an empty benchmark drops nothing, and an empty table stays empty.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: repeated rows for more than one epoch, none for no epoch.

    A null source is a source of its own. Null and empty texts have no words and are taken as often as their source's
    whole epochs. Rows that repeat an id are taken row by row, so their sum meets the target. Very long texts are
    counted whole; all columns stay, whatever their names. An empty table stays empty.
    """
    docs, row = numbered(docs)
    reps = free_name("_reps", docs)
    taken = mixing.mix(docs, carry=[row]).where("reps > 0").select(row, F.col("reps").cast("int").alias(reps))
    return docs.join(taken, row).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(reps)))).drop(row, reps)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the columns slot and shard; columns of these names are replaced.

    Equal ids share a shard; null ids go where the empty key goes. Every row stays; an empty table stays empty.
    """
    return sharding.place(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: Language models cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, through tables in the shared checkpoint folder; only the last one's stays."""
    docs, base, before = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
