"""The driver's tables in the roles of an index: files, chunks, queries, rankings. Each has a twin as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table

STATUSES = ("just_uploaded", "indexing", "indexed", "failed", "cancelled", "deleted")
_STATUS = "CASE doc_id % 6 WHEN 0 THEN 'just_uploaded' WHEN 1 THEN 'indexing' WHEN 2 THEN 'indexed' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'deleted' END"
_PATH = "concat('src/', lang, '/', source, '/', cast(doc_id AS STRING), '.md')"

FILES_SQL = f"""files AS (SELECT doc_id, source AS project_guid, {_PATH} AS path, sha256(text) AS sha256, lang AS programming_language,
  {_STATUS} AS status, doc_id % 5 AS retry_count, 1700000000 + doc_id * 60 AS status_updated_at, length(text) AS n_chars FROM documents)"""
#: Three lines of a document are a chunk; one in seven is deleted.
CHUNKS_SQL = f"""lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
chunks AS (SELECT source AS project_guid, lang AS programming_language, {_PATH} AS path, doc_id, (i - 1) // 3 AS n, string_agg(line, chr(10) ORDER BY i) AS code,
  min(i) AS start_line, max(i) AS end_line, CASE WHEN (doc_id + (i - 1) // 3) % 7 = 0 THEN 'deleted' ELSE 'active' END AS status
  FROM lines GROUP BY source, lang, doc_id, (i - 1) // 3)"""
QUERIES_SQL = "queries AS (SELECT item_id AS q, text FROM benchmark)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source").alias("project_guid"), F.expr(_PATH).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("programming_language"),
        F.expr(_STATUS).alias("status"), (F.col("doc_id") % 5).alias("retry_count"), (F.col("doc_id") * 60 + 1700000000).alias("status_updated_at"), F.length("text").cast("long").alias("n_chars"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "source", "lang", F.split("text", "\n").alias("l"))
    each = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3).cast("int")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("l", n * 3 + 1, F.lit(3)), "\n").alias("code"), F.least(n * 3 + 3, F.size("l")).alias("end")))
    flat = rows.select("doc_id", "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.*")
    return flat.select(
        F.col("source").alias("project_guid"), F.col("lang").alias("programming_language"), F.expr(_PATH).alias("path"), "doc_id", F.col("n").cast("long").alias("n"), "code",
        (F.col("n") * 3 + 1).cast("long").alias("start_line"), F.col("end").cast("long").alias("end_line"), F.when((F.col("doc_id") + F.col("n")) % 7 == 0, "deleted").otherwise("active").alias("status"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
