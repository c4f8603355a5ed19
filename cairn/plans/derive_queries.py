"""Derivation queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive as D
from ..operators import slicing as S
from ..registry import query, table


@query("doc_slices", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, true AS within, sha256(text) AS sha256 FROM documents WHERE text <> ''")
def doc_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in their order are the text, and keep the token bound."""
    s = D.slice_files(table(spark, sf_dir, "documents")).withColumn("at", F.monotonically_increasing_id())  # a file's windows come in order
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    return s.groupBy("doc_id").agg(F.sum(F.octet_length("code")).alias("bytes"), F.sum(F.length("code")).alias("chars"), (F.max("tokens") <= D.MAX_TOKENS).alias("within"), F.sha2(text, 256).alias("sha256"))


@query("doc_windows")
def doc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.slice_files(table(spark, sf_dir, "documents")).select("doc_id", "start_line", "end_line", "tokens", F.sha2("code", 256).alias("sha256"))


@query("line_windows", r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[^a-z \n]', '', 'g'), '((?:[a-z]+ +){40})', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d), c AS (SELECT doc_id, i, sum(len(regexp_extract_all(x, '[a-z]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM e),
w AS (SELECT doc_id, 1 AS a, max(i) AS b, 0::HUGEINT AS s FROM c WHERE s <= 512 GROUP BY doc_id UNION ALL SELECT w.doc_id, w.b + 1, max(c.i), any_value(p.s) FROM w JOIN c p ON p.doc_id = w.doc_id AND p.i = w.b JOIN c ON c.doc_id = w.doc_id AND c.i > w.b AND c.s <= p.s + 512 GROUP BY w.doc_id, w.b)
SELECT w.doc_id, a::INT AS start_line, b::INT AS end_line, (c.s - w.s)::INT AS tokens FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.b""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over lines of plain words, none blank and none above the bound: as many whole lines as fit."""
    words = F.regexp_replace(F.regexp_replace("text", r"[^a-z \n]", ""), "((?:[a-z]+ +){40})", "$1\n")
    lines = F.filter(F.transform(F.split(words, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return D.slice_files(table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))).drop("code")


@query("markdown_pack")
def markdown_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a block; every fifth is a heading."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 5 == 0, F.concat(F.substring(F.lit("######"), F.lit(1), i % 6 + 1), F.lit(" "))).otherwise(""), x))
    return D.pack_markdown(S.markdown_blocks(d.select("doc_id", F.array_join(lines, "\n\n").alias("text"))).groupBy("doc_id").agg(*_arrays()))


def _arrays() -> list:
    """A document's blocks in order, as arrays."""
    own = F.array_sort(F.collect_list(F.struct("k", "tokens", "level")))
    return [F.transform(own, lambda b: b["tokens"]).alias("tokens"), F.transform(own, lambda b: b["level"]).alias("levels")]


@query("doc_symbols", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN (i + doc_id) % 4 = 0 THEN '  def ' || replace(left(line, 9), ' ', '_') || '():' ELSE line END AS line FROM l)
SELECT doc_id, regexp_extract(line, '^[ \t]*(?:async )?(def|class) +([A-Za-z_][A-Za-z0-9_]*)', 2) AS name, 'def' AS kind, i::INT AS start_line FROM m WHERE regexp_matches(line, '^[ \t]*(?:async )?(def|class) +([A-Za-z_][A-Za-z0-9_]*)')""")
def doc_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that do not parse, so the lines that begin a definition are told."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1 + F.col("doc_id")) % 4 == 0, F.concat(F.lit("  def "), F.replace(F.left(x, F.lit(9)), F.lit(" "), F.lit("_")), F.lit("():"))).otherwise(x))
    return S.symbols(d.select("doc_id", F.array_join(F.array_append(lines, F.lit("1 not Python")), "\n").alias("text")), "python").select("doc_id", "name", "kind", "start_line")


@query("hash_embeddings", "SELECT doc_id, 64 AS dim, true AS unit, count(*) OVER (PARTITION BY text) AS alike FROM documents")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors that are equal where the texts are, and only there."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = table(spark, sf_dir, "documents").select("doc_id", D.embed(F.col("text")).alias("v"))
    v = v.select("doc_id", F.size("v").alias("dim"), (F.abs(length - 1) < 1e-5).alias("unit"), F.sha2(F.to_json("v"), 256).alias("h"))
    return v.join(v.groupBy("h").agg(F.count(F.lit(1)).alias("alike")), "h").drop("h")


@query("page_sections", r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6])[^>]*>', 1)) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM s GROUP BY ALL""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(h[1-6])[^>]*>"), 1)).alias("tag"))
    return s.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


_PROJ = "unnest(['prose', 'ident', 'ident-intent'])"


@query("query_projections", f"WITH p AS (SELECT item_id, text, {_PROJ} AS projection FROM benchmark) SELECT item_id, projection, CASE projection WHEN 'prose' THEN text WHEN 'ident' THEN array_to_string(list_slice(regexp_extract_all(text, '[a-z]{{6,}}'), 1, 12), ' ') ELSE concat('where is ', array_to_string(list_slice(regexp_extract_all(text, '[a-z]{{6,}}'), 1, 3), ' ')) END AS query FROM p")
def query_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit("[a-z]{6,}"), 0)
    each = F.array(
        F.struct(F.lit("prose").alias("projection"), F.col("text").alias("query")),
        F.struct(F.lit("ident").alias("projection"), F.array_join(F.slice(names, 1, 12), " ").alias("query")),
        F.struct(F.lit("ident-intent").alias("projection"), F.concat(F.lit("where is "), F.array_join(F.slice(names, 1, 3), " ")).alias("query")),
    )
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(each).alias("p")).select("item_id", "p.*")
