"""Line deduplication with a log-template tree.

The tree has a fixed depth: lines part by their number of tokens, then by their leading tokens. In a leaf, tokens with
digits are variable fields at once; any other token stays fixed where enough of the leaf's lines have it at the same
place, and becomes a field elsewhere. A line whose fixed tokens are too few is its own template. Templates that occur
in enough documents are dropped from all of them. Lines, forms, leaves and templates are compared by 128-bit fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, table

FIELD, SPACES, NOT_SPACE = "<*>", r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Leading tokens that part the lines of one length.
DEPTH = 2
#: Documents in which a template recurs; lines of a leaf that make a token fixed; share of a template's fixed tokens.
MIN_DOCS, SIMILARITY = 10, 0.6


def tokens(line: Column) -> Column:
    """The tokens of a line; those with a digit are fields."""
    split = lambda by: F.array_remove(F.split(line, by), "")
    marked = F.transform(split(SPACES), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    # most lines have neither digits nor white space but blanks: no regular expression splits those
    return F.when(line.rlike(r"[0-9\x09-\x0D]"), marked).otherwise(split(" "))


def print_of(*columns: Column) -> Column:
    """A 128-bit fingerprint: two hashes of different seeds, so that unrelated lines do not meet among all lines."""
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("other seed"), *columns).alias("y"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), i (line from 0), leaf, form (the line's tokens); blank lines are left out."""
    # the hash comes first, so that no line's row carries the whole text
    hashed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    split = hashed.select("doc_id", "h", F.posexplode("lines").alias("i", "line"))
    cut = split.where(F.col("line").rlike(NOT_SPACE)).select("doc_id", "h", "i", tokens(F.col("line")).alias("t"))
    return cut.select("doc_id", "h", "i", print_of(F.size("t"), F.slice("t", 1, DEPTH)).alias("leaf"), F.array_join("t", " ").alias("form"))


def templates(forms: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """f and template (hash) of every distinct form; forms: leaf, f (hash of the form), form, n (its lines)."""
    words = forms.select("leaf", "f", "n", F.posexplode(F.split("form", " ")).alias("p", "token")).withColumn("place", print_of("leaf", "p", "token"))
    fixed = words.where(F.col("token") != FIELD).groupBy("place").agg(F.sum("n").alias("votes")).where(F.col("votes") >= min_docs)
    fixed = settle(fixed.select("place", F.lit(True).alias("fixed")))
    voted = words.join(broadcast_if_small(fixed, fixed.count(), 40), "place", "left")
    part = F.struct("p", F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD)).alias("token"))
    whole = voted.groupBy("leaf", "f").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.avg(F.col("fixed").isNotNull().cast("double")).alias("share"))
    general = F.array_join(F.transform("parts", lambda x: x["token"]), " ")
    return whole.select("f", print_of("leaf", F.when(F.col("share") >= similarity, print_of(general)).otherwise(F.col("f"))).alias("template"))


def kept_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines at the sorted places ``dropped``: the slices between them, so linear in both."""
    lines = F.split(text, "\n")

    def segment(k: Column) -> Column:
        start = F.when(k == 0, 1).otherwise(F.get(dropped, k - 1) + 2)
        end = F.coalesce(F.get(dropped, k), F.size(lines))
        return F.slice(lines, start, end - start + 1)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), segment)), "\n")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (without recurring lines).

    A null text stays null with no lines; an empty text is one blank line. Blank lines are never dropped. Rows that
    repeat id and text count as one document and get equal results. Only the two named columns are read. An empty
    input gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = lines_of(docs)
    placed = settle(lines.select("doc_id", "h", "i", "leaf", print_of("form").alias("f")))  # no text
    leaves = settle(placed.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"))
    # the lines of rare leaves go before any shuffle where the list of leaves is small
    forms = lines.join(broadcast_if_small(leaves, leaves.count(), 40), "leaf", "left_semi").groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("n"))
    forms = settle(forms.withColumn("f", print_of("form")))
    known = settle(templates(forms, min_docs, similarity))
    found = settle(placed.select("doc_id", "h", "i", "f").join(known, "f"))
    # counted within tasks before the shuffle; the join below is of two written tables, so that a hot template is split
    recurring = found.select("doc_id", "h", "template").distinct().groupBy("template").count().where(F.col("count") >= min_docs)
    recurring = settle(recurring.select("template"))
    gone = found.join(broadcast_if_small(recurring, recurring.count(), 40), "template", "left_semi")
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_set("i")).alias("gone"))
    both = docs.withColumn("h", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return both.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept_lines(F.col("text"), F.col("gone"))).alias("text"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, text, line, i, list_transform(list_filter(string_split_regex(line, '{SPACES}'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) AS t FROM l),
p AS (SELECT *, (len(t), t[1:{DEPTH}]) AS leaf, array_to_string(t, ' ') AS form FROM t WHERE len(t) > 0),
leaves AS (SELECT leaf FROM (SELECT DISTINCT doc_id, text, i, leaf FROM p) GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
f AS (SELECT leaf, form, any_value(t) AS t, count(*) AS n FROM p WHERE leaf IN (SELECT leaf FROM leaves) GROUP BY leaf, form),
w AS (SELECT leaf, form, n, unnest(t) AS token, generate_subscripts(t, 1) AS j FROM f),
v AS (SELECT *, token <> '{FIELD}' AND sum(n) OVER (PARTITION BY leaf, j, token) >= {MIN_DOCS} AS fixed FROM w),
m AS (SELECT leaf, form, CASE WHEN avg(fixed::INT) >= {SIMILARITY} THEN string_agg(CASE WHEN fixed THEN token ELSE '{FIELD}' END, ' ' ORDER BY j) ELSE form END AS template FROM v GROUP BY leaf, form),
x AS (SELECT doc_id, text, i, leaf, template FROM p JOIN m USING (leaf, form)),
r AS (SELECT leaf, template FROM (SELECT DISTINCT doc_id, text, leaf, template FROM x) GROUP BY leaf, template HAVING count(*) >= {MIN_DOCS}),
g AS (SELECT DISTINCT doc_id, text, i FROM x JOIN r USING (leaf, template))
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i GROUP BY l.doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
