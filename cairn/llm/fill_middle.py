"""Fill-in-the-middle examples: a text is cut at two places between units, and its middle moves to the end.

A grammar of units is a list of neighbouring classes: a unit ends between two characters of which the one before fits
the first class and the one after fits the second. It is translated to a regular expression of lookarounds that matches
the boundary and no character, so that Spark's split keeps every character in some piece. Splitting an empty text gives
one empty piece, so empty texts are handled apart: they have no unit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Grammar = Sequence[tuple[str, str]]
BLANK, NOT_BLANK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Units by name, as (class before, class after) of their boundaries.
GRAMMARS: dict[str, Grammar] = {
    "code_point": ((r"[\s\S]", r"[\s\S]"),),
    "word": ((BLANK, NOT_BLANK),),
    "line": ((r"\n", r"[\s\S]"),),
    "run": (("[A-Za-z]", "[^A-Za-z]"), ("[0-9]", "[^0-9]"), (BLANK, NOT_BLANK), (r"[^A-Za-z0-9\x20\x09-\x0D]", r"[A-Za-z0-9\x20\x09-\x0D]")),
    "identifier_part": (("[a-z0-9]", "[A-Z]"), ("[_-]", "[^_-]"), (BLANK, NOT_BLANK)),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per hundred: examples from this draw on stay plain; of the others those below SPM_BELOW put the suffix first.
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, 1
#: Code points that are split at a time, so that a long text's pieces need not be in memory together.
BLOCK = 1024


def boundary(grammar: Grammar) -> str:
    """The zero-width expression of a grammar's boundaries."""
    if not grammar:
        raise ValueError("a grammar needs a boundary")
    return "|".join(f"(?<={before})(?={after})" for before, after in grammar)


def pieces(text: Column, grammar: Grammar) -> Column:
    """The units of a text; joined they are the text. An empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draw(key: Column, k: int) -> Column:
    """The k-th group (from 1) of eight hex digits of the key's SHA-256, as an unsigned number."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


def _head(blocks: Column, units: Column, per: int, grammar: Grammar) -> Column:
    """The text of the first ``units`` units; all blocks but the last have ``per``."""
    whole = F.floor(units / per).cast("int")
    cut = F.slice(pieces(F.coalesce(F.get(blocks, whole), F.lit("")), grammar), F.lit(1), (units - whole * per).cast("int"))
    return F.concat(F.array_join(F.slice(blocks, F.lit(1), whole), ""), F.array_join(cut, ""))


def fill_middle(
    docs: DataFrame, unit: str | Grammar = "code_point", id_col: str = "doc_id", text_col: str = "text", seed: int | str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_units, middle_units, prefix, middle, suffix, output.

    The cuts and the form come from the SHA-256 of seed and id. A text that is empty (null counts as empty) or holds a
    mark, and one in ``100 - plain_from`` of a hundred, stays plain: the output is the text, prefix, middle, suffix and
    their units are null. Equal ids have equal draws; a null id is drawn as an empty one. Texts of any length are cut;
    with code points, BLOCK of them at a time are in memory as pieces. Repeated rows get equal results; an empty table
    stays empty. Only the id and the text are read, so other columns may have any name. No shuffle.
    """
    grammar = GRAMMARS[unit] if isinstance(unit, str) else tuple(unit)
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    marked = reduce(lambda a, b: a | b, (F.col("text").contains(m) for m in (PREFIX, SUFFIX, MIDDLE)))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= plain_from)
    if grammar == GRAMMARS["code_point"]:  # every place is a boundary, so a text may be taken in blocks
        blocks, per = F.regexp_extract_all("text", F.lit(rf"[\s\S]{{1,{BLOCK}}}"), F.lit(0)), BLOCK
    else:
        blocks, per = F.filter(F.array("text"), lambda b: b != ""), 1 << 30
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[draw(key, k).alias(f"h{k}") for k in range(1, 5)])
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")).withColumn("blocks", blocks)
    rows = rows.withColumn("n", F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.size(pieces(b, grammar))))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = F.col("form") != "plain"
    rows = rows.withColumn("low", F.when(cut, F.least(one, two))).withColumn("high", F.when(cut, F.greatest(one, two)))
    rows = rows.withColumn("prefix", F.when(cut, _head(F.col("blocks"), F.col("low"), per, grammar))).withColumn("upto", F.when(cut, _head(F.col("blocks"), F.col("high"), per, grammar)))
    rows = rows.withColumn("middle", F.substr("upto", F.length("prefix") + 1)).withColumn("suffix", F.substr("text", F.length("upto") + 1))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", F.col("low").alias("prefix_units"), (F.col("high") - F.col("low")).alias("middle_units"), "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone: a cut text holds no mark, so the first of each kind is ours."""
    first, second = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    at = F.instr(rest, first)
    a, rest = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(SUFFIX))
    at = F.instr(rest, second)
    b, middle = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(MIDDLE))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def _sql() -> str:
    h = ", ".join(f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT) AS h{k}" for k in range(1, 5))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, CAST(length(text) AS BIGINT) AS n, {h} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
             WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(text, 1, low) AS p, substr(text, low + 1, high - low) AS m, substr(text, high + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM g
"""


SQL = _sql()
