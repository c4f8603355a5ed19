"""Readers: source trees, index requests, Git logs, JSON lines, CSV results, reStructuredText, diffs.

Schemas are explicit; malformed input fails or is routed aside, it is never guessed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.globs import in_scope, project_glob
from ..functions.text import language_of, split_message

MAX_FILE_BYTES = 16 << 20
RESULT = """schema int, corpus string, language string, instance_id string, datasets array<string>, gold_files array<string>, n_gold int,
category string, leaks_gold_path boolean, leaks_gold_basename boolean, lexical_overlap double, overlap_bucket string,
results array<struct<path: string, score: double, start_line: int, end_line: int>>, n_results int, refusal string, search_ms double"""


def tree_listing(spark: SparkSession, root: str, includes: Sequence[str] = (), excludes: Sequence[str] = (), languages: Sequence[str] = (), most: int = MAX_FILE_BYTES) -> DataFrame:
    """path (relative), at (absolute), length, programming_language, skip of the files in scope; no contents are read.

    skip: unknown (no known language, or one not asked for), too_large, or null for files that are to be read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("at"), "length")
    base = re.escape(root.rstrip("/").rpartition(":")[2].lstrip("/"))
    path = F.regexp_replace("at", f"^(?:[a-z0-9]+:)?/*(?:[^/]+(?=/{base}/))?/*{base}/", "")
    named = files.select(path.alias("path"), "at", "length").withColumn("programming_language", language_of(F.col("path")))
    known = F.col("programming_language").isin(list(languages)) if languages else F.col("programming_language").isNotNull()
    return named.where(in_scope(F.col("path"), includes, excludes)).withColumn("skip", F.when(~F.coalesce(known, F.lit(False)), "unknown").when(F.col("length") > most, "too_large"))


def scan_tree(spark: SparkSession, root: str, includes: Sequence[str] = (), excludes: Sequence[str] = (), languages: Sequence[str] = (), most: int = MAX_FILE_BYTES) -> DataFrame:
    """path (relative), text, sha256, programming_language of the files in scope, whose language is known, up to a size.

    Scope, language and size are decided on the listing, and only what is left is opened. The listing's paths pass the
    driver, where Spark's own file index holds them anyway.
    """
    kept = tree_listing(spark, root, includes, excludes, languages, most).where("skip is null").select("path", "at", "programming_language")
    paths = [r.at for r in kept.select("at").toLocalIterator()]
    if not paths:
        return kept.select("path", F.lit("").alias("text"), F.lit("").alias("sha256"), "programming_language").limit(0)
    read = spark.read.format("binaryFile").load([re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths]).select(F.col("path").alias("at"), "content")
    return read.join(kept, "at").select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"), "programming_language")


def scan_report(listing: DataFrame) -> DataFrame:
    """files, skipped_unknown, skipped_too_large of a listing: one row."""
    return listing.agg(F.count_if(F.col("skip").isNull()).alias("files"), F.count_if(F.col("skip") == "unknown").alias("skipped_unknown"), F.count_if(F.col("skip") == "too_large").alias("skipped_too_large"))


def refs_of(branches: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """name of the refs that patterns pick, in the patterns' order, then by name, each once. branches: name.

    HEAD is itself; a blank pattern picks nothing; a pattern picks branches by whole segments, as Git does.
    """
    asked = [(k, p.strip()) for k, p in enumerate(patterns) if p.strip()]
    out = branches.sparkSession.createDataFrame([(k, p) for k, p in asked if p == "HEAD"], "k int, name string")
    for k, p in asked:
        if p != "HEAD":
            hit = F.col("name").rlike(project_glob(p)) | F.col("name").startswith(p.rstrip("/") + "/")
            out = out.unionByName(branches.where(hit).select(F.lit(k).alias("k"), "name"))
    return out.groupBy("name").agg(F.min("k").alias("k")).orderBy("k", "name").select("name")


def gitignore_globs(folder: str, text: str) -> tuple[list[str], list[str]]:
    """(globs of what a .gitignore excludes, notes on lines that have no glob), when a plan is made.

    Patterns are relative to ``folder``; one without an inner slash fits at any depth, one that ends in a slash only
    folders. Globs have no negation: a ``!`` line disarms the globs before it that could cover what it brings back.
    """
    globs: list[str] = []
    notes: list[str] = []
    base = f"{folder}/" if folder else ""
    for line in (raw.rstrip() for raw in text.splitlines()):
        pattern = line.removeprefix("!")
        if not line or line.startswith("#"):
            continue
        if "\\" in pattern or re.search(r"\[(?![^\]]+\])", pattern):
            notes.append(f"{line}: not translated")
            continue
        name, folders_only = pattern.rstrip("/"), pattern.endswith("/")
        anchored = "/" in name
        at = base + name.lstrip("/") if anchored else f"{base}**/{name}"
        own = [f"{at}/**"] if folders_only else [at, f"{at}/**"]
        if not line.startswith("!"):
            globs += own
            continue
        back = (base + name.lstrip("/")) if anchored else f"{base}x/{name}"
        fits = lambda g, path: re.search(project_glob(g).replace(r"\z", "$"), path)
        covers = lambda g: fits(g, back.replace("*", "x")) or fits(g, back.replace("*", "x") + "/x") or g.rpartition("/")[2] == name
        gone = [g for g in globs if covers(g)]
        globs = [g for g in globs if g not in gone]
        notes.append(f"{line}: switched off {', '.join(gone) or 'nothing'}")
    return list(dict.fromkeys(globs)), notes


def index_requests(spark: SparkSession, path: str) -> DataFrame:
    """programming_language, path, text from requests ``{"files": {language: {path: {"code": ...}}}}``, one per line."""
    df = spark.read.schema("files map<string, map<string, struct<code: string>>>").option("mode", "FAILFAST").json(path)
    by = df.select(F.explode("files").alias("programming_language", "_f")).select("programming_language", F.explode("_f").alias("path", "_c"))
    return by.select("programming_language", "path", F.col("_c.code").alias("text"))


#: ``git log -z --raw --format=...``: records begin with 0x1E, fields end with 0x1F, paths are NUL-separated.
def git_log(spark: SparkSession, path: str) -> DataFrame:
    """sha, author_name, author_email, authored_at, committed_at, parent_count, subject, body, paths (array of struct).

    A raw entry ``:modes hashes STATUS`` is followed by one path, by two for renames and copies; the entries are cut at
    their colons, so no state runs along the block.
    """
    rec = spark.read.option("lineSep", "\x1e").text(path).where(F.length(F.trim("value")) > 0)
    f = F.split("value", "\x1f")
    get = lambda i: F.get(f, F.lit(i))
    subject, body = split_message(get(6))
    blocks = F.filter(F.split(F.coalesce(get(7), F.lit("")), r"(?:^|\x00|\n)(?=:[0-7]{6} )"), lambda b: b.rlike(r"^:[0-7]{6} "))

    def entry(b: Column) -> Column:
        parts = F.split(b, "\x00")
        letter = F.regexp_extract(F.get(parts, F.lit(0)), r" ([AMDRCT])[0-9]*$", 1)
        two = letter.isin("R", "C")
        kind = F.create_map(*[F.lit(x) for kv in {"A": "added", "M": "modified", "T": "modified", "D": "deleted", "R": "renamed", "C": "copied"}.items() for x in kv])[letter]
        name = F.when(two, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
        return F.struct(name.alias("path"), kind.alias("change_type"), F.when(two, F.get(parts, F.lit(1))).alias("old_path"))

    parents = F.when(F.trim(get(5)) == "", 0).otherwise(F.size(F.split(F.trim(get(5)), " ")))
    return rec.select(
        F.trim(get(0)).alias("sha"), get(1).alias("author_name"), get(2).alias("author_email"), get(3).cast("long").alias("authored_at"), get(4).cast("long").alias("committed_at"),
        parents.alias("parent_count"), subject.alias("subject"), body.alias("body"), F.transform(blocks, entry).alias("paths"),
    )


#: The beginnings of generated merge subjects, the longest message in bytes, and the mark of a cut one.
MERGE_SUBJECTS = ("Merge branch ", "Merge pull request ", "Merge remote-tracking branch ", "Merge tag ")
MAX_MESSAGE_BYTES = 64 * 1024
CUT_MESSAGE = "\n\n[… commit message truncated …]"


def kept_commits(commits: DataFrame, now: int, days: int | None, most: int, least_bytes: int, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Commits with a reason ``drop`` (null: kept) and ``cut`` (whether the message is cut to MAX_MESSAGE_BYTES).

    age: committed more than ``days`` before ``now``; count: not among the newest ``most`` of the rest, whatever happens
    to these; message: subject and body have fewer than ``least_bytes`` bytes; merge: several parents, a blank body and
    a generated subject; scope: it has paths, and none is in scope. A commit without paths, as merges are, stays. Kept
    commits keep the paths in scope only.
    """
    old = F.col("committed_at") < now - days * 86400 if days is not None else F.lit(False)
    order = F.struct((-F.col("committed_at")).cast("long").alias("at"), "sha")
    # the place of the last one within the bound: a row, whatever the number of commits
    last = commits.where(~old).select(order.alias("_o")).orderBy("_o").limit(most).agg(F.max("_o").alias("o")).first().o
    beyond = order > F.struct(F.lit(last[0]).cast("long").alias("at"), F.lit(last[1]).cast(commits.schema["sha"].dataType).alias("sha")) if last else F.lit(True)
    paths = F.coalesce("paths", F.array().cast(commits.schema["paths"].dataType))
    own = F.filter(paths, lambda p: in_scope(p["path"], includes, excludes))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    size = F.octet_length(blank("subject")) + F.octet_length(blank("body"))
    generated = reduce(lambda a, b: a | b, (F.ltrim(blank("subject")).startswith(m) for m in MERGE_SUBJECTS))
    drop = (
        F.when(old, "age")
        .when(beyond, "count")
        .when(size < least_bytes, "message")
        .when((F.col("parent_count") > 1) & (T.stripped(blank("body")) == "") & generated, "merge")
        .when((F.size(paths) > 0) & (F.size(own) == 0), "scope")
    )
    out = commits.withColumn("drop", drop)
    kept = F.col("drop").isNull()
    out = out.withColumn("cut", kept & (size > MAX_MESSAGE_BYTES)).withColumn("paths", F.when(kept, own).otherwise(F.col("paths")))
    return out.withColumn("body", F.when(F.col("cut"), T.truncated(blank("subject"), blank("body"), MAX_MESSAGE_BYTES, CUT_MESSAGE)).otherwise(F.col("body")))


def deletion_window(now: int, days: int | None) -> int | None:
    """From when on a walk of ``days`` may have commits removed: a day earlier than it looked, null for a whole walk."""
    return None if days is None else now - (days + 1) * 86400


def drop_counts(kept: DataFrame) -> DataFrame:
    """drop, n: what each rule dropped; null is what is left, and cut those of these whose message was cut."""
    by = kept.groupBy("drop").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(kept.where("cut").groupBy(F.lit("cut").alias("drop")).agg(F.count(F.lit(1)).alias("n")))


def json_lines(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """One object per line; blank lines are skipped, broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_results(spark: SparkSession, path: str, numbers: Sequence[str]) -> DataFrame:
    """Strings with ``NA`` as null, ``numbers`` as doubles, repeated rows (but for their file) once."""
    df = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    df = df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in numbers else F.col(c) for c in df.columns], F.input_file_name().alias("source_file"))
    return df.dropDuplicates([c for c in df.columns if c != "source_file"])


def with_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each name: the one column over the other, null where that is 0."""
    return df.withColumns({name: F.col(a) / F.nullif(F.col(b), F.lit(0)) for name, (a, b) in ratios.items()})


def config_signature(columns: Sequence[str]) -> Column:
    """``name=value`` of the columns that a configuration is told by, in their order; nulls stand as such."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in columns])


#: The underline of a reST title, and a directive.
RST_UNDERLINE = r"^([=\-`:'\"~^_*+#<>])\1{1,}\s*$"
RST_DIRECTIVE = r"^\.\.\s+([a-zA-Z][a-zA-Z0-9_-]*)::\s*(.*)$"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def rst_sections(docs: DataFrame) -> DataFrame:
    """doc_id, n, level, title, body, context: sections by underlined titles, from level 0; a document's underline
    characters rank by first use. context: the last module that a directive set before the section's end.

    A title begins without a blank and is no longer than what underlines it, two characters or more. An underline is
    not a title itself, so of lines that each underline the one before every second is a title.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", LINE_END)).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    under = F.lead("line").over(w)
    may = (T.stripped(F.col("line")) != "") & ~F.col("line").startswith(" ") & under.rlike(RST_UNDERLINE) & (F.length(T.stripped(under)) >= F.length(T.stripped(F.col("line"))))
    marked = lines.withColumn("_may", F.coalesce(may, F.lit(False))).withColumn("_under", under)
    before = F.coalesce(F.last(F.when(~F.col("_may"), F.col("i")), ignorenulls=True).over(w), F.lit(-1))
    marked = marked.withColumn("mark", F.when(F.col("_may") & ((F.col("i") - before) % 2 == 1), F.substring("_under", 1, 1)))
    plain = T.stripped(F.col("line"))
    module = F.when(F.regexp_extract(plain, RST_DIRECTIVE, 1).isin("module", "currentmodule"), F.nullif(T.stripped(F.regexp_extract(plain, RST_DIRECTIVE, 2)), F.lit("")))
    marked = marked.withColumn("n", F.count("mark").over(w)).withColumn("_context", F.last(module, ignorenulls=True).over(w)).where("n > 0")
    context = marked.groupBy("doc_id", "n").agg(F.max_by("_context", "i").alias("context"))
    order = marked.where("mark is not null").groupBy("doc_id", "mark").agg(F.min("i").alias("first"))
    order = order.withColumn("level", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1)
    heads = marked.where("mark is not null").join(order, ["doc_id", "mark"]).select("doc_id", "n", "level", T.stripped(F.col("line")).alias("title"), F.col("i").alias("_at"))
    body = marked.join(heads.select("doc_id", "n", "_at"), ["doc_id", "n"]).where(F.col("i") > F.col("_at") + 1)
    text = body.groupBy("doc_id", "n").agg(T.stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")).alias("body"))
    return heads.join(text, ["doc_id", "n"], "left").join(context, ["doc_id", "n"]).select("doc_id", "n", "level", "title", F.coalesce("body", F.lit("")).alias("body"), "context")


def diff_paths(patches: DataFrame) -> DataFrame:
    """id, path, existed for the files of unified diffs (id, patch)."""
    lines = patches.select("id", F.posexplode(F.split("patch", "\n")).alias("i", "line"))
    before = F.lag("line").over(Window.partitionBy("id").orderBy("i"))
    heads = lines.withColumn("_b", before).where(F.col("line").startswith("+++ ") & F.col("_b").startswith("--- "))
    name = lambda c: F.regexp_replace(F.regexp_extract(c, r"^(?:---|\+\+\+) ([^\t]+)", 1), "^[ab]/", "")
    old, new = name(F.col("_b")), name(F.col("line"))
    return heads.select("id", F.when(new == "/dev/null", old).otherwise(new).alias("path"), (old != "/dev/null").alias("existed")).distinct()
