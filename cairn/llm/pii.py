"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

The fixed patterns give the seeds. The one and two words before a seed are lexical patterns of its kind. In rounds, a
pattern is scored by the mean score of the distinct instances it stands before (seeds score 1), and an instance that no
fixed pattern found by the noisy-or of its good patterns. What scores high enough is personal data wherever it stands,
and counts beside the seeds when the next round learns its patterns.
Only hashes of values and contexts enter the pattern-instance graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, written so that Java's matcher neither backtracks into a run nor tries its inner starts: the
#: matches are those of the plain patterns, in linear time. Cards below 16 digits fail anyway and are not matched.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Tokens with a digit or an @ may be identifiers.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: So may two or more groups of digits with single blanks between; each match is the longest.
GROUP = r"\(?[0-9]++(?:[()./-]++[0-9]++)*+\)?+(?![^\x20\x09-\x0D.,;!?:)\]\"'-])(?![,:][0-9])"
GROUPS = rf"(?<![^\x20\x09-\x0D(\['\"])(?:{GROUP})(?:\x20{GROUP})++"
ROUNDS, LEAST_SEEDS, GOOD_PATTERN, ACCEPT = 3, 3, 0.5, 0.9
#: Matches that are gathered at a time.
PIECE = 256
SPAN = "struct<k: int, start: int, end: int, value: string, left: string>"


def matches(text: Column, k: int, regex: str) -> Column:
    """Array of SPAN for the matches: code points from 0, end exclusive; left: what stands before, two whole words at least.

    They are those of the text, whatever else matches in them. A word beyond 200 characters is told by its hash.
    """
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

    def context(tail: Column, part: Column) -> Column:
        end, whole = F.right(part, F.lit(60)), F.concat(tail, part)
        last = F.regexp_extract(end, rf"{space}({word}+{space}*)$", 1)
        rest = F.left(whole, F.length(whole) - F.length(last))
        brief = F.when(F.length(whole) <= 200, whole).otherwise(F.concat(F.lit("#"), F.hex(F.xxhash64(rest)), F.lit(" "), last))
        return F.when(end.rlike(rf"{space}{word}+{space}+{word}+{space}*$"), end).otherwise(brief)

    found, parts = F.regexp_extract_all(text, F.lit(regex), 0), F.split(text, regex, -1)
    zipped = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("part"), found.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["hit"])
        left = context(acc["tail"], x["part"])
        span = F.struct(F.lit(k).alias("k"), start.alias("start"), end.alias("end"), x["hit"].alias("value"), left.alias("left"))
        hit = F.when(F.length(x["hit"]) <= 60, x["hit"]).otherwise(F.concat(F.lit("#"), F.hex(F.xxhash64(x["hit"]))))
        tail = F.concat(left, hit)
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    def run(acc: Column, piece: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(piece, zero, step, lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    # an array that grows is copied each time, so it grows within pieces of bounded size: the work stays near-linear
    last = F.floor(F.greatest(F.size(found) - 1, F.lit(0)) / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(zipped, i * PIECE + 1, F.lit(PIECE)))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.aggregate(pieces, zero, run, lambda acc: F.flatten(acc["out"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.reverse(number)

    def weigh(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), weigh), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(span: Column, k: int) -> Column:
    v = span["value"]
    n = F.length(digits(v))
    return (F.lit(True), v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), n.between(16, 19) & luhn(digits(v)), n.between(8, 15))[k]


def checked(text: Column, k: int) -> Column:
    return F.filter(matches(text, k, BASE[k]), lambda s: valid(s, k))


def base_spans(text: Column) -> Column:
    """The valid matches of the fixed patterns, by kind, then start."""
    none, has_digit = F.array().cast(f"array<{SPAN}>"), text.rlike("[0-9]")
    may = (text.contains("@"), has_digit & text.contains("."), has_digit, text.contains("+"))
    return F.concat(*[F.when(may[k], checked(text, k)).otherwise(none) for k in range(len(KINDS))])


def shape(value: Column) -> Column:
    """The kind that an unknown token could be of, or null."""
    n, plain = F.length(digits(value)), value.rlike(r"^[0-9+()./\x20-]+$")
    return (
        F.when(value.rlike("[A-Za-z0-9]@[A-Za-z0-9]"), 0)
        .when(value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 1)
        .when(plain & n.between(13, 19), 2)
        .when(plain & n.between(7, 12), 3)
    )


def candidates(text: Column, base: Column) -> Column:
    """Tokens and spaced groups of a plausible shape, without surrounding punctuation, that touch no base span."""

    def trimmed(s: Column) -> Column:
        v = F.regexp_replace(s["value"], r"^[^A-Za-z0-9+@(]+", "")
        start = s["start"] + F.length(s["value"]) - F.length(v)
        v = F.regexp_replace(v, r"[^A-Za-z0-9]+$", "")
        return F.struct(shape(v).alias("k"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), s["left"].alias("left"))

    none = F.array().cast(f"array<{SPAN}>")
    spaced = F.when(text.rlike(r"[0-9)]\x20[(0-9]"), matches(text, -1, GROUPS)).otherwise(none)
    found = F.filter(F.transform(F.concat(matches(text, -1, CANDIDATE), spaced), trimmed), lambda s: s["k"].isNotNull())
    free = F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return F.when(text.rlike("[0-9@]"), free).otherwise(none)


def contexts(left: Column) -> Column:
    """Hashes of the one and the two words before; digits count as one zero. Null where there is none."""
    words = F.regexp_replace(F.regexp_replace(F.lower(left), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")
    one, two = F.regexp_extract(words, r"([^ ]+) ?$", 1), F.regexp_extract(words, r"(?:^| )([^ ]+ [^ ]+) ?$", 1)
    return F.array(*[F.when(x != "", F.xxhash64(x)) for x in (one, two)])


def hashed(spans: Column, seed: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.lower(s["value"])).alias("value"), F.lit(seed).alias("seed"), contexts(s["left"]).alias("ctx")))


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, good: float = GOOD_PATTERN, accept: float = ACCEPT) -> DataFrame:
    """(k, value) of the instances that patterns establish; occurrences: k, value, seed, ctx (array)."""
    edges = occurrences.select("k", "value", "seed", F.explode("ctx").alias("pattern")).where("pattern is not null")
    edges = settle(edges.groupBy("k", "pattern", "value").agg(F.max("seed").alias("seed")))
    # one that stands before fewer instances is never learned, and one without unknown instances tells nothing
    patterns = edges.groupBy("k", "pattern").agg(F.count_if("seed").alias("n"), F.count_if(~F.col("seed")).alias("unknown"))
    patterns = settle(patterns.where((F.col("n") + F.col("unknown") >= least_seeds) & (F.col("unknown") > 0)))
    unknown = settle(edges.where("not seed").join(patterns.select("k", "pattern"), ["k", "pattern"], "left_semi").select("k", "pattern", "value"))
    scores = unknown.select("k", "value", F.lit(0.0).alias("score")).limit(0)
    for _ in range(rounds):
        reached = unknown.join(scores, ["k", "value"]).groupBy("k", "pattern").agg(F.sum("score").alias("s"), F.count_if(F.col("score") >= accept).alias("accepted"))
        s, accepted = F.coalesce("s", F.lit(0.0)), F.coalesce("accepted", F.lit(0))
        learned = patterns.join(reached, ["k", "pattern"], "left").where(F.col("n") + accepted >= least_seeds)
        learned = learned.select("k", "pattern", ((s + F.col("n")) / (F.col("n") + F.col("unknown"))).alias("p")).where(F.col("p") >= good)
        miss = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12))))
        scores = settle(unknown.join(learned, ["k", "pattern"]).groupBy("k", "value").agg((1 - F.exp(miss)).alias("score")))
    return scores.where(F.col("score") >= accept).select("k", "value")


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans.

    The counts and base_sha256 are those of the fixed patterns; spans has these and what the contexts add (n_found of
    them; of those within one another the longest), as kind:start:end by kind, then start. Null and empty texts have none (empty string). Repeated rows get equal
    results. Only doc_id and the text are read; an empty input gives an empty result.
    """
    text = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = text.withColumn("base", base_spans(F.col("text")))
    seen = seen.select("doc_id", F.xxhash64("text").alias("h"), hashed(F.col("base"), True).alias("base"), hashed(candidates(F.col("text"), F.col("base")), False).alias("more"))
    seen = settle(seen)  # the texts are read once
    each = seen.select("doc_id", "h", F.explode(F.concat("base", "more")).alias("o")).select("doc_id", "h", "o.*")
    new = bootstrap(each)
    found = each.where("not seed").join(new, ["k", "value"]).select("doc_id", "h", "k", "start", "end").distinct()
    # a token within a spaced group that is found itself is told with it
    before = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("end"), "k").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_reach", F.max("end").over(before)).where("_reach is null or _reach < end")
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("k", "start", "end")).alias("found"))
    both = seen.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    name = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.transform("base", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    found = F.coalesce("found", F.array().cast("array<struct<k: int, start: int, end: int>>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return both.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.array_sort(F.concat(base, found))).alias("spans"), F.size(found).cast("long").alias("n_found"), (F.size(base) + F.size(found)).cast("long").alias("n_spans"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
