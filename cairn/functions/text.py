"""Scalar functions over identifiers, paths, messages and spans; all are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and language.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "tsx", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php", "phtml": "php",
    "sh": "bash", "bash": "bash", "html": "html", "htm": "html", "xhtml": "html", "css": "css", "json": "json", "scala": "scala", "sc": "scala", "hs": "haskell", "lhs": "haskell", "ml": "ocaml", "mli": "ocaml", "zig": "zig",
    "sql": "sql", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown",
}
#: Words that have the shape of a name and mean nothing as one.
NOT_NAMES = """
that this with from have will been they there their which would could should when what where while because about after
before other some such than then into over under between during without within your yours does done make made only also
just like more most much many even here does very
""".split()
#: Fixed value: the shape of a dotted name.
IDENT = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def identifiers(text: Column, most: int = 12) -> Column:
    """Names in a text, by first appearance: marked by single backticks as they are, elsewhere only of a name's shape."""
    fences, fence = r"(?s)```[^\n]*\n(.*?)```", r"(?s)```[^\n]*\n.*?```"
    rest = F.regexp_replace(text, fence, " ")
    names = lambda s: F.regexp_extract_all(s, F.lit(IDENT), 0)
    fit = lambda t: F.length(t).between(4, 40) & ~F.lower(t).isin(NOT_NAMES)
    shaped = lambda t: fit(t) & t.rlike(r"_|\.|[a-z0-9][A-Z]")
    inline = F.filter(names(F.array_join(F.regexp_extract_all(rest, F.lit(r"`([^`\n]+)`"), 1), " ")), fit)
    fenced = F.filter(names(F.array_join(F.regexp_extract_all(text, F.lit(fences), 1), " ")), shaped)
    prose = F.filter(names(F.regexp_replace(rest, r"`[^`\n]+`", " ")), shaped)
    return F.slice(F.array_distinct(F.concat(inline, fenced, prose)), 1, most)


def words(text: Column) -> Column:
    """Distinct lower-cased words, camel case cut apart."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z0-9]+"), 0))


def lexical_overlap(query: Column, vocabulary: Column) -> Column:
    """Share of the query's words of over three letters that the vocabulary (array of words) has; 0 without any."""
    q = F.filter(words(query), lambda w: F.length(w) > 3)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, vocabulary)) / F.size(q)).otherwise(0.0)


def overlap_bucket(value: Column) -> Column:
    return F.when(value >= 0.25, "obvious").when(value >= 0.10, "mixed").otherwise("non-obvious")


def title(text: Column, question: Column) -> Column:
    """The first heading, unless there is none or it repeats the question; then the question's first line."""
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#{1,6} +([^\n]*)$", 1)), F.lit(""))
    return F.coalesce(F.nullif(heading, question), F.regexp_extract(question, r"^([^\n]*)", 1))


def collection_class(name: Column, slugs: list[str], active: str, version: str) -> Column:
    """current, other_model, previous or foreign, by ``guid_slug_version`` or the older ``guid_version``."""
    slug = F.regexp_extract(name, r"^[0-9a-f]{32}_([^_]+)_v[0-9]+$", 1)
    ver = F.regexp_extract(name, r"_(v[0-9]+)$", 1)
    return F.when(name.rlike(r"^[0-9a-f]{32}_v[0-9]+$"), "previous").when(~slug.isin(slugs), "foreign").when(ver != version, "previous").when(slug == active, "current").otherwise("other_model")


def normalize_guid(guid: Column) -> Column:
    """Lower case without dashes; null unless 32 hex digits are left."""
    plain = F.replace(F.lower(guid), F.lit("-"), F.lit(""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain)


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_message(message: Column) -> tuple[Column, Column]:
    """Subject (the first paragraph on one line) and body, both without white space at their ends."""
    lines = F.split(F.regexp_replace(message, r"^\n+", ""), r"\r?\n")
    blank = F.array_position(F.transform(lines, lambda x: stripped(x) == ""), True).cast("int")
    head = F.when(blank > 0, blank - 1).otherwise(F.size(lines))
    body = F.when(blank > 0, F.array_join(F.slice(lines, blank + 1, F.size(lines)), "\n")).otherwise("")
    return stripped(F.array_join(F.transform(F.slice(lines, F.lit(1), head), stripped), " ")), stripped(body)


def truncated(subject: Column, body: Column, most: int, marker: str) -> Column:
    """The body cut so that subject, body and marker fit ``most`` UTF-8 bytes; whole where the message fits without one.

    The subject is never cut, and no character is split.
    """
    room = F.greatest(F.lit(most) - F.octet_length(subject) - len(marker.encode()), F.lit(0))
    raw = body.cast("binary")
    # a continuation byte at the cut belongs to a character that began up to three bytes before
    back = F.coalesce(*[F.when(~F.hex(F.substring(raw, room + 1 - k, F.lit(1))).rlike("^[89AB]"), k) for k in range(4)], F.lit(0))
    cut = F.substring(raw, F.lit(1), room - back).cast("string")
    return F.when(F.octet_length(subject) + F.octet_length(body) > most, F.concat(F.when(room >= F.octet_length(body), body).otherwise(cut), F.lit(marker))).otherwise(body)


def title_line(text: Column) -> Column:
    """The first line that is not blank, without white space at its ends; empty without any."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\r?\n"), stripped), lambda x: x != ""), F.lit(0)), F.lit(""))


def shortened(query: Column, least: int = 25, most: int = 200) -> Column:
    """The longest run of whole sentences of ``least`` to ``most`` characters from the start, with the white space that
    ends it; the query where it is no longer than that; else null. A sentence ends after a small letter, a digit or a
    closing bracket."""
    ends = F.regexp_extract_all(F.left(query, F.lit(most + 120)), F.lit(r"(?s).*?(?<=[a-z0-9)\]])[.!?](?:\s|$)"), 0)
    at = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda k: F.length(F.array_join(F.slice(ends, F.lit(1), k), "")))
    best = F.array_max(F.filter(F.when(F.size(ends) > 0, at), lambda n: (n >= least) & (n <= most)))
    return F.when(best.isNotNull(), stripped(F.left(query, best))).when(F.length(query) <= most, stripped(query))


def line_column(text: Column, at: Column) -> tuple[Column, Column]:
    """1-based line and byte column of a character offset (from 0)."""
    before = F.substring(text, F.lit(1), at)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line, F.octet_length(F.element_at(F.split(before, "\n"), -1))


def citations(report: Column) -> Column:
    """Array of struct(path, start, end) for each ``path.ext:start-end`` with a relative path."""
    found = F.regexp_extract_all(report, F.lit(r"[A-Za-z0-9_./-]+\.[A-Za-z0-9]+:[0-9]+-[0-9]+"), 0)
    cut = F.transform(found, lambda c: F.struct(F.regexp_extract(c, r"^(.*):", 1).alias("path"), F.regexp_extract(c, r":([0-9]+)-", 1).cast("int").alias("start"), F.regexp_extract(c, r"-([0-9]+)$", 1).cast("int").alias("end")))
    return F.filter(cut, lambda c: ~c["path"].startswith("/") & ~c["path"].contains("//"))


def leakage(query: Column, gold: Column) -> Column:
    """path, basename or none: whether the query names a gold file."""
    base = lambda p: F.regexp_extract(p, r"([^/]+)$", 1)
    return F.when(F.exists(gold, lambda p: query.contains(p)), "path").when(F.exists(gold, lambda p: query.contains(base(p))), "basename").otherwise("none")


def leakage_stratum(path: Column, basename: Column) -> Column:
    """The stratum of a query by its flags: that it names a gold path, else a gold file's name, else neither."""
    return F.when(path, "path").when(basename, "basename").otherwise("none")


def gold_size(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 4, "3-4").otherwise("5+")


def valid_path(path: Column) -> Column:
    """Relative, not empty, without empty parts, backslashes and ``..``."""
    return (path != "") & ~path.startswith("/") & ~path.contains("//") & ~path.contains("\\") & ~F.array_contains(F.split(path, "/"), "..")


def round_up(value: Column, step: float) -> Column:
    return F.ceil(value / step - 1e-12) * step


def spans_json(spans: Column) -> Column:
    """[[start, end], ...] of an array of struct(start, end)."""
    return F.to_json(F.transform(spans, lambda s: F.array(s["start"], s["end"])))


def spans_of(text: Column) -> Column:
    return F.from_json(text, "array<array<bigint>>")


def eta(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))


def age(seconds: Column) -> Column:
    """The largest unit only: 45s, 12m, 3h, 9d."""
    return F.when(seconds < 60, F.format_string("%ds", seconds)).when(seconds < 3600, F.format_string("%dm", F.floor(seconds / 60))).when(seconds < 86400, F.format_string("%dh", F.floor(seconds / 3600))).otherwise(F.format_string("%dd", F.floor(seconds / 86400)))


def significant(value: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, value).otherwise(F.round(value * scale) / scale)


def flipped(token: Column) -> Column:
    """snake_case as camelCase, camelCase as snake_case, anything else as it is."""
    parts = F.split(token, "_")
    camel = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), ""))
    snake = F.when(token.rlike("[a-z0-9][A-Z]"), F.lower(F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1_$2"))).otherwise(token)
    return F.when(token.contains("_"), camel).otherwise(snake)


def without_vowels(token: Column) -> Column:
    """Vowels after the first letter dropped, unless under three letters would be left."""
    bare = F.concat(F.left(token, F.lit(1)), F.regexp_replace(F.substr(token, F.lit(2)), "[aeiouAEIOU]", ""))
    return F.when(F.length(bare) >= 3, bare).otherwise(token)


def transposed(token: Column, draw: Column) -> Column:
    """Two neighbours inside the name swapped, at a place taken from ``draw``; names under four letters stay."""
    i = draw % F.greatest(F.length(token) - 3, F.lit(1)) + 1
    at = lambda k: F.substr(token, k, F.lit(1))
    return F.when(F.length(token) < 4, token).otherwise(F.concat(F.left(token, i), at(i + 2), at(i + 1), F.substr(token, i + 3)))


def mangled(token: Column, way: Column, draw: Column | None = None) -> Column:
    """A name as a caller might misremember it: the first of three rules, from number ``way`` on, that changes it.

    0: snake to camel or back, 1: inner vowels dropped, 2: two neighbours swapped, by the integer ``draw``.
    """
    rules = F.array(flipped(token), without_vowels(token), transposed(token, (F.lit(0) if draw is None else draw).cast("int")))
    in_turn = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(rules, ((way + k) % 3).cast("int")))
    return F.coalesce(F.get(F.filter(in_turn, lambda x: x != token), F.lit(0)), token)
