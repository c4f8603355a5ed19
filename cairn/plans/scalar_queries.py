"""Queries over scalar functions: names, words, paths, titles, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions import globs as G
from ..functions import text as T
from ..operators import lifecycle as L
from ..registry import query, table
from .standins import CHUNKS_SQL, FILES_SQL, QUERIES_SQL, chunks, files, queries

_NOT = ", ".join(f"'{w}'" for w in T.NOT_NAMES)
#: Languages and their extensions.
_LANGS = """WHEN ext = 'rs' THEN 'rust' WHEN ext IN ('py', 'pyw') THEN 'python' WHEN ext IN ('js', 'mjs', 'cjs', 'jsx') THEN 'javascript' WHEN ext IN ('ts', 'mts', 'cts') THEN 'typescript' WHEN ext IN ('c', 'h') THEN 'c'
WHEN ext IN ('cpp', 'cc', 'cxx', 'hpp', 'hxx', 'hh') THEN 'cpp' WHEN ext = 'cs' THEN 'csharp' WHEN ext = 'rb' THEN 'ruby' WHEN ext IN ('php', 'phtml') THEN 'php' WHEN ext IN ('sh', 'bash') THEN 'bash' WHEN ext IN ('html', 'htm', 'xhtml') THEN 'html'
WHEN ext IN ('scala', 'sc') THEN 'scala' WHEN ext IN ('hs', 'lhs') THEN 'haskell' WHEN ext IN ('ml', 'mli') THEN 'ocaml' WHEN ext IN ('yaml', 'yml') THEN 'yaml' WHEN ext IN ('md', 'markdown') THEN 'markdown' WHEN ext IN ('tsx', 'go', 'java', 'css', 'json', 'zig', 'sql', 'toml') THEN ext"""
_EXTS = ", ".join(f"'{x}'" for x in [*T.LANGUAGES, "exe", "tar.gz", ""])
_MARKED = "concat('`', split_part(text, ' ', 2), '` and ', replace(text, ' th', '_th'), ' fooBar x.y ', chr(10), '```py', chr(10), 'some_name plain', chr(10), '```')"


@query("language_detect", f"WITH f AS (SELECT doc_id, concat('a.b/f', doc_id, CASE WHEN e = '' THEN '' ELSE '.' || e END) AS path FROM (SELECT doc_id, ([{_EXTS}])[1 + doc_id % {len(T.LANGUAGES) + 3}] AS e FROM documents)) SELECT doc_id, path, CASE {_LANGS} END AS language FROM (SELECT *, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext FROM f)")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = F.array(*[F.lit(x) for x in [*T.LANGUAGES, "exe", "tar.gz", ""]])
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(exts, (F.col("doc_id") % (len(T.LANGUAGES) + 3) + 1).cast("int")).alias("e"))
    d = d.select("doc_id", F.concat(F.lit("a.b/f"), "doc_id", F.when(F.col("e") == "", "").otherwise(F.concat(F.lit("."), "e"))).alias("path"))
    return d.withColumn("language", T.language_of(F.col("path")))


@query("identifiers", f"""WITH m AS (SELECT doc_id, {_MARKED} AS t FROM documents), r AS (SELECT doc_id, t, regexp_replace(t, '(?s)```[^\\n]*\\n.*?```', ' ', 'g') AS rest FROM m),
i AS (SELECT doc_id, list_filter(regexp_extract_all(array_to_string(regexp_extract_all(rest, '`([^`\\n]+)`', 1), ' '), '{T.IDENT}'), lambda t: length(t) BETWEEN 4 AND 40 AND NOT list_contains([{_NOT}], lower(t))) AS a,
list_filter(regexp_extract_all(array_to_string(regexp_extract_all(t, '(?s)```[^\\n]*\\n(.*?)```', 1), ' '), '{T.IDENT}'), lambda t: length(t) BETWEEN 4 AND 40 AND NOT list_contains([{_NOT}], lower(t)) AND regexp_matches(t, '_|\\.|[a-z0-9][A-Z]')) AS b,
list_filter(regexp_extract_all(regexp_replace(rest, '`[^`\\n]+`', ' ', 'g'), '{T.IDENT}'), lambda t: length(t) BETWEEN 4 AND 40 AND NOT list_contains([{_NOT}], lower(t)) AND regexp_matches(t, '_|\\.|[a-z0-9][A-Z]')) AS c FROM r),
u AS (SELECT doc_id, unnest(list_concat(a, b, c)) AS x, generate_subscripts(list_concat(a, b, c), 1) AS k FROM i), g AS (SELECT doc_id, x, min(k) AS k FROM u GROUP BY ALL)
SELECT m.doc_id, coalesce(list_slice((SELECT list(x ORDER BY k) FROM g WHERE g.doc_id = m.doc_id), 1, 12), []) AS names FROM m""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.expr(_MARKED.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "documents").select("doc_id", T.identifiers(marked).alias("names"))


@query("lexical_overlap", f"""WITH {QUERIES_SQL}, w AS (SELECT q, list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')), lambda x: length(x) > 3) AS w FROM queries),
v AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')) AS v FROM documents),
o AS (SELECT doc_id, q, CASE WHEN len(w) > 0 THEN round(len(list_intersect(w, v)) / len(w), 6) ELSE 0 END AS overlap FROM w JOIN v ON q = doc_id % 40) SELECT *, CASE WHEN overlap >= 0.25 THEN 'obvious' WHEN overlap >= 0.1 THEN 'mixed' ELSE 'non-obvious' END AS bucket FROM o""")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("q"), T.words(F.col("text")).alias("v"))
    o = v.join(queries(spark, sf_dir), "q").select("doc_id", "q", F.round(T.lexical_overlap(F.col("text"), F.col("v")), 6).alias("overlap"))
    return o.withColumn("bucket", T.overlap_bucket(F.col("overlap")))


@query("title_fallback", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '## ' || text WHEN doc_id % 3 = 1 THEN text || chr(10) || '# ' || lang ELSE text END AS t, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source || chr(10) || 'more' END AS q FROM documents),
h AS (SELECT doc_id, q, nullif(nullif(trim(regexp_extract(t, '(?m)^#{1,6} +([^\\n]*)$', 1), ' '), ''), q) AS h FROM d) SELECT doc_id, coalesce(h, regexp_extract(q, '^([^\\n]*)', 1)) AS title FROM h""")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## "), "text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\n# "), "lang")).otherwise(F.col("text"))
    return d.select("doc_id", T.title(text, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.concat("source", F.lit("\nmore")))).alias("title"))


_NAMES = "CASE doc_id % 6 WHEN 0 THEN concat(md5(text), '_qwen_v3') WHEN 1 THEN concat(md5(text), '_bge_v3') WHEN 2 THEN concat(md5(text), '_qwen_v2') WHEN 3 THEN concat(md5(text), '_v1') WHEN 4 THEN concat(md5(text), '_other_v3') ELSE 'x_v3' END"


@query("collection_class", f"""WITH n AS (SELECT doc_id, {_NAMES} AS name FROM documents) SELECT doc_id, CASE WHEN regexp_matches(name, '^[0-9a-f]{{32}}_v[0-9]+$') THEN 'previous' WHEN regexp_extract(name, '^[0-9a-f]{{32}}_([^_]+)_v[0-9]+$', 1) NOT IN ('qwen', 'bge') THEN 'foreign'
WHEN regexp_extract(name, '_(v[0-9]+)$', 1) <> 'v3' THEN 'previous' WHEN name LIKE '%\\_qwen\\_v3' ESCAPE '\\' THEN 'current' ELSE 'other_model' END AS class FROM n""")
def collection_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collection_class(F.expr(_NAMES), ["qwen", "bge"], "qwen", "v3").alias("class"))


@query("path_scope", f"WITH {FILES_SQL} SELECT path, regexp_matches(path, '^src/[^/]*/src1/') AND NOT regexp_matches(path, '5\\.md$') AS in_scope, regexp_matches(path, '^src/(en|fr)/[^/]*/[^/]*\\.md$') AS plain, regexp_matches(path, '^src/([^/]+/)*[^/]*[02468]\\.md$') AS whole FROM files")
def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    plain = p.rlike(G.plain_glob("src/en/*/*.md")) | p.rlike(G.plain_glob("src/fr/*/*.md"))
    return files(spark, sf_dir).select("path", G.in_scope(p, ["src/*/src1/**"], ["**/*5.md"]).alias("in_scope"), plain.alias("plain"), p.rlike(G.path_glob("src/**/*[02468].md")).alias("whole"))


@query("normalize_guid", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE md5(text) END AS guid FROM documents")
def normalize_guid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.upper(F.md5("text"))
    dashed = F.concat_ws("-", F.substring(g, 1, 8), F.substring(g, 9, 4), F.substring(g, 13, 20))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_guid(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), g)).otherwise(dashed)).alias("guid"))


@query("commit_message_split", """WITH m AS (SELECT doc_id, trim(replace(text, '. ', chr(10) || chr(10)), ' ') AS t FROM documents), p AS (SELECT doc_id, t, regexp_extract(t, '(?s)^(.*?)(\\n[ \\t]*\\n|$)', 1) AS head FROM m)
SELECT doc_id, trim(regexp_replace(head, '[ \\t]*\\n[ \\t]*', ' ', 'g'), ' ') AS subject FROM p""")
def commit_message_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.split_message(F.replace("text", F.lit(". "), F.lit("\n\n")))[0].alias("subject"))


@query("line_column", "SELECT doc_id, 1 + length(left(text, 200)) - length(replace(left(text, 200), chr(10), '')) AS line, strlen(string_split(left(text, 200), chr(10))[-1]) AS column_bytes FROM documents")
def line_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, column = T.line_column(F.col("text"), F.lit(200))
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line"), column.alias("column_bytes"))


_REPORT = "concat('see src/', lang, '/a_', cast(doc_id AS STRING), '.rs:', cast(doc_id % 50 AS STRING), '-', cast(doc_id % 50 + 9 AS STRING), ', /abs/x.py:1-2 and a//b.c:3-4; docs/', source, '.md:7-8.')"


@query("citation_grammar", "SELECT doc_id, unnest([0, 1])::INT AS ord, unnest(['src/' || lang || '/a_' || doc_id || '.rs', 'docs/' || source || '.md']) AS path, unnest([doc_id % 50, 7])::INT AS \"start\", unnest([doc_id % 50 + 9, 8])::INT AS \"end\" FROM documents")
def citation_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.citations(F.expr(_REPORT))).alias("ord", "c"))
    return d.select("doc_id", "ord", "c.*")


@query("leakage_flags", f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN contains(q, path) THEN 'path' WHEN contains(q, regexp_extract(path, '[^/]*$')) THEN 'basename' ELSE 'none' END AS leakage FROM (SELECT doc_id, path, CASE doc_id % 3 WHEN 0 THEN 'in ' || path WHEN 1 THEN 'in ' || doc_id || '.md' ELSE 'nothing' END AS q FROM files)")
def leakage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat("doc_id", F.lit(".md"))
    q = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("in "), "path")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("in "), base)).otherwise("nothing")
    return files(spark, sf_dir).select("doc_id", T.leakage(q, F.array("path")).alias("leakage"))


@query("validation_rejects", f"WITH {FILES_SQL}, b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/' || path WHEN 1 THEN replace(path, 'src/', 'src//') ELSE path END AS path, CASE WHEN doc_id % 7 = 0 THEN left(sha256, 63) ELSE sha256 END AS sha FROM files) SELECT doc_id, NOT (path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, '//') AND NOT contains(path, '\\')) AS bad_path, NOT regexp_matches(sha, '^[0-9a-fA-F]{{64}}$') AS bad_sha FROM b WHERE doc_id % 5 < 2 OR doc_id % 7 = 0")
def validation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/"), "path")).when(F.col("doc_id") % 5 == 1, F.replace("path", F.lit("src/"), F.lit("src//"))).otherwise(F.col("path"))
    b = files(spark, sf_dir).select("doc_id", p.alias("path"), F.when(F.col("doc_id") % 7 == 0, F.left("sha256", F.lit(63))).otherwise(F.col("sha256")).alias("sha"))
    v = b.select("doc_id", (~T.valid_path(F.col("path"))).alias("bad_path"), (~F.col("sha").rlike("^[0-9a-fA-F]{64}$")).alias("bad_sha"))
    return v.where("bad_path or bad_sha")


@query("spans_roundtrip", "SELECT l_orderkey AS run, count(*) AS spans, sum(l_partkey % 50 + l_partkey % 50 + 8)::BIGINT AS total FROM lineitem GROUP BY 1")
def spans_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct((F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + 8).alias("end"))
    j = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(T.spans_json(F.collect_list(s)).alias("j"))
    each = F.aggregate(T.spans_of(F.col("j")), F.lit(0).cast("long"), lambda a, x: a + x[0] + x[1])
    return j.select("run", F.size(T.spans_of(F.col("j"))).cast("long").alias("spans"), each.alias("total"))


@query("eta_format", "SELECT event_id, CASE WHEN s >= 3600 THEN format('{}h{:02d}m', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{}m{:02d}s', s // 60, s % 60) ELSE format('{}s', s) END AS eta FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def eta_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.eta(F.col("event_id") * 7 % 9000).alias("eta"))


@query("query_manifest", """WITH q AS (SELECT o_orderpriority AS name, o_orderkey % 4 AS g, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 < 3 THEN 'obvious' ELSE 'mixed' END AS bucket FROM orders),
s AS (SELECT name, coalesce(bucket, 'unbucketed') AS bucket, count(*) AS n, sum(g) AS g FROM q GROUP BY ALL) SELECT name, sum(n)::BIGINT AS instances, sum(g)::BIGINT AS gold_files, string_agg(bucket || '=' || n, ',' ORDER BY bucket) AS strata FROM s GROUP BY name""")
def query_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 5
    gold = F.filter(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda x, i: i < F.col("o_orderkey") % 4)
    m = L.query_manifest(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), gold.alias("gold_files"), F.when(k == 0, None).when(k < 3, "obvious").otherwise("mixed").alias("overlap_bucket")), "name")
    return m.withColumn("strata", F.array_join(F.transform(F.map_entries("strata"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("artifact_manifest", f"WITH {FILES_SQL} SELECT programming_language, count(*) AS instances, sum(n_chars)::BIGINT AS chars, count(DISTINCT sha256) AS contents, min(sha256) AS first_sha FROM files GROUP BY 1")
def artifact_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.artifact_manifest(files(spark, sf_dir), "programming_language")


@query("response_maps", f"WITH {CHUNKS_SQL} SELECT programming_language, count(DISTINCT path) AS files, count(*) AS chunks FROM chunks WHERE status = 'active' GROUP BY 1")
def response_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per file; the nested map of a response is a projection of it for one request's files."""
    per = chunks(spark, sf_dir).where("status = 'active'").groupBy("programming_language", "path").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("programming_language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"))


@query("event_payload", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type FROM events")
def event_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "event_type")


@query("row_access", f"WITH {FILES_SQL} SELECT doc_id, path FROM files WHERE project_guid IN ('src1', 'src4')")
def row_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level scope: the granted projects, dashes and case ignored."""
    return L.granted(files(spark, sf_dir), ["SRC-1", "src4"]).select("doc_id", "path")


@query("min_doc_frequency", f"""WITH {QUERIES_SQL}, n AS (SELECT DISTINCT q, unnest(regexp_extract_all(lower(text), '[a-z]{{7,}}')) AS name FROM queries), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{7,}}')) AS name FROM documents),
f AS (SELECT name, count(*) AS df FROM d GROUP BY name) SELECT q, count(df) AS present, min(df) AS ident_df_min FROM n LEFT JOIN f USING (name) GROUP BY q""")
def min_doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda df, k: df.select(k, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), 0))).alias("name"))
    asked = names(queries(spark, sf_dir), "q")
    df = names(table(spark, sf_dir, "documents"), "doc_id").join(asked.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    return asked.join(df, "name", "left").groupBy("q").agg(F.count("df").alias("present"), F.min("df").alias("ident_df_min"))


@query("mangled_names", """WITH t AS (SELECT p_partkey, concat(lower(replace(p_name, ' ', '_')), '_Xy') AS t FROM part), r AS (SELECT p_partkey, t, concat(string_split(t, '_')[1], array_to_string(list_transform(string_split(t, '_')[2:], lambda w: concat(upper(left(w, 1)), substr(w, 2))), '')) AS flip,
concat(left(t, 1), regexp_replace(substr(t, 2), '[aeiouAEIOU]', '', 'g')) AS bare, concat(left(t, 1), substr(t, 3, 1), substr(t, 2, 1), substr(t, 4)) AS swap FROM t)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND bare <> t AND length(bare) >= 3 THEN bare WHEN p_partkey % 3 >= 1 AND swap <> t THEN swap ELSE flip END AS name FROM r""")
def mangled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_Xy"))
    return table(spark, sf_dir, "part").select("p_partkey", T.mangled(t, F.col("p_partkey") % 3).alias("name"))


@query("attribute_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license')")
def attribute_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.attribute_search(table(spark, sf_dir, "documents"), "License", ["text", "source", "lang"]).select("doc_id")


@query("round_up_steps", "SELECT p_partkey, ceil(p_retailprice / 0.5 - 1e-12) * 0.5::DOUBLE AS price FROM part")
def round_up_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.round_up(F.col("p_retailprice"), 0.5).alias("price"))


#: An event's payload by its number; every 13th is cut off, every 17th has a text for a number or a number for a text.
_PAYLOADS = {
    "started": """'{"files": ' || CASE WHEN odd THEN '"7"' ELSE id::VARCHAR END || ', "symbols_only": true, "vectors_only": false}'""",
    "prepared": """'{"path": "p' || id || '", "language": "rust", "chunks": ' || CASE WHEN odd THEN '"x"' ELSE (id % 9)::VARCHAR END || ', "symbols": 2}'""",
    "skipped": """'{"path": "p' || id || '", "language": "go", "reason": ' || CASE WHEN odd THEN '5' ELSE '"unchanged"' END || '}'""",
    "embedded": """'{"batch_chunks": 8, "chunks_done": ' || id || ', "chunks_total": ' || CASE WHEN odd THEN 'null' ELSE '900' END || ', "elapsed_ms": 12}'""",
    "indexed": """'{"path": "p' || id || '", "language": "c", "count": ' || CASE WHEN odd THEN '1.5' ELSE (id % 7)::VARCHAR END || '}'""",
    "done": """'{"files": {"rust": {"a": ' || id || '}}, "files_indexed": 3, "chunks": ' || CASE WHEN odd THEN 'true' ELSE '4' END || ', "elapsed_ms": 5}'""",
    "error": """'{"code": ' || CASE WHEN odd THEN '{}' ELSE '"busy"' END || ', "detail": "d' || id || '"}'""",
}
_TYPES = list(E.FIELDS)
_RAW_SQL = "raw AS (SELECT event_id AS id, event_id % 7 AS t, event_id % 17 = 0 AS odd, event_id % 13 = 0 AS cut FROM events)"
_ODD = {"started": "files is no bigint", "prepared": "chunks is no bigint", "skipped": "reason is no string", "embedded": "chunks_total is missing", "indexed": "count is no bigint", "done": "chunks is no bigint", "error": "code is no string"}
_VALUES = {
    "started": "id AS files, true AS symbols_only, false AS vectors_only", "prepared": "'p' || id AS path, 'rust' AS language, id % 9 AS chunks, 2::BIGINT AS symbols", "skipped": "'p' || id AS path, 'go' AS language, 'unchanged' AS reason",
    "embedded": "8::BIGINT AS batch_chunks, id AS chunks_done, 900::BIGINT AS chunks_total, 12::BIGINT AS elapsed_ms", "indexed": "'p' || id AS path, 'c' AS language, id % 7 AS count",
    "done": "'{\"rust\":{\"a\":' || id || '}}' AS files, 3::BIGINT AS files_indexed, 4::BIGINT AS chunks, 5::BIGINT AS elapsed_ms", "error": "'busy' AS code, 'd' || id AS detail",
}


def payload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(k.alias("id"), (k % 17 == 0).alias("odd"), (k % 13 == 0).alias("cut"), (k % 7).alias("t"))
    body = F.coalesce(*[F.when(F.col("t") == i, F.expr(_PAYLOADS[name].replace("::VARCHAR", "::STRING"))) for i, name in enumerate(_TYPES)])
    name = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("t") + 1).cast("int"))
    return e.select("id", name.alias("event"), F.when(F.col("cut"), F.left(body, F.length(body) - 1)).otherwise(body).alias("payload"))


def _payload(event: str) -> None:
    @query(f"payload_{event}", f"WITH {_RAW_SQL} SELECT id, {_VALUES[event]} FROM raw WHERE t = {_TYPES.index(event)} AND NOT odd AND NOT cut")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.payloads(payload_events(spark, sf_dir), event)


for _event in _TYPES:
    _payload(_event)


@query("payload_rejects", f"WITH {_RAW_SQL}, e AS (SELECT [" + ", ".join(f"'{x}'" for x in _TYPES) + "][1 + t] AS event, CASE WHEN cut THEN 'broken' WHEN odd THEN [" + ", ".join(f"'{_ODD[x]}'" for x in _TYPES) + "][1 + t] END AS reason FROM raw) SELECT event, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY ALL")
def payload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rejected(payload_events(spark, sf_dir))
