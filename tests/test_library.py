"""The library without the corpus operators."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import globs, text
from cairn.operators import derive, evaluate, lifecycle, provenance, reconcile, retrieve
from cairn.sources import readers, sinks
from cairn.streaming import streams

SF = "/root/testdata/sf0.001"

#: Each rule of the dialect with a path that it lets through and one that it stops.
PROJECT_GLOBS = [
    ("docs/*.txt", "docs/readme.txt", "docs/old/readme.txt"),  # one star stays within a segment
    ("docs/**", "docs/old/2019/readme.txt", "more/docs/readme.txt"),  # two cross segments, from the root on
    ("**/cache/**", "cache/entry", "cached/entry"),  # leading stars stand for no segment, too
    ("lib/**/test.go", "lib/test.go", "lib/a/test.go.bak"),  # so do stars in the middle; the whole path counts
    ("img/?.png", "img/7.png", "img/17.png"),  # a question mark is one character, and no slash
    ("img/[0-4].png", "img/3.png", "img/8.png"),  # classes
    ("img/[!0-4].png", "img/x.png", "img/0.png"),  # and their complements
    ("a+b/(c).md", "a+b/(c).md", "aab/c.md"),  # all else is literal
]


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("pattern,through,stopped", PROJECT_GLOBS)
def test_project_globs(spark, pattern, through, stopped):
    hit = lambda path: F.lit(path).rlike(globs.project_glob(pattern))
    assert tuple(spark.range(1).select(hit(through), hit(stopped)).first()) == (True, False)


def test_other_globs(spark):
    hit = lambda regex, path: one(spark.range(1).select(F.lit(path).rlike(regex)))
    assert hit(globs.sqlite_glob("src/*"), "src/db/a.rs") and not hit(globs.sqlite_glob("src/?"), "src/db")
    assert hit(globs.path_glob("**/a.py"), "a.py") and hit(globs.path_glob("**/a.py"), "x/y/a.py") and not hit(globs.path_glob("*/a.py"), "x/y/a.py")
    assert hit(globs.plain_glob("a/**"), "a/b/c") and not hit(globs.plain_glob("a/*"), "a/b/c")
    with pytest.raises(ValueError):
        globs.Selector()


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", f"f{i}", i) for i in range(1, 6)] + [("p", "x", 1)], "q string, path string, rank int")
    gold = spark.createDataFrame([("q", "f3"), ("p", "x"), ("none", "y")], "q string, path string")
    got = {r.q: r for r in evaluate.per_query(ranked, gold).collect()}
    assert got["q"].ndcg10 == 0.5 and got["q"].rr10 == pytest.approx(1 / 3, abs=1e-6) and got["p"].ndcg10 == got["p"].ap20 == 1 and got["none"].ndcg10 == 0
    two = spark.createDataFrame([("q", "f1"), ("q", "f3")], "q string, path string")
    assert evaluate.per_query(ranked, two).first().ap20 == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)


def test_bca_interval_covers_the_mean(spark):
    r = random.Random(1)
    rows = [(i, "s", r.gauss(0.3, 1)) for i in range(400)]
    x = evaluate.bca_intervals(spark.createDataFrame(rows, "q long, stratum string, delta double"), 800).first()
    assert x.lo < x.mean < x.hi and x.hi - x.lo == pytest.approx(2 * 1.96 / math.sqrt(400), rel=0.25)


def test_random_ranker_ranks_every_query(spark):
    n = retrieve.QUERY_BLOCK + 500
    got = retrieve.random_ranker(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), spark.range(n).withColumnRenamed("id", "q"), 2).collect()
    want = {(q, d, k + 1) for q in range(n) for k, d in enumerate(sorted((1, 2, 3), key=lambda d: hashlib.md5(f"0:{q}:{d}".encode()).hexdigest())[:2])}
    assert len(got) == 2 * n and {tuple(x) for x in got} == want


def test_bca_gathers_no_stratum(spark):
    r = random.Random(2)
    deltas = spark.createDataFrame([(i, "st"[i % 2], r.gauss(i % 2, 1)) for i in range(2000)], "q long, stratum string, delta double")
    got = {p: {x.stratum: x for x in evaluate.bca_intervals(deltas.repartition(p), 300).collect()} for p in (1, 7)}
    for s, x in got[1].items():
        assert x.n == 1000 and x.lo < x.mean < x.hi and x.hi - x.lo == pytest.approx(2 * 1.96 / math.sqrt(1000), rel=0.25)
        assert (x.lo, x.hi) == pytest.approx((got[7][s].lo, got[7][s].hi))
    plan = evaluate.bca_intervals(deltas, 300)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_dense_batch_matches_single(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")
    got = retrieve.dense_search_batch(e, q, 5, block=1).collect()
    v = q.where("q = 0").first().embedding
    want = [(r.vec_id, r.score) for r in retrieve.dense_search(e.where("vec_id <> 0"), v, 5).collect()]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.q == 0] == want


def test_windows_cover_and_bound():
    r = random.Random(2)
    for _ in range(60):
        t = "".join(r.choice(["word ", "x.y ", "\n", "\n\n", "é "]) for _ in range(r.randrange(0, 900)))
        w = derive.windows(t, most=50)
        # a window that begins within a token counts its rest as one more
        assert "".join(t[a:b] for a, b in w) == t and all(sum(a <= x < b for x in derive.token_starts(t)) <= 50 for a, b in w)


def brute_pack(tokens, levels, cap):
    n, best = len(tokens), {0: 0.0}
    for end in range(1, n + 1):
        best[end] = min(
            best[s] + derive.CHUNK_COST + derive.HEADING_COST * sum(x >= 3 for x in levels[s + 1 : end])
            for s in range(end)
            if not any(x in (1, 2) for x in levels[s + 1 : end]) and (sum(tokens[s:end]) <= cap or s == end - 1)
        )
    return best[n]


def test_markdown_pack_is_optimal():
    r = random.Random(3)
    for _ in range(100):
        n = r.randrange(1, 14)
        tokens, levels = [r.randrange(1, 400) for _ in range(n)], [r.choice([0, 0, 1, 2, 3, 4]) for _ in range(n)]
        ends, at, cost = derive.pack(tokens, levels, 600), 0, 0.0
        for e in ends:
            cost += derive.CHUNK_COST + derive.HEADING_COST * sum(x >= 3 for x in levels[at + 1 : e])
            at = e
        assert at == n and cost == pytest.approx(brute_pack(tokens, levels, 600))


def test_embedder(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string").select(derive.embed(F.col("t"), 8).alias("v"))
    a, b, c = [r.v for r in df.collect()]
    assert a == b != c and sum(x * x for x in a) == pytest.approx(1, abs=1e-5)
    import numpy as np

    with pytest.raises(Exception, match="returned"):
        spark.createDataFrame([("a",)], "t string").select(derive.embed(F.col("t"), 8, lambda rows: np.zeros((1, 3)))).collect()


def test_busy_models_are_asked_again():
    import numpy as np

    asked = []

    def model(rows, busy=2):
        asked.append(len(rows))
        if len(asked) <= busy:
            raise derive.Busy
        return np.ones((len(rows), 2))

    assert derive.patient(model, ["a"], 4, 0.01, 5).shape == (1, 2) and asked == [1, 1, 1]
    for tries, budget in ((2, 5), (9, 0.005)):
        asked.clear()
        with pytest.raises(derive.Busy):
            derive.patient(lambda rows: model(rows, 99), ["a"], tries, 0.01, budget)
        assert len(asked) <= 2


def test_ratios_and_signature(spark):
    df = readers.with_ratios(spark.createDataFrame([(6, 3, "x"), (1, 0, None)], "a int, b int, c string"), {"r": ("a", "b")}).withColumn("s", readers.config_signature(["c", "a"]))
    assert [(x.r, x.s) for x in df.collect()] == [(2.0, "c=x a=6"), (None, "c=NA a=1")]


def test_unknown_run_filters_are_errors(spark):
    with pytest.raises(ValueError, match="no such filter"):
        provenance.filtered_runs(spark.createDataFrame([(1,)], "seq long"), 1, colour=True)


def test_validity_reasons(spark):
    runs = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False), (5, False)], "run long, stale boolean")
    edges = spark.createDataFrame([(3, 2), (4, 3), (5, 99), (2, 1)], "run long, parent long")
    got = {r.run: r.invalid_reason for r in provenance.validity(runs, edges).collect()}
    assert got == {1: None, 2: "stale", 3: "context_invalid", 4: "context_invalid", 5: "context_deleted"}


def test_state_machine(spark):
    cases = [(None, "indexing", True), (None, "indexed", False), ("indexing", "failed", True), ("failed", "indexed", False), ("indexed", "deleted", True), ("deleted", "indexing", True), ("just_uploaded", "cancelled", False)]
    cases += [(x, x, x in ("indexing", "deleted")) for x in lifecycle.STATUSES]  # no other status is kept by an update
    got = [r[0] for r in spark.createDataFrame(cases, "o string, n string, w boolean").select(lifecycle.legal(F.col("o"), F.col("n"))).collect()]
    assert got == [c[2] for c in cases]


def test_drift(spark):
    tree = {"same": "AA", "changed": "bb", "new": "cc", "flying": "dd", "failed": "ee", "failed2": "ff", "cancelled": "gg", "fresh": "hh", "gone": "ii"}
    stored = {"same": ("aa", "indexed"), "changed": ("xx", "indexed"), "flying": ("zz", "indexing"), "flying2": ("zz", "indexing"), "lost": ("ll", "indexed"), "failed": ("ee", "failed"), "failed2": (None, "failed"), "cancelled": ("gg", "cancelled"), "fresh": (None, "just_uploaded"), "gone": ("ii", "deleted"), "gone2": ("jj", "deleted"), "failed3": ("kk", "failed")}
    m = spark.createDataFrame(list(tree.items()), "path string, sha256 string")
    f = spark.createDataFrame([(k, *v) for k, v in stored.items()], "path string, sha256 string, status string")
    want = {"changed": "stale", "flying": "indexing", "flying2": "indexing", "lost": "orphaned"} | dict.fromkeys(["new", "failed", "failed2", "cancelled", "fresh", "gone"], "missing")
    assert {r.path: r.bucket for r in reconcile.drift(m, f).collect()} == want


def test_split_message(spark):
    cases = {"\n\nSubj\n\nb": ("Subj", "b"), "one\n two \n\t\n\nbody\n\nmore\n\n": ("one two", "body\n\nmore"), "only": ("only", ""), "": ("", ""), "  \nx": ("", "x"), "a\r\n\r\nb\r\n": ("a", "b")}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    s, b = text.split_message(F.col("m"))
    assert {r.m: (r.s, r.b) for r in df.select("m", s.alias("s"), b.alias("b")).collect()} == cases


def test_truncated(spark):
    body = "aé" * 40
    df = spark.createDataFrame([("s" * 10, body), ("s" * 200, body), ("s", "short")], "s string, b string")
    got = [r[0] for r in df.select(text.truncated(F.col("s"), F.col("b"), 50, "…cut")).collect()]
    assert got == ["aé" * 11 + "a…cut", "…cut", "short"]
    df = spark.createDataFrame([("s" * 11, body)], "s string, b string")
    assert [r[0] for r in df.select(text.truncated(F.col("s"), F.col("b"), 52, "…cut")).collect()] == ["aé" * 11 + "a…cut"]


def test_shortened_and_figures(spark):
    a = "This is the first sentence, of forty characters or so."
    cases = [(a + " Then A. " + "x" * 300, a), ("This has twenty-five ones. B" + "x" * 300, "This has twenty-five ones."), (a + " And the second one. " + "x" * 300, a + " And the second one."), ("no end here " * 30, None), ("short?", "short?"), ("v1.2 is out " * 10, ("v1.2 is out " * 10).strip())]
    df = spark.createDataFrame(cases, "q string, want string")
    assert [r[0] for r in df.select(text.shortened(F.col("q"))).collect()] == [w for _, w in cases]
    one_row = spark.range(1).select(text.age(F.lit(59)), text.age(F.lit(7300)), text.significant(F.lit(0.012345), 2), text.significant(F.lit(98765.0), 3), text.gold_size(F.lit(4)), text.leakage_stratum(F.lit(False), F.lit(True))).first()
    assert tuple(one_row) == ("59s", "2h", 0.012, 98800.0, "3-4", "basename")


def test_mangled(spark):
    long = "some_" + "a" * 400 + "_name"
    cases = [("snake_case", 0, "snakeCase"), ("camelCase", 0, "camel_case"), ("plain", 0, "pln"), ("aei", 1, "aei"), ("abcd", 1, "acbd"), ("qqqq", 1, "qqqq"), ("value", 2, "vlaue"), (long, 0, "some" + "A" + "a" * 399 + "Name")]
    df = spark.createDataFrame(cases, "t string, way int, want string")
    assert [r[0] for r in df.select(text.mangled(F.col("t"), F.col("way"))).collect()] == [c[2] for c in cases]
    assert {r[0] for r in spark.range(50).select(text.mangled(F.lit("abcdef"), F.lit(2), F.col("id"))).collect()} == {"acbdef", "abdcef", "abcedf"}


def test_scan_tree_and_requests(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1\n", "src/deep/b.rs": "fn b() {}", "notes.unknown": "?", "target/c.rs": "no"}.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(body)
    got = {r.path: r for r in readers.scan_tree(spark, f"{tmp_path}/tree", excludes=["target/**"]).collect()}
    assert set(got) == {"src/a.py", "src/deep/b.rs"} and got["src/a.py"].programming_language == "python"
    assert got["src/a.py"].sha256 == hashlib.sha256(b"x = 1\n").hexdigest() and got["src/a.py"].text == "x = 1\n"
    assert tuple(readers.scan_report(readers.tree_listing(spark, f"{tmp_path}/tree", excludes=["target/**"], most=8)).first()) == (1, 1, 1)
    assert readers.scan_tree(spark, f"{tmp_path}/tree", includes=["none/**"]).count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"files": {"rust": {"a.rs": {"code": "x"}}, "go": {"b.go": {"code": "y"}, "c.go": {"code": ""}}}}))
    assert {(r.programming_language, r.path, r.text) for r in readers.index_requests(spark, f"{tmp_path}/r.json").collect()} == {("rust", "a.rs", "x"), ("go", "b.go", "y"), ("go", "c.go", "")}


def test_git_log(spark, tmp_path):
    z = "0" * 7
    raw = f":100644 100644 {z} {z} M\x00src/a.rs\x00:100644 100644 {z} {z} R100\x00old.rs\x00new.rs\x00:000000 100644 {z} {z} A\x00b.py\x00"
    log = f"\x1esha1\x1fAnn\x1fa@x\x1f10\x1f20\x1fp1\x1fFix the\nthing\n\nlonger body\x1f\n{raw}\x1esha2\x1fBob\x1fb@x\x1f30\x1f40\x1fp1 p2\x1fMerge branch x\x1f"
    (tmp_path / "log").write_bytes(log.encode())
    got = {r.sha: r for r in readers.git_log(spark, f"{tmp_path}/log").collect()}
    a = got["sha1"]
    assert (a.subject, a.body, a.parent_count, a.committed_at) == ("Fix the thing", "longer body", 1, 20)
    assert [tuple(p) for p in a.paths] == [("src/a.rs", "modified", None), ("new.rs", "renamed", "old.rs"), ("b.py", "added", None)]
    drops = {r.sha: r.drop for r in readers.kept_commits(readers.git_log(spark, f"{tmp_path}/log"), 50, 10, 9, 3).collect()}
    assert drops == {"sha1": None, "sha2": "merge"}


def test_rules_of_a_walk(spark):
    day, now = 86400, 100 * 86400
    entry = lambda *names: [{"path": n} for n in names]
    rows = [
        ("nine", now - 1, 1, "123456789", "", entry("src/a")), ("ten", now - 2, 1, "12345", "12345", entry("src/a")), ("bytes", now - 3, 1, "ééééé", "", entry("src/a")),
        ("bare", now - 4, 1, "no path at all", "", []), ("null", now - 5, 1, "null paths here", None, None), ("part", now - 6, 1, "some in scope", "", entry("docs/x", "src/a", "docs/y")), ("out", now - 7, 1, "none in scope", "", entry("docs/x")),
        ("merge", now - 8, 2, " Merge branch 'x' into y", " \n", []), ("prose", now - 9, 2, "Merge the two parsers", "", []), ("squash", now - 10, 2, "Merge pull request 5", "why", []), ("single", now - 11, 1, "Merge tag v1.0", "", []),
        ("edge", now - 10 * day, 1, "ten days to the second", "", []), ("old", now - 10 * day - 5, 1, "ten days and five seconds", "", []), ("long", now - 12, 1, "subject", "é" * 40_000, []),
    ]
    c = spark.createDataFrame(rows, "sha string, committed_at long, parent_count int, subject string, body string, paths array<struct<path: string>>")
    got = {r.sha: r for r in readers.kept_commits(c, now, 10, 100, 10, includes=["src/**"]).collect()}
    assert {k: r.drop for k, r in got.items() if r.drop} == {"nine": "message", "out": "scope", "merge": "merge", "old": "age"}
    assert [p.path for p in got["part"].paths] == ["src/a"] and got["bare"].paths == [] and got["null"].paths == [] and len(got["out"].paths) == 1
    cut = got["long"]
    assert cut.cut and len((cut.subject + cut.body).encode()) <= readers.MAX_MESSAGE_BYTES and cut.body.endswith(readers.CUT_MESSAGE) and sum(r.cut for r in got.values()) == 1
    # the newest are counted before anything but age is dropped
    few = readers.kept_commits(c, now, 10, 4, 10, includes=["src/**"])
    assert {r.sha for r in few.where("drop is null").collect()} == {"ten", "bytes", "bare"}
    assert {r.drop: r.n for r in readers.drop_counts(few).collect()} == {None: 3, "message": 1, "count": 9, "age": 1}
    assert {r.drop for r in readers.kept_commits(c, now, None, 100, 0).collect()} == {None, "merge"}
    assert {r.drop for r in readers.kept_commits(c, now, 10, 0, 0).collect()} == {"age", "count"}
    assert readers.kept_commits(c.limit(0), now, 10, 5, 0).count() == 0
    assert readers.deletion_window(now, 10) == now - 11 * day and readers.deletion_window(now, None) is None


def test_rst_and_diff(spark):
    t = "Title\n=====\nintro\n\nPart\n----\nbody a\nbody b\n\nNext\n====\n"
    got = readers.rst_sections(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.level, r.title, r.body) for r in got] == [(0, "Title", "intro"), (1, "Part", "body a\nbody b"), (0, "Next", "")]
    t = "A\n===\n.. currentmodule:: m.a\n\nB\n---\nx\n\nC\n---\n.. module:: m.c \nD\n===\ny\n.. py:module:: m.d\n"
    got = readers.rst_sections(spark.createDataFrame([(1, t), (2, "E\n==\n"), (3, "Lone\n====\n")], "doc_id long, text string")).orderBy("doc_id", "n").collect()
    assert [(r.title, r.context) for r in got] == [("A", "m.a"), ("B", "m.a"), ("C", "m.c"), ("D", "m.c"), ("E", None), ("Lone", None)]
    # two characters are enough, < and > too; an indented title is none, nor is an underline; other line ends count
    t = "AB\r\n==\r\nx\r\n  no\n====\nC\n>>>\n<<<\nlonger\n<<\n\tTab\n<<<<<\n"
    got = readers.rst_sections(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.title, r.level, r.body) for r in got] == [("AB", 0, "x\n  no\n===="), ("C", 1, "<<<\nlonger\n<<"), ("Tab", 2, "")]
    p = "--- a/x.py\n+++ b/x.py\n@@\n--- /dev/null\n+++ b/new.py\n"
    assert {(r.path, r.existed) for r in readers.diff_paths(spark.createDataFrame([(1, p)], "id long, patch string")).collect()} == {("x.py", True), ("new.py", False)}


def test_json_lines_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instance_id": "i", "n_gold": 2}\n\n{"instance_id": "j"}\n')
    assert readers.json_lines(spark, f"{tmp_path}/a.jsonl").count() == 2
    (tmp_path / "c.csv").write_text("a,b\nNA,1.5\nx,NA\nx,NA\n")
    assert sorted((r.a or "", r.b or 0.0) for r in readers.csv_results(spark, f"{tmp_path}/c.csv", ["b"]).collect()) == [("", 1.5), ("x", 0.0)]


def test_vector_sink(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    v = lambda rows: spark.createDataFrame(rows, "chunk_guid string, embedding array<float>, project_guid string")
    sinks.upsert_vectors(v([("a", [1.0], "p"), ("b", [2.0], "q")]), path)
    for _ in range(2):
        told = sinks.upsert_vectors(v([("a", [9.0], "p"), ("c", [3.0], "p"), ("c", [3.0], "p")]), path)
        assert told["upserted"] == 2 and told["rows"] >= 2 and told["millis"] >= 0
    read = lambda: sorted((r.chunk_guid, r.embedding[0], r.project_guid) for r in sinks.read_vectors(spark, path, v([])).collect())
    assert read() == [("a", 9.0, "p"), ("b", 2.0, "q"), ("c", 3.0, "p")]
    assert {tuple(r) for r in sinks.count_vectors(spark, path, v([])).collect()} == {("p", 2), ("q", 1)}
    gone = spark.createDataFrame([("b", "q"), ("b", "q"), ("b", "p"), ("zz", "p")], "chunk_guid string, project_guid string")
    assert sinks.delete_vectors(gone, path, v([])) == 1 and read() == [("a", 9.0, "p"), ("c", 3.0, "p")]
    assert sinks.delete_vectors(gone, path, v([])) == 0 and sinks.delete_vectors(gone, f"{tmp_path}/none", v([])) == 0
    # a change rewrites only the folders it touches
    stamp = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "vectors").rglob("*.parquet")}
    before = stamp()
    sinks.upsert_vectors(v([("a", [7.0], "p")]), path)
    assert len(set(before.items()) & set(stamp().items())) == len(before) - 1
    sinks.drop_project(spark, path, "p"), sinks.drop_project(spark, path, "p")
    assert read() == []


def test_embed_and_upsert(spark, tmp_path):
    path, heard = f"{tmp_path}/v", []
    chunks = spark.createDataFrame([(f"c{i}", "pq"[i % 2], f"code {i % 9}") for i in range(40)] + [("c0", "p", "code 0")], "chunk_guid string, project_guid string, code string")
    for _ in range(2):
        assert sinks.embed_and_upsert(chunks, path, lambda c: derive.embed(c, 8), lambda done, total: heard.append((done, total)), batches=3) == 40
    assert heard[-1] == (40, 40) and heard == sorted(heard[:3]) * 2
    like = spark.createDataFrame([], "chunk_guid string, project_guid string, embedding array<float>")
    got = sinks.read_vectors(spark, path, like).collect()
    assert len(got) == 40 and all(len(r.embedding) == 8 for r in got)
    with pytest.raises(ValueError, match="vectors for"):
        sinks.embed_and_upsert(chunks, path, lambda c: F.when(c != "code 3", F.array(F.lit(1.0))))


def test_journal_and_metrics(spark, tmp_path):
    runs = spark.createDataFrame([("p", 5, "r1"), ("p", 6, "r2"), ("q", 1, "r3")], "project_guid string, created_at long, id string")
    sinks.append_journal(runs, f"{tmp_path}/runs", 10)
    sinks.append_journal(spark.createDataFrame([("p", 7, "r4")], runs.schema), f"{tmp_path}/runs", 10)
    assert {(r.id, r.seq, r.expires_at) for r in spark.read.parquet(f"{tmp_path}/runs").collect()} == {("r1", 1, 15), ("r2", 2, 16), ("r3", 1, 11), ("r4", 3, 17)}
    schema = "project_guid string, created_at long, id string, challenged string, verdict string"
    full = lambda rows: spark.createDataFrame(rows, schema)
    child = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id string, path string")
    stored = lambda name: spark.read.parquet(f"{tmp_path}/j/{name}")
    none = lambda name: full([]).withColumn("seq", F.lit(0).cast("long")).withColumn("expires_at", F.lit(0).cast("long"))
    kids = lambda *ids: dict.fromkeys(("citations", "evidence", "turns", "context"), child(*ids))
    told = sinks.write_journal(none, {"runs": full([("p", 1, "a", None, None), ("p", 2, "b", "a", "disputed")]), **kids("a", "b")}, f"{tmp_path}/j", 5)
    assert {k: v["rows"] for k, v in told.items()} == {"citations": 2, "evidence": 2, "turns": 2, "context": 2, "superseded": 0, "runs": 2}
    sinks.write_journal(stored, {"runs": full([("p", 3, "c", "a", "confirmed"), ("p", 4, "d", "a", None)]), **kids("c")}, f"{tmp_path}/j", 5)
    assert {(r.id, r.seq) for r in stored("runs").collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 4)}
    assert [r.id for r in stored("superseded").collect()] == ["b"] and stored("turns").count() == 3
    with pytest.raises(ValueError, match="not inserted"):
        sinks.write_journal(stored, {"runs": full([("p", 9, "e", None, None)]), **kids("zz")}, f"{tmp_path}/j", 5)
    m = spark.createDataFrame([("up", {}, 1.0), ("files", {"status": "ok", "a": "b"}, 3.0)], "name string, labels map<string, string>, value double")
    for _ in range(2):
        sinks.write_metrics(m, f"{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").collect()] == ["# TYPE files gauge", 'files{a="b",status="ok"} 3.0', "# TYPE up gauge", "up 1.0", "# EOF"]
    typed = m.withColumn("kind", F.when(F.col("name") == "up", "counter"))
    sinks.write_metrics(typed, f"{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").collect() if "TYPE" in r.value] == ["# TYPE files gauge", "# TYPE up counter"]
    sinks.write_metrics(m.limit(0), f"{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").collect()] == ["# EOF"]


def test_scores_and_their_summary(spark, tmp_path):
    rows = spark.createDataFrame([("i", "a", 0.5, 1.0), ("j", "a", 0.25, None)], "instance_id string, label string, ndcg double, recall double")
    for _ in range(2):
        sinks.write_scores(rows, ["recall", "ndcg"], f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/per_query").count() == 2
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/s/summary").collect()] == [{"label": "a", "n": 2, "ndcg": 0.375, "recall": 1.0}]
    with pytest.raises(ValueError, match="2 labels"):
        sinks.write_scores(rows.withColumn("label", F.col("instance_id")), ["ndcg"], f"{tmp_path}/t")
    sinks.write_scores(rows.limit(0), ["ndcg"], f"{tmp_path}/e")
    assert json.loads(spark.read.text(f"{tmp_path}/e/summary").first().value)["n"] == 0


def test_queries_by_an_absent_row(spark, tmp_path):
    """Queries that ask by one row's values give nothing where it is absent."""
    from cairn import catalog

    for name in ("embeddings", "part", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {name: catalog.QUERIES[name](spark, str(tmp_path)).collect() for name in ("dense_topk", "search_display_join", "rank_symbols_anchor", "definition_counts")}
    assert {k: len(v) for k, v in rows.items()} == {"dense_topk": 0, "search_display_join": 0, "rank_symbols_anchor": 0, "definition_counts": 1} and tuple(rows["definition_counts"][0]) == (0, 0)


def test_stored_bytes(spark, tmp_path):
    from cairn.operators import lifecycle

    (tmp_path / "db" / "deep").mkdir(parents=True)
    (tmp_path / "db" / "a").write_bytes(b"x" * 10), (tmp_path / "db" / "deep" / "b").write_bytes(b"y" * 7)
    files = spark.createDataFrame([("p",), ("q",)], "project_guid string")
    runs = spark.createDataFrame([(None, True)], "expires_at long, stale boolean")
    got = {r.name: r.n for r in lifecycle.global_counts(files, files, runs, lifecycle.stored_bytes(spark, f"{tmp_path}/db")).collect()}
    assert got == {"projects": 2, "status_log": 2, "runs": 1, "pinned_runs": 1, "stale_runs": 1, "bytes": 17}


def test_inventory_takes_languages_from_files(spark):
    from cairn.operators import lifecycle

    files = spark.createDataFrame([("p", "a", "go", "indexed"), ("p", "b", "rust", "failed"), ("p", "c", "c", "indexed")], "project_guid string, path string, programming_language string, status string")
    chunks = spark.createDataFrame([("p", "a", "active", "wrong"), ("p", "a", "deleted", "wrong"), ("p", "b", "active", "wrong"), ("p", "gone", "active", "go"), ("q", "a", "active", "go")], "project_guid string, path string, status string, programming_language string")
    got = {tuple(r) for r in lifecycle.language_inventory(files, chunks).collect()}
    assert got == {("p", "go", 1, 1, 1, 1), ("p", "rust", 1, 0, 1, 0), ("p", "c", 1, 1, 0, 0)}


def test_debounce_batch(spark):
    e = spark.createDataFrame([("a", 0.0, 1, "upsert"), ("a", 0.9, 2, "delete"), ("a", 1.0, 3, "upsert"), ("a", 1.5, 4, "delete"), ("b", 0.5, 5, "upsert")], "path string, ts double, seq long, op string")
    assert {(r.path, r.seq, r.open) for r in streams.debounced(e, 1.0).collect()} == {("a", 2, 0.0), ("a", 4, 1.0), ("b", 5, 0.0)}
    e = spark.createDataFrame([("a", 0.0, 1, "upsert"), ("b", 0.9, 2, "upsert"), ("b", 1.1, 3, "delete")], "path string, ts double, seq long, op string")
    assert {(r.path, r.seq, r.open) for r in streams.debounced(e, 1.0).collect()} == {("a", 1, 0.0), ("b", 2, 0.0), ("b", 3, 1.1)}
    assert streams.debounced(e.limit(0), 1.0).count() == 0


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(2).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.tumbling(src, "1 hour", "60 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted(df.select(F.col("start").cast("string"), "event_type", "n").collect())
    assert rows(spark.table("tumbled")) == rows(streams.tumbling(e, "1 hour"))
    got = []
    raw = src.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), (F.col("user_id") % 7).cast("string").alias("path"))
    q = raw.writeStream.foreachBatch(streams.flush(lambda up, gone: got.append((up.count(), gone.count())))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got and all(a + b <= 7 for a, b in got)


def test_identifiers(spark):
    t = "call `bisect` and fooBar or snake_case, plain word\n```py\nx.y_z = plain2 a_b_c_d\n```"
    assert one(spark.createDataFrame([(t,)], "t string").select(text.identifiers(F.col("t")))) == ["bisect", "x.y_z", "a_b_c_d", "fooBar", "snake_case"]


def test_registry_and_entry(spark):
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names)
    assert e.entry(spark).count() == 10


QUICK = ["drift_buckets", "run_validity", "observed_cost", "status_log", "grep_literal", "fusion_rrf", "strata", "rate_window", "citation_verdicts", "classify_events"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(repr([row[names.index(c)] for c in cols]) for row in rel.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


def test_refs_and_gitignore(spark):
    b = spark.createDataFrame([("main",), ("release/1",), ("release/2",), ("dev",)], "name string")
    assert [r.name for r in readers.refs_of(b, ["release/*", " HEAD ", "", "main", "release", "nothing"]).collect()] == ["release/1", "release/2", "HEAD", "main"]
    rules, notes = readers.gitignore_globs("web", "# note\n\nnode_modules/\n*.log\n/dist\nsrc/gen\nbad\\ name\n!keep.log\n")
    assert rules == ["web/**/node_modules/**", "web/dist", "web/dist/**", "web/src/gen", "web/src/gen/**"]
    assert len(notes) == 2 and "switched off" in notes[1]
    fits = lambda p: any(one(spark.range(1).select(F.lit(p).rlike(globs.project_glob(g)))) for g in rules)
    assert fits("web/a/node_modules/x.js") and fits("web/node_modules/x.js") and not fits("node_modules/x.js") and fits("web/dist/a/b") and not fits("web/a.log")


def test_validity_against_brute_force(spark):
    r = random.Random(6)
    stale = {i: r.random() < 0.15 for i in range(80)}
    edges = {(i, r.randrange(-4, i)) for i in range(1, 80) for _ in range(r.choice([0, 1, 2]))} | {(i, i - 1) for i in range(40, 70)}
    up = {i: {b for a, b in edges if a == i} for i in stale}

    def above(i, seen):
        for b in up.get(i, ()):
            if b not in seen:
                seen.add(b)
                above(b, seen)
        return seen

    want = {i: "stale" if s else "context_deleted" if any(b not in stale for b in above(i, set())) else "context_invalid" if any(stale.get(b) for b in above(i, set())) else None for i, s in stale.items()}
    got = provenance.validity(spark.createDataFrame(list(stale.items()), "run long, stale boolean"), spark.createDataFrame(list(edges), "run long, parent long")).collect()
    assert {x.run: x.invalid_reason for x in got} == want


def brute_bm25(docs, queries, k, substrings):
    from cairn.operators.retrieve import STOP

    cut = lambda t: [w for w in __import__("re").findall("[A-Za-z_][A-Za-z0-9_]+", t.lower()) if len(w) > 2 and w not in STOP]
    count = lambda t, w: sum(t.lower().startswith(w, i) for i in range(len(t))) if substrings else cut(t).count(w)
    size = {d: max(len(t) - 2, 0) if substrings else len(cut(t)) for d, t in docs}
    avg, out = sum(size.values()) / len(size), set()
    for q, t in queries:
        score = {}
        for w in set(cut(t)):
            tf = {d: count(x, w) for d, x in docs if count(x, w)}
            idf = math.log(1 + (len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))
            for d, n in tf.items():
                score[d] = score.get(d, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[d] / avg))
        best = sorted(((-round(s, 6), d) for d, s in score.items()))[:k]
        out |= {(q, d, i + 1) for i, (_, d) in enumerate(best)}
    return out


@pytest.mark.parametrize("substrings", [False, True])
def test_bm25_against_brute_force(spark, substrings, monkeypatch):
    r = random.Random(8)
    vocab = ["alpha", "beta", "alphabet", "bet", "gamma", "lph", "delta_x", "the", "amma", "aaaa"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 30)))) for i in range(120)] + [(500, ""), (501, "aaaaaaa")]
    queries = [(q, " ".join(r.choice(vocab) for _ in range(3))) for q in range(12)] + [(99, "the of")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "q long, text string")
    monkeypatch.setattr(retrieve, "SCORED", 7)
    for block in (4096, 5):
        assert {(x.q, x.doc_id, x.rank) for x in retrieve.bm25(d, q, 6, substrings=substrings, block=block).collect()} == brute_bm25(docs, queries, 6, substrings)
    assert retrieve.bm25(d, q.limit(0), 6).count() == 0


def test_dense_batch_ties(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>").repartition(4)
    q = v.where("vec_id in (0, 1)").select(F.col("vec_id").alias("q"), "embedding")
    got = {(x.q, x.vec_id, x.rank) for x in retrieve.dense_search_batch(v, q, 4).collect()}
    assert got == {(0, d, k + 1) for k, d in enumerate((3, 6, 9, 12))} | {(1, d, k + 1) for k, d in enumerate((4, 7, 10, 13))}


def test_approximate_search_finds_nearly_all(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    centres = retrieve.fit_cells(e, 16)
    indexed = retrieve.in_cells(e, centres).cache()
    assert indexed.count() == e.count() and indexed.where("cell is null").count() == 0
    queries = e.where("vec_id % 25 = 1").select(F.col("vec_id").alias("q"), "embedding")
    probes = retrieve.choose_probes(indexed, centres, queries, 10, 0.95)
    assert 1 <= probes <= 16
    hit = total = 0
    for r in e.where("vec_id % 25 = 0").collect():
        want = {x.vec_id for x in retrieve.dense_search(e, r.embedding, 10).collect()}
        hit += len(want & {x.vec_id for x in retrieve.approximate_search(indexed, centres, r.embedding, 10, probes).collect()})
        total += len(want)
    assert hit >= 0.9 * total
    assert {x.vec_id for x in retrieve.approximate_search(indexed, centres, r.embedding, 10, 16).collect()} == want  # all cells: exact


def test_candidate_ids(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "vec_id long"), spark.createDataFrame([(2,), (3,), (3,)], "vec_id long")
    assert sorted(r.vec_id for r in retrieve.candidate_ids(a, b).collect()) == [1, 2, 3]


def test_management_scope(spark):
    df = spark.createDataFrame([("a/x.py", "python"), ("a/y.rs", "rust"), ("b/z.py", "python")], "path string, programming_language string")
    hit = lambda i, e: {r.path for r in df.where(globs.management_scope(i, e)).collect()}
    assert hit(globs.Selector(paths=["a/*"]), globs.Selector(languages=["rust"])) == {"a/x.py"} and hit(None, globs.Selector(paths=["a/*"])) == {"b/z.py"}
    with pytest.raises(ValueError):
        globs.management_scope(None, None)


def test_normal_quantiles():
    for p in (1e-6, 0.025, 0.2, 0.5, 0.8, 0.975, 1 - 1e-6):
        x = evaluate.normal_ppf(p)
        assert 0.5 * (1 + math.erf(x / math.sqrt(2))) == pytest.approx(p, rel=1e-9)
    assert evaluate.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
