"""What holds at sizes and for texts that the other tests do not reach."""

from __future__ import annotations

import random

import pytest

from cairn.operators import corpus, nesting, retrieve, slicing

#: Python whose nesting overflows the parser's own stack: a MemoryError, not a SyntaxError.
DEEP = "def seen():\n    pass\n" + "- " * 20_000 + "1\n"


def test_text_too_deep_for_the_parser(spark):
    files = spark.createDataFrame([(1, DEEP), (2, "def ok(): pass\n")], "doc_id long, text string")
    got = {(r.doc_id, r.name, r.kind) for r in slicing.symbols(files, "python").collect()}
    assert got == {(1, "seen", "def"), (2, "ok", "function")}
    assert slicing.python_definitions(DEEP) == [] and slicing.statements(DEEP) == []
    modules, _ = corpus.python_index(spark.createDataFrame([("p/a.py", DEEP)], "path string, text string"))
    assert [(r.module, r.defines) for r in modules.collect()] == [("p.a", False)]


@pytest.mark.parametrize("hot_path", [1, 100_000])
def test_covered_functions_with_spans_of_any_length(spark, hot_path):
    r = random.Random(hot_path)
    at = lambda: None if r.random() < 0.03 else r.randrange(60_000)
    path = lambda: r.choice(["a", "a", "b", "c", None])
    chunk = [(path(), s, e if e is None or s is None or r.random() < 0.05 else s + e % 300) for s, e in ((at(), at()) for _ in range(150))] + [("wide", 1, 2**40), ("at", 7, 9)]
    func = [(path(), str(k), s, e if e is None or s is None or k % 2 else s + e % 500) for k, (s, e) in enumerate((at(), at()) for _ in range(300))] + [("wide", "w", 2**39, 2**41), ("at", "ends", 3, 7), ("at", "begins", 9, 12), ("at", "before", 3, 6), ("at", "after", 10, 12)]
    hits = lambda p, a, b: any(p == q and None not in (p, a, b, c, d) and c <= b and a <= d for q, c, d in chunk)
    want = sorted((n, hits(p, a, b)) for p, n, a, b in func)
    got = corpus.covered_functions(spark.createDataFrame(chunk, "path string, start_line long, end_line long"), spark.createDataFrame(func, "path string, name string, start_line long, end_line long"), hot_path)
    assert sorted((x.name, x.covered) for x in got.collect()) == want


def test_covered_functions_deals_no_page_of_a_span(spark):
    """One span over 2**40 lines is a row; as pages it was 2**32."""
    one = spark.createDataFrame([("p", "f", 5, 2**40)], "path string, name string, start_line long, end_line long")
    assert [x.covered for x in corpus.covered_functions(one.drop("name"), one).collect()] == [True]


def test_symbol_ranks_join_counts_not_definitions(spark):
    """20,000 definitions of one name in three files, asked 20,000 times: 60,000 rows of a join, not 4 * 10**8."""
    symbols = spark.range(20_000).selectExpr("concat('f', id % 3) AS path", "'n' AS name", "id AS start_line").unionByName(spark.createDataFrame([("f2", "m", 1)], "path string, name string, start_line long"))
    asked = spark.range(20_000).selectExpr("id AS q", "'n' AS name").unionByName(spark.createDataFrame([(0, "m")], "q long, name string"))
    plan = retrieve.rank_files_by_symbols(asked, symbols)
    assert [tuple(x) for x in plan.where("q = 0").orderBy("rank").collect()] == [(0, "f2", 2, 6667, 1), (0, "f0", 1, 6667, 2), (0, "f1", 1, 6667, 3)]
    assert plan.count() == 60_000


def test_made_texts_are_dealt_out(spark, tmp_path, monkeypatch):
    from cairn.plans import corpus_queries as Q

    spark.range(40).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(Q, "KEYS", 4, raising=False)
    for files in (Q.python_files, Q.braced_files, Q.markdown_files):
        assert files(spark, str(tmp_path)).rdd.getNumPartitions() == 10


_PIECES = [
    "x", "foo(1, 2)", '"a}"', "'c'", "'a", "`t", "`", "(", ")", "{", "}", "[", "]", ";", ";", ",", "\n", "\n", "\n", "\n", "  ", " ", "=", "=>", "->", "<<<A", "A", "//", "/*", "*/", "#", "#[x]", "?>", "<?php", "/a;/g", ":", "::", "public:", "return", "else", "while", "class C", "fn f()", "def m", "end", "do", "if",
    'R"(', ')"', 'b"', '@"', '"""', '""', "\\\\", '\\"', "$x", "a[i]", "f(a[1], \"(\")", "x(\"}\");\n", "  int a = b(c(d));\n", "  x += 1; \r\n", "typedef struct {", "v = f(a;b);\n", "y = (1\n);\n", "$\"{a}\";\n", "r#\"q\";\n", "++", "1;", "_a.b;\n", "é = 2;\n",
]


@pytest.mark.parametrize("language", sorted(nesting.SYNTAX))
def test_statements_read_at_once_are_as_those_read_by_parts(language, monkeypatch):
    r = random.Random(language)
    texts = ["".join(r.choice(_PIECES) + r.choice(["", "", " "]) for _ in range(r.randrange(60))) for _ in range(1500)]
    tree = lambda us: [(u.start, u.end, u.head, tree(u.inner)) for u in us]
    both = lambda t: (lambda u, n: (tree(u), n))(*nesting.scan(t, language))
    fast = [both(t) for t in texts]
    seen = sum(kind == "statement" for t in texts for kind, _, _ in nesting.tokens(t, language))
    monkeypatch.setattr(nesting, "_statement", lambda s: r"(?!)")
    monkeypatch.setitem(nesting._LEXERS, language, nesting._lexer(nesting.SYNTAX[language]))
    assert [t for t, f in zip(texts, fast) if f != both(t)] == []
    assert seen > 500 or language in ("json", "ruby")


def test_lines_of_a_long_scan_are_read_once():
    """Lines that begin as statements do and are none, and one very long line."""
    began = __import__("time").time()
    for text in ("a b (c [d] " * 100_000, 'f("x", (y)) + g\n' * 50_000, "(" * 50_000 + "\n" + "x(" * 50_000):
        nesting.scan(text, "java")
    assert __import__("time").time() - began < 30


def test_permutation_reads_its_rows_once(spark, capsys):
    from cairn.operators import evaluate

    evaluate.permutation_p(spark.range(9).selectExpr("'s' AS stratum", "id AS q", "id - 3.5D AS delta"), 4).explain()
    assert capsys.readouterr().out.count("Range (") == 1


def test_runs_of_statements_are_one_part_until_asked_for(monkeypatch):
    """2000 lines of plain statements are one part of their method; chunks and definitions are as without runs."""
    text = "class A {\n  int f() {\n" + "    x(1);\n" * 2000 + "  }\n  int g() {\n    enum B { C }\n    a(1, 2, 3, 4, 5, 6, 7, 8, 9, 10);\n    class D { }\n  }\n}\n"
    whole = nesting.scan(text, "java")[0][0]
    assert len(whole.inner[0].parts) == 1 and len(whole.inner[0].inner) == 2000 and len(whole.inner[0].wide(30)) == 0
    files = [(text, "java"), ("fn f() {\n" + "  pub fn g();\n  x();\n" * 3 + "}\n", "rust"), ("class A {\n  m() {\n" + "    const f = (a) => a;\n    g();\n" * 9 + "  }\n}\n", "javascript")]
    read = lambda: [(nesting.definitions(t, lang), [slicing.code_spans(t, lang, slicing.token_starts, k, 3 * k, False) for k in (1, 5, 15, 40)]) for t, lang in files]
    fast = read()
    monkeypatch.setattr(nesting, "_statement", lambda s: r"(?!)")
    for lang in ("java", "rust", "javascript"):
        monkeypatch.setitem(nesting._LEXERS, lang, nesting._lexer(nesting.SYNTAX[lang]))
    monkeypatch.setattr(nesting, "defining", lambda text, unit, language, around: unit.inner)
    assert fast == read() and [len(f[0]) for f in fast] == [5, 4, 11]


def test_token_starts_are_those_of_the_pattern(monkeypatch):
    from cairn.operators import derive

    r = random.Random(4)
    texts = ["".join(r.choice("ab_1 \t\n.;(\x1c\x85\xa0é漢🙂\u0301\ud800") for _ in range(r.randrange(90))) for _ in range(400)] + ["", "word" * 40_000, "plain, ascii"]
    for piece in (7, 1 << 16):
        monkeypatch.setattr(derive, "PIECE", piece, raising=False)
        assert [derive.token_starts(t) for t in texts] == [[m.start() for m in derive.TOKEN.finditer(t)] for t in texts]


def test_table_functions_read_files_where_they_lie(spark, tmp_path, capsys):
    from cairn.plans import corpus_queries as Q

    spark.range(40).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    Q.code_chunks_in_sql(spark, str(tmp_path)).explain()
    assert "hashpartitioning" not in capsys.readouterr().out


def test_markdown_chunks_reads_documents_once(spark, tmp_path, capsys):
    from cairn.plans import corpus_queries as Q

    lines = "one two\n" * 40 + "w " * 450 + "\nthree\n"
    spark.createDataFrame([(1, lines), (2, ""), (3, None), (4, "a\nb\nc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.markdown_chunks(spark, str(tmp_path))
    out.explain()
    assert capsys.readouterr().out.count("FileScan") == 1
    got = {r.doc_id: (r.cost, r.tokens) for r in out.collect()}
    assert sorted(got) == [1, 4] and got[4] == (0.35, 4)
    # the made texts, packed one document at a time
    made = [x.strip() for x in lines.split("\n") if x.strip()]
    text = "\n\n".join("#" * (i // 3 % 6 + 1) + " " + x if i % 3 == 0 else x for i, x in enumerate(made))
    rows = slicing.Lines(text, slicing.token_starts)
    bs = slicing.blocks([rows.line(k) for k in range(rows.n)])
    spans = slicing.packed(rows, bs, 200)
    big = sum(-(-n // 200) - 1 for n in (rows.tokens(b.first, b.last) for b in bs) if n > 200)
    assert got[1] == (round(0.35 * (len(spans) + big) + 0.25 * sum(b.level >= 3 for i, j in spans for b in bs[i + 1 : j]), 6), len(rows.starts))


def test_debounce_keeps_ever_fewer_pointers(spark, monkeypatch):
    """500 windows in a row: what is written is a few times the events, not a copy of them for each doubling."""
    from cairn.streaming import streams

    settle, written = streams.settle, []
    monkeypatch.setattr(streams, "settle", lambda df: (lambda out: (written.append(out.count()), out)[1])(settle(df)))
    r = random.Random(5)
    at = sorted(r.randrange(1_000_000) for _ in range(4000))
    events = spark.createDataFrame([("p", t / 1e6, k, "upsert") for k, t in enumerate(at)], "path string, ts double, seq long, op string")
    want, opened = set(), None
    for t in at:
        if opened is None or t - opened >= 2000:
            opened = t
            want.add(t)
    assert {round(x.open * 1e6) for x in streams.debounced(events, 0.002).collect()} == want and len(want) > 400
    assert sum(written) < 8 * len(set(at))


_HEADS = [
    "{\n", "}\n", "  }\n", "    }  \n", "  fn m(a: u8) {\n", "class C {\n", "else {\n", "} else {\n", "  m(a) {\n", "a(function (b, c) {\n", "});\n", "public class D extends B<T> {\n", "x = y\n", "x =\n", "m(): void {\n", "struct S {\n", " s {\n", ": B {", "while (f(a[1], (2))) {\r\n", "case 1: {\n",
    "b\"\\\n", "def f(a: Int) = {\n", "namespace A::B {\n", "private: int f() {\n", "@A(\"x\") class E {\n", "g(\"{\") {\n", "e \"s\"{\n", "enum E { A, B }\n", "\t}\n", "_x {\n", "$y {\n", "é {\n",
]


@pytest.mark.parametrize("language", sorted(nesting.SYNTAX))
def test_heads_read_at_once_are_as_those_read_by_parts(language, monkeypatch):
    r = random.Random(language)
    texts = ["".join(r.choice(_PIECES + _HEADS) + r.choice(["", "", "", " "]) for _ in range(r.randrange(40))) for _ in range(1500)]
    tree = lambda us: [(u.start, u.end, u.head, tree(u.inner)) for u in us]
    both = lambda t: (lambda u, n: (tree(u), n, nesting.definitions(t, language)))(*nesting.scan(t, language))
    fast = [both(t) for t in texts]
    seen = sum(kind in ("head", "tail") for t in texts for kind, _, _ in nesting.tokens(t, language))
    for name in ("_statement", "_head", "_tail"):
        monkeypatch.setattr(nesting, name, lambda s: r"(?!)")
    monkeypatch.setitem(nesting._LEXERS, language, nesting._lexer(nesting.SYNTAX[language]))
    assert [t for t, f in zip(texts, fast) if f != both(t)] == []
    assert seen > 500 or language in ("json", "ruby")


def test_heads_of_bodies_are_one_part():
    """A method is its head, its statements and its end, whatever words and lines they have."""
    text = "public class C {\n" + "".join(f"  public static int m{k}(int a, String b) {{\n" + "    x(1);\n" * 30 + "  }\n" for k in range(10)) + "}\n"
    assert [kind for kind, _, _ in nesting._lexed(text, "java")] == ["head"] + ["head", "statement", "tail"] * 10 + ["tail"]
    assert [d[0] for d in nesting.definitions(text, "java")] == ["C"] + [f"m{k}" for k in range(10)]


def test_places_of_definitions_on_one_long_line():
    """A line is passed once, not once for each definition on it; columns are bytes."""
    n = 100_000
    began = __import__("time").time()
    rows = list(slicing.definition_rows(1, "/* é */ " + "fn a() {" * n + "}" * n, "rust"))
    assert __import__("time").time() - began < 15
    assert rows[2] == (1, "a", "function", 1, 1, 9 + 16, 9 + 9 * n - 2, "a", "function") and len(rows) == n
    r = random.Random(3)
    text = "".join(r.choice("ab\n é漢🙂") for _ in range(300))
    want = lambda at: (text.count("\n", 0, at) + 1, len(text[text.rfind("\n", 0, at) + 1 : at].encode()))
    assert slicing.places(text, [*range(301), 7]) == {at: want(at) for at in range(301)}
