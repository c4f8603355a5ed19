"""Structural chunks and evaluation corpora."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import corpus, slicing


def code(r, depth=0):
    out = []
    for _ in range(r.randrange(1, 4)):
        pad = "    " * depth
        kind = r.randrange(4) if depth < 3 else 3
        if kind == 0:
            out += [f"{pad}# about it"] * r.randrange(3) + ([""] if r.random() < 0.3 else [])
            out += [f"{pad}@deco"] * r.randrange(2) + [f"{pad}def f(a, b):", *code(r, depth + 1)]
        elif kind == 1:
            out += [f"{pad}class C:", *code(r, depth + 1)]
        elif kind == 2:
            out += [f"{pad}if a:", *code(r, depth + 1), f"{pad}else:", *code(r, depth + 1)]
        else:
            out += [f"{pad}x = g(1, 2, 3)"] * r.randrange(1, 6)
    return out


@pytest.mark.parametrize("fill", [True, False])
def test_python_chunks_hold_their_bounds(fill):
    r = random.Random(1)
    for _ in range(80):
        text = "\n".join(code(r)) + r.choice(["", "\n"])
        spans = slicing.python_spans(text, least=20, most=60, fill_gaps=fill)
        assert spans == sorted(spans) and all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert all(len(slicing.token_starts(text[a:b])) <= 60 for a, b in spans)
        lines = slicing.Lines(text, slicing.token_starts)
        assert all(a in lines.bounds for a, _ in spans) or fill
        if fill:  # what is left out is less than a window is worth
            at = 0
            for a, b in [*spans, (len(text), len(text))]:
                assert len(slicing.token_starts(text[at:a])) < slicing.MIN_GAP
                at = b


def test_comments_are_absorbed():
    text = "import a\n\n# far\n\n# near\n# nearer\n@deco\ndef f(x):\n" + "    y = x + 1\n" * 6 + "z = 1\n"
    ((a, b),) = slicing.python_spans(text, least=20, most=60, fill_gaps=False)
    assert text[a:b].startswith("# near\n# nearer\n@deco\n") and text[a:b].endswith("y = x + 1\n") and "z" not in text[a:b]
    ((a, b),) = slicing.python_spans(text, least=20, most=41, fill_gaps=False)  # no room for both comments
    assert text[a:b].startswith("# nearer\n@deco\n")
    assert slicing.python_spans("def broken(:\n", fill_gaps=False) == [] and slicing.python_spans("") == []


def test_markdown_block_kinds():
    text = "Title\n===\n\n- a\n- b\n  more\n1) c\n\npara\n# H\ntext under\n```\ncode\n\n# no\n```\n    indented\n\n    still\n> q\nlazy\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n<p>\nhtml\n"
    got = [(b.kind, b.first, b.last, b.level) for b in slicing.blocks(text.split("\n"))]
    assert got == [
        ("setext_heading", 0, 2, 1), ("list_item", 3, 4, 0), ("list_item", 4, 6, 0), ("list_item", 6, 7, 0), ("paragraph", 8, 9, 0), ("atx_heading", 9, 10, 1), ("paragraph", 10, 11, 0), ("fenced_code_block", 11, 16, 0),
        ("indented_code_block", 16, 19, 0), ("block_quote", 19, 21, 0), ("table", 22, 25, 0), ("thematic_break", 26, 27, 0), ("html_block", 27, 29, 0),
    ]


def test_markdown_packing_with_vectors():
    import numpy as np

    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(1, 9)
        text = "\n\n".join(r.choice(["", "# ", "### ", "#### "]) + " ".join("w" for _ in range(r.randrange(1, 40))) for _ in range(n)) + "\n"
        lines = slicing.Lines(text, slicing.token_starts)
        bs = slicing.blocks([lines.line(k) for k in range(lines.n)])
        v = np.array([[r.gauss(0, 1), r.gauss(0, 1)] for _ in bs])
        size = np.array([lines.tokens(b.first, b.last) for b in bs], float)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)

        def cost(i, j):
            if any(b.level in (1, 2) for b in bs[i + 1 : j]) or (j - i > 1 and lines.tokens(bs[i].first, bs[j - 1].last) > 60):
                return float("inf")
            w = size[i:j] / size.sum()
            return slicing.CHUNK_COST + slicing.HEADING_COST * sum(b.level > 2 for b in bs[i + 1 : j]) + w.sum() - float(np.linalg.norm((w[:, None] * unit[i:j]).sum(0)))

        best = [0.0]
        for j in range(1, len(bs) + 1):
            best.append(min(best[i] + cost(i, j) for i in range(j)))
        got = slicing.packed(lines, bs, 60, v)
        assert [x for s in got for x in s] == [0, *(x for s in got[:-1] for x in (s[1], s[1])), len(bs)]
        assert sum(cost(i, j) for i, j in got) == pytest.approx(best[-1])


def test_blocks_above_the_cap_are_cut():
    text = "# H\n\n" + "\n".join("word " * 7 for _ in range(9)) + "\n\n" + "long " * 95 + "\n"
    spans = slicing.markdown_spans(text, cap=30)
    assert all(len(slicing.token_starts(text[a:b])) <= 30 for a, b in spans)
    assert sum(len(slicing.token_starts(text[a:b])) for a, b in spans) == len(slicing.token_starts(text))


def test_python_symbols(spark):
    text = "LIMIT = 3\nclass A:\n    x = 1\n    def go(self):\n        def inner():\n            pass\n\nasync def top():\n    return 1\n"
    df = spark.createDataFrame([(1, text), (2, "def broken(:\n  class Half\n"), (3, None)], "doc_id long, text string")
    got = {tuple(r) for r in slicing.symbols(df, "python").collect()}
    assert got == {(1, "LIMIT", "constant", 1, 1), (1, "A", "class", 2, 6), (1, "go", "function", 4, 6), (1, "inner", "function", 5, 6), (1, "top", "function", 8, 9), (2, "broken", "def", 1, 1), (2, "Half", "class", 2, 2)}
    assert slicing.symbols(df, "toml").count() == 0


def test_references_resolve(spark):
    files = {
        "p/__init__.py": "x = 1\n", "p/a.py": "class A:\n    def go(self): pass\ndef both(): pass\n", "p/sub/__init__.py": "", "p/sub/b.py": "def both(): pass\ndef only(): pass\n", "p/sub/c.py": "Y = 2\n", "p/bad.py": "def (:\n",
    }
    modules, names = corpus.python_index(spark.createDataFrame(list(files.items()), "path string, text string"))
    cases = {
        ("p.a.A", None): ("p/a.py", "symbol"), ("p.a.A.go", None): ("p/a.py", "symbol"), ("p.a", None): ("p/a.py", "module"), ("p", None): (None, "empty_module"), ("p.only", None): ("p/sub/b.py", "symbol"),
        ("p.sub.both", None): ("p/sub/b.py", "symbol"), ("p.both", None): (None, "ambiguous"), ("p.a.NAME", None): ("p/a.py", "module"), ("p.sub.c.NAME", None): (None, "empty_module"), ("both", "p.a"): ("p/a.py", "symbol"),
        ("nothing", "p.a"): ("p/a.py", "module"), ("only", "q.r"): ("p/sub/b.py", "symbol"), ("nothing", None): (None, "unknown_module"), ("both", None): (None, "ambiguous"), ("p.bad", None): (None, "empty_module"),
    }
    refs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(cases)], "ref long, target string, context string")
    got = {r.ref: (r.path, r.outcome) for r in corpus.resolve(refs, modules, names).collect()}
    assert got == dict(enumerate(cases.values()))


def test_prose_without_pointers(spark):
    body = "See :class:`~p.a.A` and :func:`p.b.go (x)`, :ref:`text <x>`, ``code`` or *this*.\n\n.. class:: p.a.A(x)\n\n   hidden\n   too\n\n.. _label:\n\nExample::\n\n    hidden = 1\n\nback\n>>> hidden::\n  shown\n... hidden\n  .. staticmethod:: p.b.B.make\n\tno deeper\n    hidden\nend `link`_"
    assert corpus.stripped_prose(body) == "See A and go, text <x>, code or this. Example back >>> hidden no deeper hidden end link"
    got = spark.createDataFrame([(body,)], "b string").select(corpus.code_refs(F.col("b"))).first()[0]
    assert got == ["p.a.A", "p.b.B.make", "p.a.A", "p.b.go"]
    began = __import__("time").time()
    assert corpus.stripped_prose(".. x::\n" + "   hidden\n\n" * 100_000 + "seen") == "seen" and __import__("time").time() - began < 20
    assert corpus.stripped_prose(" " * 300_000 + "a") == "a"


def test_lines():
    """Lines by their places, with or without an end, and the tokens between two of them."""
    for text, want in (("", [""]), ("a", ["a"]), ("a b\n\nc", ["a b\n", "\n", "c"]), ("a\n", ["a\n"]), ("\n\n", ["\n", "\n"])):
        lines = slicing.Lines(text, slicing.token_starts)
        assert [lines.line(k) for k in range(lines.n)] == want and lines.bounds[0] == 0 and lines.bounds[-1] == len(text)
        for a in range(lines.n + 1):
            for b in range(a, lines.n + 1):
                assert lines.tokens(a, b) == len(slicing.token_starts("".join(want[a:b])))


def test_table_functions_equal_the_frames(spark):
    from cairn.operators import tables

    tables.register(spark)
    text = "class C:\n" + "".join(f"    def m{k}(self):\n        return {k} + {k}\n\n" for k in range(30))
    rust = "/// one\nfn a() {\n" + "    x(1);\n" * 60 + "}\nstruct S { a: u8 }\n"
    files = spark.createDataFrame([(1, text, "python"), (2, rust, "rust"), (3, None, "go"), (4, "plain words\n" * 400, None), (5, "", "c")], "doc_id long, text string, programming_language string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one = files.where("doc_id = 1")
    assert rows(spark.sql("SELECT * FROM slice_code(TABLE({f}) PARTITION BY doc_id)", f=one)) == rows(slicing.slice_python(one))
    assert rows(spark.sql("SELECT * FROM slice_code(TABLE({f}) PARTITION BY doc_id)", f=files)) == rows(slicing.slice_code(files))
    assert rows(spark.sql("SELECT * FROM slice_code(TABLE({f}) PARTITION BY programming_language, least => 5, most => 40, fill_gaps => false)", f=files)) == rows(slicing.slice_code(files, least=5, most=40, fill_gaps=False))
    assert rows(spark.sql("SELECT * FROM definitions_in(TABLE({f}) PARTITION BY doc_id)", f=files)) == rows(slicing.definitions(files))
    got = spark.sql("SELECT f.doc_id, t.k, t.token FROM {f} f, LATERAL token_spans(f.text) t", f=files).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {k: len(slicing.token_starts(t)) for k, t in ((1, text), (2, rust), (4, "plain words\n" * 400))}


def test_tests_define_no_names(spark):
    files = [("pkg/core.py", "class E: pass\n"), ("pkg/tests/core.py", "class E: pass\n"), ("pkg/test_core.py", "class E: pass\n"), ("pkg/core_test.py", "class E: pass\n"), ("pkg/test/client.py", "class C: pass\n")]
    modules, names = corpus.python_index(spark.createDataFrame(files, "path string, text string"))
    assert {r.path for r in modules.collect()} == {"pkg/core.py", "pkg/test/client.py"} and {r.name for r in names.collect()} == {"E", "C"}


def test_unknown_names_and_lost_queries_are_errors(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2)], "name string, tier int")
    with pytest.raises(ValueError, match="unknown corpus names: x, z"):
        corpus.select_corpora(c, ["a", "z", "x"])
    assert [r.name for r in corpus.select_corpora(c, ["b"], 1).collect()] == ["b"]
    res = spark.createDataFrame([("i",), ("j",)], "instance_id string")
    with pytest.raises(ValueError, match="1 results have no query"):
        corpus.complete_join(res, res.where("instance_id = 'i'").withColumn("query", F.lit("q")))
