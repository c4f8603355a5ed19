"""Few labels, clashing names, blocks of the benchmark, links by their attribute."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cairn.llm")
import corpus_pipeline  # noqa: E402
from cairn.llm import decontaminate, langid, sharding, url_filter  # noqa: E402
from cairn.llm.common import free_name  # noqa: E402


def speech(r, n):
    return " ".join("".join(r.choice(["the", "ing", "er", "an", "sh", "o"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def junk(r, n):
    return " ".join("".join(r.choice("bcdfghjklmnpqvwxz") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("labelled", [1, 10, 25])
def test_few_labelled_texts_reject_junk(spark, labelled):
    r = random.Random(labelled)
    train = spark.createDataFrame([(speech(r, 60), "en") for _ in range(labelled)], "text string, lang string")
    model = langid.fit(train)
    assert math.isfinite(model.limit[0])
    texts = [(k, speech(r, 50)) for k in range(20)] + [(k, junk(r, 30)) for k in range(20, 40)] + [(40, "ждщ фхцч йъьэ " * 9)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.doc_id: x.p.rejected for x in df.select("doc_id", langid.identify(df, model).alias("p")).collect()}
    assert not any(got[k] for k in range(20)) and all(got[k] for k in range(20, 41))


def test_rejection_limit_narrows():
    """From the uniform distribution towards what held-back texts show, without a jump."""
    rng = np.random.default_rng(1)
    h, n = rng.normal(1.5, 0.05, 4000), np.full(4000, 900.0)
    limits = [sum(x * y for x, y in zip(langid.rejection_limit(h[:k], n[:k], 3.5), (1, 1 / 30))) for k in (0, 1, 2, 5, 19, 20, 21, 100, 1000, 4000)]
    assert limits[0] == 3.5 and all(math.isfinite(x) for x in limits)
    assert limits == sorted(limits, reverse=True) and limits[-1] < 2.2 and abs(limits[4] - limits[6]) < 0.1


def test_marks_stay_with_their_letters():
    assert "".join(map(chr, langid.codes("हिन्दी, ไทยกิ่ง 12"))) == " हिन्दी ไทยกิ่ง "


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _row string, _reps string, _at string, _owner string, _slot string, _shard string, Slot string"


def clashing(spark, n=40):
    r = random.Random(2)
    own = [f"own{k}" for k in range(7)]
    return spark.createDataFrame([(k, speech(r, 30), "en", "ab"[k % 2], 1, *own) for k in range(n)], CLASH), own


def test_clashing_names_stay(spark, tmp_path):
    docs, own = clashing(spark)
    got = sharding.place(docs)
    assert got.columns == [*docs.columns[:-1], "slot", "shard"]  # a column Slot is replaced, as names have no case
    assert {tuple(x)[5:11] for x in got.collect()} == {tuple(own[:6])}
    got.write.parquet(f"{tmp_path}/placed")
    spark.createDataFrame([(1, "some words that nobody says at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(x)[5:] for x in out.collect()} == {tuple(own)}, name
    assert free_name("_x", docs) == "_x" and free_name("_ROW", docs) == "_ROW1"
    keyed = docs.withColumnRenamed("doc_id", "a.key").drop("Slot")
    assert sharding.place(keyed, "a.key").select("slot", "shard").subtract(sharding.place(docs).select("slot", "shard")).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    """Every block but the last is written and destroyed before the next goes out; results are those of one block."""
    r = random.Random(3)
    items = [(k, speech(r, 12)) for k in range(20)]
    docs = spark.createDataFrame([(k, speech(r, 20) + " " + (items[k % 20][1] if k % 3 else "")) for k in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    alive, most = set(), []
    made, destroy = spark.sparkContext.broadcast, decontaminate.Broadcast.destroy
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: (lambda b: (alive.add(id(b)), most.append(len(alive)), b)[-1])(made(v)))
    monkeypatch.setattr(decontaminate.Broadcast, "destroy", lambda b: (alive.discard(id(b)), destroy(b))[-1])
    blocked = sorted(map(tuple, decontaminate.find_leaks(docs, bench, block_chars=300).collect()))
    assert blocked == whole and len(whole) >= 40 and len(most) > 3 and max(most) == 1
    alive.clear(), most.clear()
    left = {x.doc_id for x in decontaminate.without_leaks(docs, bench, block_chars=300).collect()}
    assert left == {k for k in range(60)} - {x[0] for x in whole} and len(most) > 3 and max(most) == 1


def test_short_repeated_items_tie(spark):
    """Items of fewer words than a tile leak whole or not at all; items that repeat each leak, with equal coverage."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a c b"), (3, "x a b c x a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c"), (7, "A, b. c"), (8, "b c"), (9, ""), (9, None)], "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.coverage) for x in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(d, i, 1.0) for d in (1, 3) for i in (7, 7, 8)]


def test_links_are_href_attributes(spark):
    html = "<a data-href='http://trap.net/' href='http://good.net/'><a xhref=http://trap.net><a\nHREF=http://two.net/ title='x'><a href-x='http://trap.net'><area href='http://trap.net'>"
    pages = spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")
    assert {x.dst for x in url_filter.host_edges(pages).collect()} == {"good.net", "two.net"}


def test_stages_on_empty_tables(spark, tmp_path):
    docs, _ = clashing(spark)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).count() == 40
    repeated = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.decontaminated(spark, repeated, str(tmp_path)).count() == 80


def test_any_of_is_the_list_of_its_words():
    import re

    from cairn.llm.license_scan import NOTICES, any_of, word_list

    words = sorted({w for _, t in NOTICES for w in word_list(t)})
    pattern, r = re.compile(any_of(words)), random.Random(5)
    assert all(pattern.fullmatch(w) for w in words) and any_of(["a"]) == "a"
    for _ in range(20_000):
        w = r.choice(words)
        k = r.randrange(len(w) + 1)
        v = w[:k] + r.choice(["", "a", "s", "e"]) + w[k + r.randrange(2) :]
        assert bool(pattern.fullmatch(v)) == (v in words)


def test_license_words_of_odd_letters(spark):
    """Only A-Z are lower-cased: the Kelvin sign and the dotted I make no license words."""
    from cairn.llm import license_scan

    rows = [(1, "MIT LICENSE"), (2, "MİT LİCENSE"), (3, "mıt license"), (4, "ÉtÉ mit license K"), (5, "the booK mit license"), (6, "mit license mit"), (7, "a mit license"), (8, "mit licenses, mit-license")]
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 1, 0), 2: (2, 0, None), 3: (2, 0, None), 4: (4, 1, 1), 5: (4, 1, 2), 6: (3, 1, 0), 7: (3, 1, 1), 8: (4, 1, 2)}
