"""Neighbour graphs against the exact scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import neighbours, retrieve


def vectors(spark, n, dim=24, seed=1, groups=40):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(0, groups, n)] + 0.6 * r.normal(size=(n, dim))
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")


def share(df):
    r = df.agg(F.sum("hits").alias("h"), F.sum("wanted").alias("w")).first()
    return r.h / r.w


@pytest.mark.parametrize("part_rows", [8192, 700])
def test_recall(spark, part_rows):
    v = vectors(spark, 4000)
    q = v.where("vec_id % 40 = 0").select(F.col("vec_id").alias("q"), "embedding")
    index = neighbours.build(v, part_rows)
    found = neighbours.search(index, q, 10).cache()
    assert index.count() == 4000 and index.select("vec_id").distinct().count() == 4000
    exact = retrieve.dense_search_batch(v, q, 10)
    assert share(neighbours.recall(found, exact)) >= 0.9
    # what is found carries its exact score, each vector once, never the query itself
    same = found.join(exact.select("q", "vec_id", F.col("score").alias("s")), ["q", "vec_id"])
    assert same.where(F.abs(F.col("score") - F.col("s")) > 1e-5).count() == 0
    assert found.count() == 1000 and found.select("q", "vec_id").distinct().count() == 1000 and found.where("q = vec_id").count() == 0


def test_a_walk_sees_little(monkeypatch):
    """Of a part, a search computes few distances; with a list as long as the part it finds all."""
    r = np.random.default_rng(2)
    x = r.normal(size=(6000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = neighbours.link(x, 16, 4)
    q = x[:50] + 0.1 * r.normal(size=(50, 16)).astype(np.float32)
    exact = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :10]
    looked = []
    real = np.einsum
    monkeypatch.setattr(neighbours.np, "einsum", lambda s, a, b: (looked.append(b.shape[1]), real(s, a, b))[-1])
    place, score = neighbours.walk(x, links, q, 64)
    assert np.mean([len(set(p[:10]) & set(e)) for p, e in zip(place, exact)]) >= 9 and sum(looked) < 6000 * 0.6
    assert (np.diff(score, axis=1) <= 1e-6).all() and all(len(set(p)) == len(p) for p in place)
    place, _ = neighbours.walk(x[:300], neighbours.link(x[:300], 16, 4), q, 300)
    assert all(set(p) == set(range(300)) for p in place)


def test_small_and_empty_tables(spark):
    v = vectors(spark, 3)
    q = v.select(F.col("vec_id").alias("q"), "embedding")
    assert neighbours.search(neighbours.build(v), q, 10).groupBy("q").count().where("count = 2").count() == 3
    assert neighbours.search(neighbours.build(v.limit(1)), q, 10).count() == 2
    none = v.limit(0)
    assert neighbours.build(none).count() == 0 and neighbours.search(neighbours.build(none), q, 10).count() == 0 and neighbours.search(neighbours.build(v), q.limit(0), 10).count() == 0
    assert neighbours.build(v.unionByName(v.select(F.lit(9).cast("long").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding")))).count() == 3
    # cells on an empty table
    centres = retrieve.fit_cells(none, 4)
    indexed = retrieve.in_cells(none, centres)
    assert indexed.count() == 0 and retrieve.choose_probes(indexed, centres, q, 5) == 0 and retrieve.approximate_search(indexed, centres, [1.0] * 24, 5, 0).count() == 0
