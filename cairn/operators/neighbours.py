"""Approximate search by neighbour graphs, one in each part of the vectors.

A part holds a bounded number of vectors, dealt by hash of their id. Within it every vector links to its nearest ones and
to some drawn by hash, so that no region is cut off. A search begins at the best of a few entries, looks again and again
at the links of the nearest vector that it has not looked at, and keeps a list of the ``ef`` nearest so far; it ends when
the list has nothing new. The parts' answers are merged. Parts are built and searched in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import QUERY_BLOCK, Best, query_blocks, ranked

#: Vectors of a part at most, on average; links to the nearest and to drawn ones; entries of a search.
PART_ROWS, NEAREST, FAR, ENTRIES = 8192, 16, 4, 64
#: Rows of a part whose distances are computed at once.
SLICE = 1024
#: Queries that walk a part's graph together.
WALKERS = 64
INDEX = "part int, pos int, vec_id long, embedding array<float>, links array<int>"


def _units(column: pa.Array, rows: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float32).reshape(rows, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part, from batches in the order of their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and held[0].column(0)[0].as_py() != int(part[a]):
                    yield pa.concat_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def link(x: np.ndarray, nearest: int, far: int) -> np.ndarray:
    """For each row of unit vectors the places of its ``nearest`` and of ``far`` drawn ones (fewer in a small part)."""
    n, k = len(x), min(nearest, len(x) - 1)
    out = np.empty((n, k + (far if n > 1 else 0)), np.int32)
    for lo in range(0, n, SLICE):
        score = x[lo : lo + SLICE] @ x.T
        score[np.arange(len(score)), np.arange(lo, lo + len(score))] = -np.inf
        if k:
            out[lo : lo + SLICE, :k] = np.argpartition(score, -k, axis=1)[:, -k:]
    if n > 1:
        out[:, k:] = np.random.default_rng(n).integers(0, n, (n, far))
    return out


def build(vectors: DataFrame, part_rows: int = PART_ROWS, nearest: int = NEAREST, far: int = FAR) -> DataFrame:
    """part, pos, vec_id, embedding, links of vectors (vec_id, embedding of one length); to be written by part.

    The work of a part is the square of its bounded size. Null vectors are left out; an empty table gives an empty index.
    """
    parts = max(1, math.ceil(vectors.count() / part_rows))
    rows = vectors.where("embedding is not null").select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _parts(batches):
            links = link(_units(own.column(2), own.num_rows), nearest, far)
            lists = pa.ListArray.from_arrays(np.arange(0, links.size + 1, max(links.shape[1], 1), dtype=np.int32)[: len(links) + 1] if links.shape[1] else np.zeros(len(links) + 1, np.int32), pa.array(links.ravel()))
            pos = pa.array(np.arange(own.num_rows, dtype=np.int32))
            for lo in range(0, own.num_rows, SLICE):
                cols = [own.column(0), pos, own.column(1), own.column(2), lists]
                yield pa.RecordBatch.from_arrays([c.slice(lo, SLICE) for c in cols], ["part", "pos", "vec_id", "embedding", "links"])

    return rows.repartition(parts, "part").sortWithinPartitions("part", "vec_id").mapInArrow(linked, INDEX)


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, ef: int, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the places and scores of the nearest ``ef`` that best-first search finds, the best first.

    The queries take their steps side by side; one that has looked at all of its list waits for the others.
    """
    n, m = len(x), len(q)
    ef = min(ef, n)
    seen = np.zeros((m, n), bool)
    begin = np.unique(np.linspace(0, n - 1, min(max(entries, ef), n)).astype(np.int64))
    score = q @ x[begin].T
    seen[:, begin] = True
    take = np.argsort(-score, axis=1, kind="stable")[:, :ef]
    place, score = begin[take], np.take_along_axis(score, take, 1)
    looked, row = np.zeros(place.shape, bool), np.arange(m)
    while links.shape[1] and not looked.all():
        best = np.argmin(looked, axis=1)  # the lists are sorted: the first that has not been looked at
        on = ~looked[row, best]
        looked[row, best] = True
        near = links[place[row, best]]
        new = ~seen[row[:, None], near] & on[:, None]
        seen[row[:, None], near] |= on[:, None]
        # repeats within a vector's links are dropped by their first place
        order = np.argsort(near, axis=1, kind="stable")
        again = np.zeros_like(new)
        sorted_ = np.take_along_axis(near, order, 1)
        np.put_along_axis(again, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
        found = np.where(new & ~again, np.einsum("md,mkd->mk", q, x[near]), -np.inf)
        score, place, looked = np.hstack([score, found]), np.hstack([place, near]), np.hstack([looked, ~np.isfinite(found)])
        take = np.argsort(-score, axis=1, kind="stable")[:, :ef]
        score, place, looked = (np.take_along_axis(a, take, 1) for a in (score, place, looked))
    return place, score


def search(index: DataFrame, queries: DataFrame, top_k: int, ef: int = 96, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, vec_id, score, rank) of queries (q, embedding) by cosine; a query does not find itself.

    Queries go to the tasks in blocks of bounded size; a task holds one part. ``ef`` trades time for recall.
    """
    found = []
    rows = index.select("part", "pos", "vec_id", "embedding", "links")
    for asked in query_blocks(queries.select("q", "embedding"), block):
        ids = np.array([r.q for r in asked], np.int64)
        mat = np.array([r.embedding for r in asked], np.float32).reshape(len(asked), -1)
        mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-30)

        def best(batches: Iterator[pa.RecordBatch], ids=ids, mat=mat) -> Iterator[pa.RecordBatch]:
            top = Best(len(ids), top_k)
            for own in _parts(batches):
                x, vec = _units(own.column(3), own.num_rows), np.asarray(own.column(2))
                links = np.asarray(own.column(4).flatten()).reshape(own.num_rows, -1)
                for lo in range(0, len(ids), WALKERS):
                    place, score = walk(x, links, mat[lo : lo + WALKERS], max(ef, top_k + 1))
                    exact = np.einsum("md,mkd->mk", mat[lo : lo + WALKERS].astype(np.float64), x[place].astype(np.float64))
                    for i, (p, s) in enumerate(zip(place, exact), lo):
                        other = vec[p] != ids[i]
                        top.add(i, np.round(s[other], digits), vec[p][other])
            yield top.rows(ids, "vec_id")

        found.append(rows.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(best, "q long, vec_id long, score double"))
    empty = index.select(F.col("vec_id").alias("q"), "vec_id", F.lit(0.0).alias("score"))
    return ranked(found, empty, top_k, "vec_id")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """q, hits, wanted: how many of the exact answers (q, vec_id) were found."""
    hit = exact.join(found.select("q", "vec_id", F.lit(1).alias("_hit")), ["q", "vec_id"], "left")
    return hit.groupBy("q").agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))
