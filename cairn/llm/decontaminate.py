"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document when tiles cover enough of it. Tiles are common runs of words that overlap
neither in the item nor in the document; the longest unmarked run is marked first, again and again, so passages whose
sentences were reordered are still covered. Runs are found with Karp-Rabin hashes of falling lengths. Only pairs that
share a seed (a run of MIN_TILE words) are tiled, and only if their seeds alone could cover enough.

The benchmark is a stated query set: it goes to the tasks in blocks of bounded size, one after the other, each block
against all documents in a map without a shuffle.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .shingles import windows, word_hashes

#: Words of the shortest tile, and the share of an item's words that tiles must cover.
MIN_TILE, COVERAGE = 5, 0.5
#: Characters of benchmark text that go to the tasks at once.
BLOCK_CHARS = 8 << 20
#: Above so many seed hits of one pair, its diagonals are swept instead of listing the hits.
MOST_HITS = 4_000_000
TILES = "array<struct<item_id: long, coverage: double, tiles: int, words: int, longest: int>>"


@dataclass
class Items:
    """A block of the benchmark: word numbers, and for each tile width the seeds of that width sorted by hash."""

    ids: list[int | None]
    tokens: list[np.ndarray]
    #: Sorted hashes of the items' words; a word's number is its place in it, from 1.
    vocabulary: np.ndarray
    #: By width: seed hashes, items and places. Items of fewer words than a tile have their own width.
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], min_tile: int) -> Items:
        hashed = [(item_id, h) for item_id, text in rows if len(h := word_hashes(text))]
        vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.empty(0, np.uint64)
        tokens = [numbered(h, vocabulary) for _, h in hashed]
        by: dict[int, list[int]] = {}
        for k, t in enumerate(tokens):
            by.setdefault(min(min_tile, len(t)), []).append(k)
        seeds = {}
        for width, own in by.items():
            w = [windows(tokens[k].astype(np.uint64), width) for k in own]
            seed = np.concatenate(w)
            order = np.argsort(seed, kind="stable")
            item = np.repeat(np.array(own, np.int32), [len(x) for x in w])
            pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in w])
            seeds[width] = (seed[order], item[order], pos[order])
        return cls([i for i, _ in hashed], tokens, vocabulary, seeds)

    def leaks(self, text: str | None, coverage: float) -> list[tuple[int | None, float, int, int, int]]:
        """(item_id, coverage, tiles, words covered, longest tile) of every item covered enough."""
        out = []
        d = numbered(word_hashes(text), self.vocabulary)
        for width, (seed, items, places) in self.seeds.items():
            if len(d) < width:
                continue
            w = windows(d.astype(np.uint64), width)[runs_of(d != 0, width)]
            w = np.unique(w)
            lo, hi = np.searchsorted(seed, w, "left"), np.searchsorted(seed, w, "right")
            lo, n = lo[hi > lo], (hi - lo)[hi > lo]
            if not len(lo):
                continue
            hit = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            item, pos = items[hit], places[hit]
            for k in np.unique(item):
                t = self.tokens[k]
                could = np.zeros(len(t) + 1, np.int64)
                np.add.at(could, pos[item == k], 1), np.add.at(could, pos[item == k] + width, -1)
                if (np.cumsum(could)[:-1] > 0).sum() < coverage * len(t):
                    continue
                tiles = greedy_tiles(d.astype(np.uint64), t.astype(np.uint64), width)
                covered = sum(x[2] for x in tiles)
                if covered >= coverage * len(t):
                    out.append((self.ids[k], covered / len(t), len(tiles), covered, max(x[2] for x in tiles)))
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1:]))


def numbered(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The number of each word in the vocabulary; 0: no item has the word."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.uint32)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


def runs_of(on: np.ndarray, width: int) -> np.ndarray:
    """Where ``width`` trues in a row begin."""
    c = np.r_[0, np.cumsum(on)]
    return c[width:] - c[:-width] == width


def common_runs(d: np.ndarray, t: np.ndarray, free_d: np.ndarray, free_t: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """All maximal common runs (start in d, start in t, length) of ``s`` unmarked words or more."""
    at_d, at_t = np.flatnonzero(runs_of(free_d, s)), np.flatnonzero(runs_of(free_t, s))
    if not len(at_d) or not len(at_t):
        return []
    hd, ht = windows(d, s)[at_d], windows(t, s)[at_t]
    order = np.argsort(ht, kind="stable")
    ht, at_t = ht[order], at_t[order]
    lo, n = np.searchsorted(ht, hd, "left"), np.searchsorted(ht, hd, "right")
    n = n - lo
    if not n.sum():
        return []
    if n.sum() > MOST_HITS:
        return swept_runs(d, t, free_d, free_t, s)
    i = np.repeat(at_d, n)
    j = at_t[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    head = np.r_[True, ((i - j)[1:] != (i - j)[:-1]) | (i[1:] != i[:-1] + 1)]
    at = np.flatnonzero(head)
    size = np.diff(np.r_[at, len(i)]) + s - 1
    return [(int(a), int(b), int(k)) for a, b, k in zip(i[at], j[at], size) if (d[a : a + k] == t[b : b + k]).all()]


def swept_runs(d: np.ndarray, t: np.ndarray, free_d: np.ndarray, free_t: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """The same for very repetitive words: diagonal by diagonal, in slices of bounded size."""
    m, out = len(t), []
    pad = np.zeros(m, np.uint64)
    x, free = np.r_[pad, np.where(free_d, d, 0), pad], np.where(free_t, t, 0)
    step = max(1, (1 << 22) // m)
    view = np.lib.stride_tricks.sliding_window_view(x, m)
    for lo in range(0, len(view), step):
        eq = (view[lo : lo + step] == free) & (free > 0)
        flat = np.zeros((len(eq), m + 2), np.int8)
        flat[:, 1:-1] = eq
        edge = np.diff(flat, axis=1)
        r0, c0 = np.nonzero(edge == 1)
        _, c1 = np.nonzero(edge == -1)
        on = c1 - c0 >= s
        out += [(int(a), int(b), int(k)) for a, b, k in zip((r0 + lo - m + c0)[on], c0[on], (c1 - c0)[on])]
    return out


def greedy_tiles(d: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs, the longest first; ties go to the earliest place in t, then in d."""
    free_d, free_t, tiles = d != 0, np.ones(len(t), bool), []
    s = max(least, min(len(t), 8 * least))
    while True:
        heap = [(-k, j, i) for i, j, k in common_runs(d, t, free_d, free_t, s)]
        heapq.heapify(heap)
        while heap:
            k, j, i = heapq.heappop(heap)
            ok = free_d[i : i - k] & free_t[j : j - k]
            if ok.all():
                free_d[i : i - k] = free_t[j : j - k] = False
                tiles.append((i, j, -k))
                continue
            edge = np.diff(np.r_[0, ok.astype(np.int8), 0])  # what is left of an occluded run competes again
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                if b - a >= s:
                    heapq.heappush(heap, (int(a - b), int(j + a), int(i + a)))
        if s == least:
            return tiles
        s = max(least, s // 2)


def blocks(benchmark: DataFrame, min_tile: int, block_chars: int, item_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Items, bool]]:
    """The benchmark in blocks of about ``block_chars``, one on the driver at a time, and whether it is the last."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n = max(1, math.ceil(total / block_chars))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Items.of([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()], min_tile), k == n - 1


def in_blocks(benchmark: DataFrame, min_tile: int, block_chars: int) -> Iterator[tuple[Broadcast, Callable[[DataFrame], DataFrame]]]:
    """Each block as it goes to the tasks, and a function for what was made with it: that is written, and the block
    destroyed before the next one goes out, so a task holds one block however large the benchmark is. The last block's
    is left as it is."""
    for items, last in blocks(benchmark, min_tile, block_chars):
        shared = benchmark.sparkSession.sparkContext.broadcast(items)

        def done(made: DataFrame, shared: Broadcast = shared, last: bool = last) -> DataFrame:
            if not last:
                made = settle(made)
                shared.destroy()
            return made

        yield shared, done


def leaks_column(shared: Broadcast, coverage: float, text_col: str = "text") -> Column:

    @F.pandas_udf(TILES)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "coverage", "tiles", "words", "longest"), x)) for x in shared.value.leaks(t, coverage)] for t in texts], dtype=object)

    return leaks(F.col(text_col))


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The leaking pairs: doc_id, item_id, coverage, tiles, words, longest.

    Words are lower-cased and compared by 64-bit hash. Null and empty texts, and items without words, leak nothing. An
    item of fewer than ``min_tile`` words is one tile: it leaks where all its words stand in a row. Texts of any length are
    read whole. An item without an
    id leaks with a null item_id. Repeated documents each get their rows; items that repeat an id each get theirs.
    Documents are read as (doc_id, text), items as (item_id, text); other columns are ignored. An empty table on either side gives an empty result.
    """
    found = [done(docs.select("doc_id", F.explode(leaks_column(shared, coverage)).alias("_l")).select("doc_id", "_l.*")) for shared, done in in_blocks(benchmark, min_tile, block_chars)]
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, all columns as they are, whatever their names.

    Rows with null or empty texts stay, repeated rows share their verdict, an empty benchmark drops nothing, and an
    empty table stays empty.
    """
    for shared, done in in_blocks(benchmark, min_tile, block_chars):
        docs = done(docs.where(F.size(leaks_column(shared, coverage)) == 0))
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
