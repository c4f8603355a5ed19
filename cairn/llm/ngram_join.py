"""N-gram Jaccard self-join with Bayesian pruning of candidates.

1. Each text becomes the set of its five-word shingles, a MinHash signature and band keys. Texts of equal sets are one
   class; only a representative goes on.
2. Representatives that share a band key meet in bounded blocks. Their MinHash values are compared a few at a time, and
   a pair is dropped once the posterior probability that its similarity reaches the threshold is below the tolerance.
   What survives gives candidate components.
3. In each component the surviving pairs are verified on whole shingle sets, block against block. Blocks return the
   number of links per member and a spanning forest, never the pairs, so a group of n near copies costs n rows per
   block it meets in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, table
from .graph import components
from .shingles import minhash, mix, runs, shingle_set

WIDTH, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**5)**28 = 1.5e-5.
BANDS, ROWS = 28, 5
#: A pair is dropped when its similarity reaches the threshold with less probability than this.
TOLERANCE = 1e-6
#: MinHash values compared at a time.
STEP = 20
#: Members of a block of signatures; members and shingles of a block that is verified.
SIGNATURES, BLOCK, BLOCK_SHINGLES = 4096, 1024, 1_000_000


def hash_family(n: int = BANDS * ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, np.uint64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among n MinHash values that leave P(similarity >= threshold) >= tolerance, prior uniform.

    The posterior is Beta(m + 1, n - m + 1); its upper tail equals the binomial P(X <= m) of n + 1 trials.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def checkpoints(threshold: float, tolerance: float) -> list[tuple[int, int, int]]:
    """(from, to, fewest matches among the first ``to`` values) for each step."""
    n = BANDS * ROWS
    return [(lo, min(lo + STEP, n), least_matches(min(lo + STEP, n), threshold, tolerance)) for lo in range(0, n, STEP)]


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, cls (null without words), n, sig (16 bits of each MinHash value), keys (one per band)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = hash_family()
        weigh = hash_family(ROWS, 11)[0]
        band = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in batches:
            cls, n, sig, keys = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                if not len(s):
                    cls.append(None), sig.append(None), keys.append(None)
                    continue
                m = minhash(s, mul, add)
                cls.append(xxhash.xxh128_digest(s.tobytes()))
                sig.append((m & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                keys.append(mix((m.reshape(BANDS, ROWS) * weigh).sum(1, dtype=np.uint64) ^ band).view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "cls", "n", "sig", "keys"])

    return docs.mapInArrow(describe, "doc_id long, cls binary, n int, sig binary, keys array<long>")


def in_blocks(members: DataFrame, key: str, blocks) -> DataFrame:
    """Deal the members of each key to ``blocks`` blocks; every pair of blocks meets in one group g, sorted together.

    within tells the group of a block with itself, whichever blocks turn out empty.
    """
    own = F.pmod(F.xxhash64("cid"), F.col("_nb"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1), lambda j: F.struct(F.least(j, F.col("_own")).alias("lo"), F.greatest(j, F.col("_own")).alias("hi")))
    dealt = members.withColumn("_nb", blocks.cast("long")).withColumn("_own", own).withColumn("_meet", F.explode(meet))
    dealt = dealt.withColumn("g", F.xxhash64(key, "_meet.lo", "_meet.hi")).withColumn("own", F.col("_own").cast("int")).withColumn("within", F.col("_meet.lo") == F.col("_meet.hi")).withColumn("whole", F.col("_nb") == 1)
    return dealt.drop("_nb", "_own", "_meet", key).repartition("g").sortWithinPartitions("g")


def surviving(sig: np.ndarray, one: int, others: np.ndarray, steps) -> np.ndarray:
    """Those of ``others`` that Bayesian pruning leaves beside ``one``."""
    m = np.zeros(len(others), np.int32)
    for lo, hi, need in steps:
        m += (sig[others, lo:hi] == sig[one, lo:hi]).sum(1)
        on = m >= need
        others, m = others[on], m[on]
        if not len(others):
            break
    return others


def candidate_edges(met: DataFrame, steps) -> DataFrame:
    """A spanning forest (a, b) of the surviving pairs of each group."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs(batches, "g"):
            cid = np.asarray(t.column("cid"))
            if len(cid) < 2:
                continue
            sig = values(t.column("sig"), np.uint16).reshape(len(cid), -1)
            left = np.arange(len(cid))
            while len(left) > 1:  # grow one tree at a time; whoever joins leaves the rest
                root, todo, left = left[0], [left[0]], left[1:]
                while todo and len(left):
                    near = surviving(sig, todo.pop(), left, steps)
                    if len(near):
                        left = np.setdiff1d(left, near, assume_unique=True)
                        todo += near.tolist()
                        a += cid[near].tolist()
                        b += [int(cid[root])] * len(near)
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.mapInArrow(link, "a long, b long")


def surviving_pairs(sig: np.ndarray, own: np.ndarray, within: bool, steps) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group that pruning leaves: within its block, or across its two, none where one of them is empty."""
    if within:
        i, j = np.triu_indices(len(own), 1)
    else:
        x, y = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
        i, j = np.repeat(x, len(y)), np.tile(y, len(x))
    m = np.zeros(len(i), np.int16)
    for lo, hi, need in steps:
        for k in range(lo, hi):
            m += sig[i, k] == sig[j, k]
        on = m >= need
        i, j, m = i[on], j[on], m[on]
        if not len(i):
            break
    return i, j


def values(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The bytes of a binary column as one array of numbers, in order."""
    parts = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8))
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).copy().view(kind)


def intersections(shingles: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs; the sets lie one after the other in ``shingles``."""
    start, n = np.r_[0, np.cumsum(size)[:-1]], len(size)
    if len(i) <= 8 * n:
        part = lambda x: shingles[start[x] : start[x] + size[x]]
        return np.array([len(np.intersect1d(part(x), part(y), assume_unique=True)) for x, y in zip(i, j)], np.int64)
    order = np.argsort(shingles, kind="stable")
    row = np.repeat(np.arange(n, dtype=np.int32), size)[order]
    key = shingles[order]
    new = np.r_[True, key[1:] != key[:-1]]
    more = ~(new & np.r_[new[1:], True])  # a shingle of one member is in no intersection
    row, col = row[more], np.cumsum(new[more]) - 1
    both = np.zeros((n, n), np.float32)
    last = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, last, 2048):
        at, to = np.searchsorted(col, [lo, lo + 2048])
        has = np.zeros((n, min(2048, last - lo)), np.float32)
        has[row[at:to], col[at:to] - lo] = 1
        both += has @ has.T
    return both[i, j].astype(np.int64)


def verified_links(met: DataFrame, steps, threshold: float) -> DataFrame:
    """A row for each member of each group: a (its cid), b (the root of its tree of links), texts and docs linked, and
    whole: the group is a component of its own, so that the trees are final."""
    t = Fraction(str(threshold))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "g"):
            cid, own, copies = (np.asarray(group.column(c)) for c in ("cid", "own", "copies"))
            n = len(cid)
            sig = values(group.column("sig"), np.uint16).reshape(n, -1)
            size = np.asarray(group.column("n")).astype(np.int64)
            i, j = surviving_pairs(sig, own, group.column("within")[0].as_py(), steps)
            inter = intersections(values(group.column("shingles"), np.uint64), size, i, j)
            on = inter * t.denominator >= t.numerator * (size[i] + size[j] - inter)
            i, j = i[on], j[on]
            texts, docs = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(texts, i, 1), np.add.at(texts, j, 1)
            np.add.at(docs, i, copies[j]), np.add.at(docs, j, copies[i])
            root = np.arange(n)
            while True:
                old = root.copy()
                np.minimum.at(root, i, old[j]), np.minimum.at(root, j, old[i])
                root = root[root]
                if (root == old).all():
                    break
            yield pa.record_batch([pa.array(cid), pa.array(cid[root]), pa.array(texts), pa.array(docs), group.column("whole").combine_chunks()], ["a", "b", "texts", "docs", "whole"])

    return met.mapInArrow(verify, "a long, b long, texts long, docs long, whole boolean")


def with_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cls and shingles of the texts of ``wanted`` (rep), each once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set(x.as_py(), width) for x in b.column(0)]
            yield pa.record_batch([pa.array([xxhash.xxh128_digest(x.tobytes()) for x in s], pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], ["cls", "shingles"])

    rows = docs.join(wanted.select("rep"), docs["doc_id"].eqNullSafe(wanted["rep"]), "left_semi")
    return rows.select("text").mapInArrow(sets, "cls binary, shingles binary").dropDuplicates(["cls"])


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, links, links_texts, kept.

    copy_id is the smallest id whose text has the same shingles; links counts the other documents of similarity
    ``threshold`` or more, links_texts those among different shingle sets; class_id is the smallest id of the connected
    group; its row is kept. Words are lower-cased; a text of fewer than ``width`` words is one shingle; null, empty and
    wordless texts have no shingles and link to nothing. Null ids rank last; a group of null ids only keeps all its
    rows. Rows that repeat an id and text count as copies and share its verdict. Shingles are compared by 64-bit hashes.
    Only the two named columns are read. An empty input gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    steps = checkpoints(threshold, tolerance)
    seen = settle(described(docs, width))
    classes = seen.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    one = seen.select(F.col("cls").alias("_cls"), "doc_id", "n", "sig", "keys")
    reps = classes.join(one, (F.col("cls") == F.col("_cls")) & F.col("rep").eqNullSafe(F.col("doc_id"))).dropDuplicates(["cls"])
    reps = settle(reps.select("cls", "rep", "copies", "n", "sig", "keys").withColumn("cid", F.monotonically_increasing_id()))

    # buckets of two or more; of those with the same members one is enough
    keyed = reps.select("cid", F.explode("keys").alias("key"))
    print_of = F.xxhash64("cid").cast("decimal(20,0)")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.sum(print_of).alias("sum")).where("n > 1")
    buckets = buckets.groupBy("n", "lo", "hi", "sum").agg(F.min("key").alias("key"))
    members = settle(keyed.join(buckets.select("key", F.col("n").alias("_size")), "key"))
    met = in_blocks(members.join(reps.select("cid", "sig"), "cid"), "key", F.ceil(F.col("_size") / SIGNATURES)).select("g", "cid", "sig")
    near = settle(components(candidate_edges(met, steps)))

    size = near.join(reps.select(F.col("cid").alias("id"), "n"), "id").groupBy("comp").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_n"))
    cand = near.join(looked_up(size, 40), "comp").select(F.col("id").alias("cid"), "comp", "_m", "_n").join(reps.select("cid", "cls", "rep", "copies", "n", "sig"), "cid")
    cand = settle(cand)
    full = cand.join(with_sets(docs, cand, width), "cls").drop("cls", "rep")
    blocks = F.greatest(F.ceil(F.col("_m") / BLOCK), F.ceil(F.col("_n") / BLOCK_SHINGLES))
    links = settle(verified_links(in_blocks(full, "comp", blocks).select("g", "cid", "own", "within", "whole", "copies", "n", "sig", "shingles"), steps, threshold))
    count = links.groupBy(F.col("a").alias("cid")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    # trees of components that several blocks shared are joined up; the others are final
    group = components(links.where("not whole").select("a", "b")).unionByName(links.where("whole and texts > 0").select(F.col("a").alias("id"), F.col("b").alias("comp")))
    group = group.join(reps.select(F.col("cid").alias("id"), "rep"), "id")
    group = settle(group)
    group = group.join(looked_up(group.groupBy("comp").agg(F.min("rep").alias("class_id")), 32), "comp").select(F.col("id").alias("cid"), "class_id")
    # classes of one document without links need no row here
    told = reps.select("cid", "cls", "rep", "copies").join(group, "cid", "left").join(count, "cid", "left").where("copies > 1 or class_id is not null or texts > 0")
    told = told.select("cls", "rep", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("texts", F.lit(0)).alias("links_texts"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = seen.select("doc_id", "cls").join(settle(told), "cls", "left")
    lone = F.col("links").isNull()
    class_id = F.when(lone, F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select(
        "doc_id", class_id.alias("class_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("rep")).alias("copy_id"),
        F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("links_texts", F.lit(0)).alias("links_texts"), F.col("doc_id").eqNullSafe(class_id).alias("kept"),
    )


def looked_up(table_: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, so that a join with a hot key of it can be split, or a broadcast if it is small."""
    table_ = settle(table_)
    return broadcast_if_small(table_, table_.count(), row_bytes)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("links_texts")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, i = na.n AND i = nb.n AS same FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
         WHERE 5 * i >= 4 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
cls AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, least(doc_id, coalesce(min(b) FILTER (same), doc_id)) AS copy_id, count(b) AS links, doc_id = class_id AS kept
FROM w JOIN cls ON cls.a = doc_id LEFT JOIN link ON link.a = doc_id GROUP BY doc_id, class_id
"""
