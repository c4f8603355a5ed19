"""Exact deduplication with counting quotient filters.

Every partition turns its 64-bit fingerprints into a counting quotient filter: the leading bits of a fingerprint (its
quotient) pick a row, the other bits (its remainder) are kept sorted beside their counts, so nothing is lost. The
pieces of one quotient meet in one small group and merge by their sorted remainders. Only texts whose fingerprint
counts above one are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, table

SPACES = r"[\x20\x09-\x0D]+"
#: Fingerprints that one quotient should hold over all partitions.
PER_QUOTIENT = 1 << 20
FILTER = "quotient long, remainders binary, counts binary"


def normalised(text="text"):
    """The text with every run of ASCII white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def quotient_bits(rows: int) -> int:
    return max(8, int(np.ceil(np.log2(max(rows, 1) / PER_QUOTIENT))))


def quotient_filters(prints: DataFrame, bits: int) -> DataFrame:
    """One counting quotient filter per partition of ``prints`` (column fp): a row for each quotient in use."""
    rest = np.uint64(64 - bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # unite once so much has gathered that it doubled: the working set follows the distinct fingerprints
        keys, counts, wait, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for b in batches:
            wait.append(np.asarray(b.column(0)).view(np.uint64))
            waiting += len(wait[-1])
            if waiting > max(1 << 16, len(keys)):
                keys, counts = merged([keys, *wait], [counts, *(np.ones(len(w), np.int64) for w in wait)])
                wait, waiting = [], 0
        keys, counts = merged([keys, *wait], [counts, *(np.ones(len(w), np.int64) for w in wait)])
        if len(keys):
            q = keys >> rest
            at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            low = keys & ((np.uint64(1) << rest) - np.uint64(1))
            for lo, hi in zip(range(0, len(at), 1024), [*range(1024, len(at), 1024), len(at)]):
                ends = [*at[lo + 1 : hi + 1], len(keys)][: hi - lo]
                yield pa.record_batch(
                    [
                        pa.array(q[at[lo:hi]].astype(np.int64)),
                        pa.array([low[a:e].tobytes() for a, e in zip(at[lo:hi], ends)], pa.binary()),
                        pa.array([counts[a:e].tobytes() for a, e in zip(at[lo:hi], ends)], pa.binary()),
                    ],
                    ["quotient", "remainders", "counts"],
                )

    return prints.select("fp").mapInArrow(build, FILTER)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all parts, each once, with the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.add.reduceat(c, at)


def merge_filters(filters: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """Merge the partitions' filters; return the fingerprints counted ``least`` times or more: fp, n."""

    def merge(piece: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in piece.column("remainders").to_pylist()]
        rem, n = merged(parts, [np.frombuffer(x, np.int64) for x in piece.column("counts").to_pylist()])
        base = np.uint64(piece.column("quotient")[0].as_py()) << np.uint64(64 - bits)
        on = n >= least
        return pa.table({"fp": (rem[on] | base).view(np.int64), "n": n[on]})

    return filters.groupBy("quotient").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normalisation; the smallest id of equal texts stays. A null text is an empty
    one, and all empty texts are equal. Rows without an id never become keep_id unless no equal row has one; a group in
    which every id is null keeps all its rows (keep_id null). Rows that repeat both id and text are the same document
    and share its verdict. Other columns are ignored. An empty input gives an empty result.
    """
    norm = normalised(text_col)
    # one pass over the texts; the narrow table is read twice
    narrow = settle(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(norm).alias("fp"), F.sha2(norm, 256).alias("text_sha256")))
    bits = quotient_bits(narrow.count())
    repeated = settle(merge_filters(quotient_filters(narrow, bits), bits))
    routed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).join(
        broadcast_if_small(repeated.select("fp"), repeated.count(), 48), F.xxhash64("norm") == F.col("fp"), "left_semi"
    )
    # byte verification: the whole text is the grouping key, combined within each task before the shuffle
    classes = routed.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = settle(classes.select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    out = narrow.join(broadcast_if_small(classes, classes.count(), 160), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
