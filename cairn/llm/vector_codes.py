"""Vector code compression: product codes over integer vectors, with a partial-distance search for the nearest entry.

A vector is scaled to integers and cut into parts of equal length. Each part position has a codebook of at most ENTRIES
entries, so a code is a byte a part. A search for the nearest entry takes the dimensions in the order of descending
variance of the codebook, adds up integer distances, and drops an entry as soon as its sum strictly exceeds the best
complete distance of the vector; so what stays is exact, ties included.

The codebooks (ENTRIES * dimension integers) go to the tasks by value. A round of training is one pass over the vectors,
in which every task hands on sums by part and entry; no vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, settle, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components beyond this would not keep integer distances within 64 bits; such vectors are dropped.
MOST = 1 << 26
#: Vectors that are compared with a codebook at once.
ROWS = 1024
#: Dimensions of a vector at most: bounds what a codebook takes (8 MiB) and a distance.
MOST_DIMENSIONS = 4096


def usable(v: Column) -> Column:
    """Not null, with finite components within MOST only."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE <= MOST)), F.lit(False))


def integers(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale * x); all vectors are of one length."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return flat.astype(np.int64).reshape(len(vectors), -1 if len(vectors) else 0)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest row of ``book`` (of equally near ones the first) and its squared distance."""
    at, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    if not book.shape[1]:
        at[:], best[:] = 0, 0
        return at, best
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    for lo in range(0, len(x), ROWS):
        own = x[lo : lo + ROWS]
        at[lo : lo + ROWS], best[lo : lo + ROWS] = _nearest(own[:, order], book[:, order])
    return at, best


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dims, every = book.shape[1], np.arange(len(x))
    sums = (x[:, :1] - book[:, 0]) ** 2
    # a first complete distance: of the entry that is nearest so far
    best = ((x - book[sums.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for d in range(1, dims):
        sums = sums + (x[row, d] - book[entry, d]) ** 2
        on = sums <= best[row]
        row, entry, sums = row[on], entry[on], sums[on]
        if d in (dims // 8, dims // 4, dims // 2):  # the entry that leads now is completed and may lower the bound
            heads = np.searchsorted(row, every)
            lead = np.minimum.reduceat(sums, heads)
            first = np.flatnonzero(sums == lead[row])
            first = first[np.searchsorted(row[first], every)]
            best = np.minimum(best, ((x - book[entry[first]]) ** 2).sum(axis=1))
    heads = np.searchsorted(row, every)  # rows stay in order, and each keeps its nearest entry to the end
    best = np.minimum.reduceat(sums, heads)
    first = np.flatnonzero(sums == best[row])
    return entry[first[np.searchsorted(row[first], every)]], best


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def vectors_of(df: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str | None) -> tuple[DataFrame, int]:
    """The usable vectors of the commonest length (of equally common ones the longest) as (vec_id, label, v)."""
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = size.dim if size else 0
    if dim % parts or dim > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts of {MOST_DIMENSIONS} components in all")
    return rows.where(F.size("v") == dim), dim


def first_entries(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the ``entries`` smallest ids; of rows that repeat an id the smallest vector, null ids come last."""
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    own = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    first = rows.where(own).groupBy("vec_id").agg(F.min("v").alias("v")).collect()  # ``entries`` rows at most
    place = {i: k for k, i in enumerate(ids)}
    first.sort(key=lambda r: place[r.vec_id])
    return cut(integers(pa.array([r.v for r in first], pa.list_(pa.float64()))), parts) if first else []


def trained(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floor of the mean of the parts that are nearest to it; unused ones stay."""
    width = books[0].shape[1]
    names = ["part", "entry", "n", *[f"s{d}" for d in range(width)]]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((len(books), len(books[0]), width), np.int64)
        for batch in batches:
            if batch.num_rows:
                for p, x in enumerate(cut(integers(batch.column(0)), len(books))):
                    at, _ = nearest(x, books[p])
                    count[p] += np.bincount(at, minlength=len(count[p]))
                    np.add.at(total[p], at, x)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, e, count[p, e], *total[p, e].T)], names)

    each = rows.select("v").mapInArrow(add_up, ", ".join(f"{n} long" for n in names))
    # at most parts * entries rows
    got = each.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect()
    out = [b.copy() for b in books]
    for r in got:
        out[r.part][r.entry] = [r[n] // r.n for n in names[3:]]
    return out


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for entry in b.tolist() for c in entry).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error."""
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = [nearest(x, books[p]) for p, x in enumerate(cut(integers(batch.column(2)), len(books)))]
                codes = np.stack([at for at, _ in got], axis=1).astype(np.uint8)
                error = np.sum([d for _, d in got], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], schema.names)

    return rows.select("vec_id", "label", "v").mapInArrow(coded, schema)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte a part: 1 to 256 entries")
    books = first_entries(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = trained(rows, books)
    return books


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """The codes of all usable vectors (vec_id, label, code, error), and the codebooks.

    Dropped are rows whose vector is null or has a null, infinite or not-a-number component, one beyond MOST / SCALE, or
    another length than most vectors have. Repeated rows are coded alike, and each is a part of the mean; null ids come
    last among the first entries; ties of distance go to the lower entry. An empty table gives an empty result and no
    codebooks. Only the named columns are read, so others may have any name.
    """
    rows, _ = vectors_of(df, parts, id_col, vector_col, label_col)
    books = fit(rows, parts, entries, rounds)
    if not books:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    return encode(rows, books), books


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the sum of the error over equal labels; null labels are one. The codes are written, so
    that no vector is encoded again for the sums."""
    codes = settle(codes)
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(broadcast_if_small(sums, sums.count(), 32), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    width = 64 // PARTS  # the vectors of the table have 64 components
    near = """
a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min((CAST(xx - 2 * list_inner_product(x, c) + cc AS BIGINT), entry)) AS best FROM p JOIN b{k} USING (part) GROUP BY vec_id, part)"""
    means = ", ".join(f"floor(sum(x[{d}]) / count(*))" for d in range(1, width + 1))
    learn = f"""
s{{k}} AS (SELECT part, best[2] AS entry, [{means}] AS c FROM a{{k}} GROUP BY ALL),
b{{n}} AS MATERIALIZED (SELECT part, entry, c, list_inner_product(c, c) AS cc FROM (SELECT part, entry, coalesce(s{{k}}.c, b{{k}}.c) AS c FROM b{{k}} LEFT JOIN s{{k}} USING (part, entry)))"""
    rounds = "".join(f"{near.format(k=k)},{learn.format(k=k, n=k + 1)}," for k in range(ROUNDS)) + near.format(k=ROUNDS)
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id, CAST(part AS BIGINT) AS part, x[part * {width} + 1 : part * {width} + {width}] AS x FROM v, range({PARTS}) t(part)),
p AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM q),
b0 AS MATERIALIZED (SELECT part, row_number() OVER w - 1 AS entry, x AS c, xx AS cc FROM p WINDOW w AS (PARTITION BY part ORDER BY vec_id) QUALIFY row_number() OVER w <= {ENTRIES}),{rounds},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda z: CAST(CAST(z AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), books
"""


SQL = _sql()
