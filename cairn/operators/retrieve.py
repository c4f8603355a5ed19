"""Retrieval: exact cosine, BM25, symbols, literal search, fusion."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .provenance import settle

#: Words that BM25 queries leave out.
STOP = """
the and for are but not you all can her was one our out day get has him his how its may new now old see two way who boy
did use with this that from they will would there their what when which into than them then these those some such only
also been have more most other over
""".split()
#: Fixed value: the shape of a term.
TERM = "[A-Za-z_][A-Za-z0-9_]+"
K1, B, RRF_K = 1.2, 0.75, 60
#: Queries that go to the tasks at once, and those of them that are scored at once.
QUERY_BLOCK, SCORED = 4096, 256
#: Texts that a task unpacks at once, whatever the size of an Arrow batch.
TEXTS = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def dense_search(vectors: DataFrame, query: Sequence[float], top_k: int, candidates: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """The ``top_k`` vectors nearest to one query: vec_id, score. The candidates' semi-join comes before the scoring."""
    if candidates is not None:
        vectors = vectors.join(candidates.select("vec_id"), "vec_id", "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", F.round(cosine(F.col("embedding"), q), digits).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(top_k)


def query_blocks(queries: DataFrame, block: int) -> Iterator[list]:
    """The rows of a stated query set in hashed blocks of about ``block``, one on the driver at a time."""
    n = max(1, -(-queries.count() // block))
    for k in range(n):
        rows = (queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == k) if n > 1 else queries).collect()
        if rows:
            yield rows


class Best:
    """The ``top_k`` best documents of every query that a task has seen: by score, then by id."""

    def __init__(self, n: int, top_k: int) -> None:
        self.k = top_k
        self.score, self.doc = [np.empty(0)] * n, [np.empty(0, np.int64)] * n

    def add(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        if len(score) > self.k:  # ties with the last one stay until ids decide
            on = score >= np.partition(score, -self.k)[-self.k]
            score, doc = score[on], doc[on]
        score, doc = np.r_[self.score[q], score], np.r_[self.doc[q], doc]
        take = np.lexsort((doc, -score))[: self.k]
        self.score[q], self.doc[q] = score[take], doc[take]

    def rows(self, ids: np.ndarray, name: str) -> pa.RecordBatch:
        q = np.repeat(ids, [len(x) for x in self.doc])
        return pa.record_batch([pa.array(q), pa.array(np.concatenate([*self.doc, np.empty(0, np.int64)])), pa.array(np.concatenate([*self.score, np.empty(0)]))], ["q", name, "score"])


def ranked(parts: list[DataFrame], schema: DataFrame, top_k: int, by: str) -> DataFrame:
    """The final ranking of what the tasks kept; ``schema`` stands in where there was no query."""
    out = schema.limit(0) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), by))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k)


def dense_search_batch(vectors: DataFrame, queries: DataFrame, top_k: int, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, vec_id, score, rank) for many queries (q, embedding); a query does not find itself.

    Queries go to the tasks in blocks of bounded size. Each Arrow batch of vectors is scored by matrix products of SCORED
    queries, and a task keeps its best ``top_k`` of each query over all its batches, so little is shuffled.
    """
    parts = []
    for rows in query_blocks(queries.select("q", "embedding"), block):
        ids = np.array([r.q for r in rows], np.int64)
        mat = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)
        mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)

        def best(batches: Iterator[pa.RecordBatch], ids=ids, mat=mat) -> Iterator[pa.RecordBatch]:
            top = Best(len(ids), top_k)
            for b in batches:
                if not b.num_rows:
                    continue
                vec = np.asarray(b.column(0))
                x = np.asarray(b.column(1).flatten(), np.float64).reshape(len(vec), -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                for lo in range(0, len(ids), SCORED):
                    score = np.round(mat[lo : lo + SCORED] @ x.T, digits)
                    for i, row in enumerate(score, lo):
                        other = vec != ids[i]
                        top.add(i, row[other], vec[other])
            yield top.rows(ids, "vec_id")

        parts.append(vectors.select("vec_id", "embedding").mapInArrow(best, "q long, vec_id long, score double"))
    empty = vectors.select(F.col("vec_id").cast("long").alias("q"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    return ranked(parts, empty, top_k, "vec_id")


def fit_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of ``cells`` cells, by k-means over about ``sample`` unit vectors drawn by hash of their id.

    Only the fit sees a sample; every vector is indexed. The centres are what is kept on the driver: cells x dimension.
    """
    n = vectors.count()
    if not n:
        return np.empty((0, 0))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_003)) < 1_000_003 * min(1.0, sample / max(n, 1)))
    x = np.array([r.embedding for r in drawn.orderBy("vec_id").select("embedding").collect()], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].sum(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def in_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, embedding, cell: the cell of the nearest centre. Written with partitionBy("cell"), a search reads few folders."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(np.argmax(x @ centres.T, axis=1).astype(np.int32))], ["vec_id", "embedding", "cell"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(assign, "vec_id long, embedding array<float>, cell int")


def choose_probes(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, top_k: int, least: float = 0.9) -> int:
    """The fewest cells to probe so that the exact answers of a stated set of queries (q, embedding) are found to a share ``least``."""
    if not len(centres):
        return 0
    best = dense_search_batch(indexed, queries, top_k).join(indexed.select("vec_id", "cell"), "vec_id").select("q", "cell").collect()  # top_k rows a query
    place = {r.q: np.argsort(np.argsort(-(centres @ np.asarray(r.embedding, np.float64)), kind="stable")) for r in queries.collect()}
    needed = np.sort([place[r.q][r.cell] + 1 for r in best])
    return int(needed[min(int(np.ceil(least * len(needed))), len(needed)) - 1]) if len(needed) else len(centres)


def approximate_search(indexed: DataFrame, centres: np.ndarray, query: Sequence[float], top_k: int, probes: int, digits: int = 6) -> DataFrame:
    """The ``top_k`` of the ``probes`` cells nearest to a query, by exact cosine: vec_id, score."""
    q = np.asarray(query, np.float64)
    nearest = np.argsort(-(centres @ q), kind="stable")[:probes] if len(centres) else []
    return dense_search(indexed.where(F.col("cell").isin([int(c) for c in nearest])), query, top_k, digits=digits)


def terms(text: Column) -> Column:
    """The lower-cased terms of three characters or more that are no stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOP))


def postings(docs: DataFrame, asked: Sequence[str], words: bool, substrings: bool) -> DataFrame:
    """What of the asked terms each document has, in one reading of its text; every document has a row.

    words: wdl counts the document's terms, whits are the places in ``asked`` of those that are asked, with repeats.
    substrings, as an index of trigrams finds them: a term counts wherever its characters stand, also within words and
    over itself; tdl counts the document's trigrams, thits are places, with repeats.
    """
    stop, place = frozenset(STOP), {t: i for i, t in enumerate(asked)}
    kinds = [("wdl", "whits")] * words + [("tdl", "thits")] * substrings

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, finder = re.compile(TERM), ahocorasick.Automaton()
        for t, i in place.items():
            finder.add_word(t, i)
        if place:
            finder.make_automaton()
        for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            sizes, hits = {k: [] for k, _ in kinds}, {h: [] for _, h in kinds}
            for text in b.column(1).to_pylist():
                text = (text or "").lower()
                if words:
                    own = [w for w in word.findall(text) if len(w) > 2 and w not in stop]
                    sizes["wdl"].append(len(own)), hits["whits"].append([place[w] for w in own if w in place])
                if substrings:
                    sizes["tdl"].append(max(len(text) - 2, 0)), hits["thits"].append([i for _, i in finder.iter(text)] if place else [])
            cols = [c for k, h in kinds for c in (pa.array(sizes[k], pa.int32()), pa.array(hits[h], pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *(name for kind in kinds for name in kind)])

    schema = ", ".join(["doc_id long", *(f"{k} int, {h} array<int>" for k, h in kinds)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, schema)


def bm25_legs(docs: DataFrame, queries: DataFrame, legs: Mapping[str, tuple[int, bool]], k1: float = K1, b: float = B, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(leg, q, doc_id, score, rank): Robertson BM25 of the queries' OR-ed distinct terms, for several ways to match them.

    docs: doc_id, text; queries: q, text; legs: by name its ``top_k`` and whether terms match anywhere, as in a trigram
    index, or as whole words. Each document is read once for a block of queries and keeps only the terms that are asked,
    for all legs; their document frequencies are counted; then each task scores its documents and keeps its best of
    each query.
    """
    parts: dict[str, list[DataFrame]] = {leg: [] for leg in legs}
    for rows in query_blocks(queries.select("q", F.array_distinct(terms(F.col("text"))).alias("t")), block):
        ids, asked = np.array([r.q for r in rows], np.int64), sorted({t for r in rows for t in r.t})
        place = {t: i for i, t in enumerate(asked)}
        of = [[] for _ in asked]  # the queries of each term
        for i, r in enumerate(rows):
            for t in r.t:
                of[place[t]].append(i)
        many = np.array([len(x) for x in of], np.int64)
        first, who = np.r_[0, np.cumsum(many)[:-1]] if len(many) else many, np.array([i for x in of for i in x], np.int64)
        anywhere = {a for _, a in legs.values()}
        posted = settle(postings(docs, asked, False in anywhere, True in anywhere))
        for leg, (top_k, substrings) in legs.items():
            dl_col, hits = ("tdl", "thits") if substrings else ("wdl", "whits")
            size = posted.agg(F.count(F.lit(1)).alias("n"), F.avg(dl_col).alias("avgdl")).first()
            df = np.zeros(len(asked))
            for r in posted.select(F.explode(F.array_distinct(hits)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # a row per asked term
                df[r.t] = r.df
            idf = np.log(1 + (size.n - df + 0.5) / (df + 0.5))

            def best(batches: Iterator[pa.RecordBatch], ids=ids, idf=idf, many=many, first=first, who=who, top_k=top_k, avgdl=float(size.avgdl or 1), terms_=max(len(asked), 1)) -> Iterator[pa.RecordBatch]:
                top = Best(len(ids), top_k)
                for batch in batches:
                    for lo in range(0, batch.num_rows, SCORED):
                        part = batch.slice(lo, SCORED)
                        doc, dl, flat = np.asarray(part.column(0)), np.asarray(part.column(1)).astype(float), part.column(2).flatten()
                        held = np.asarray(flat).astype(np.int64)
                        at = np.repeat(np.arange(len(doc)), np.asarray(part.column(2).value_lengths()))
                        pair, tf = np.unique(at * terms_ + held, return_counts=True)
                        at, term = pair // terms_, pair % terms_
                        w = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[at] / avgdl))
                        n = many[term]  # a posting counts for every query that asks its term
                        q = who[np.repeat(first[term] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(n) else np.empty(0, np.int64)
                        cell, inverse = np.unique(q * len(doc) + np.repeat(at, n), return_inverse=True)
                        score = np.round(np.bincount(inverse, np.repeat(w, n), len(cell)), digits)
                        cut = np.searchsorted(cell, np.arange(len(ids) + 1) * len(doc))
                        for i in np.flatnonzero(cut[1:] > cut[:-1]):
                            own = slice(cut[i], cut[i + 1])
                            top.add(int(i), score[own], doc[cell[own] - i * len(doc)])
                yield top.rows(ids, "doc_id")

            parts[leg].append(posted.select("doc_id", dl_col, hits).mapInArrow(best, "q long, doc_id long, score double"))
    empty = docs.select(F.col("doc_id").cast("long").alias("q"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    out = [ranked(parts[leg], empty, top_k, "doc_id").select(F.lit(leg).alias("leg"), "q", "doc_id", "score", "rank") for leg, (top_k, _) in legs.items()]
    return reduce(DataFrame.unionByName, out)


def bm25(docs: DataFrame, queries: DataFrame, top_k: int, k1: float = K1, b: float = B, digits: int = 6, substrings: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, doc_id, score, rank) of one leg: of whole words, or with ``substrings`` of terms that match anywhere."""
    return bm25_legs(docs, queries, {"bm25": (top_k, substrings)}, k1, b, digits, block).drop("leg")


def random_ranker(docs: DataFrame, queries: DataFrame, top_k: int, seed: str = "0", block: int = QUERY_BLOCK) -> DataFrame:
    """Calibration: (q, doc_id, rank), the first ``top_k`` documents by a seeded hash of query and document.

    Queries go to the tasks in blocks; a task keeps its first ``top_k`` of each query.
    """
    out = None
    for rows in query_blocks(queries.select("q"), block):
        ids = [r.q for r in rows]

        def draw(batches: Iterator[pa.RecordBatch], ids=ids) -> Iterator[pa.RecordBatch]:
            top: list[list[tuple[str, int]]] = [[] for _ in ids]
            for b in batches:
                docs_ = b.column(0).to_pylist()
                for i, q in enumerate(ids):
                    top[i] = heapq.nsmallest(top_k, [*top[i], *((hashlib.md5(f"{seed}:{q}:{d}".encode()).hexdigest(), d) for d in docs_)])
            flat = [(q, d, h) for q, own in zip(ids, top) for h, d in own]
            yield pa.record_batch([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["q", "doc_id", "h"])

        part = docs.select(F.col("doc_id").cast("long")).mapInArrow(draw, "q long, doc_id long, h string")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select(F.col("doc_id").cast("long").alias("q"), F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("h")).limit(0)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("h", "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k).select("q", "doc_id", "rank")


def candidate_ids(*lists: DataFrame) -> DataFrame:
    """The ids (vec_id) that any of the include lists has, each once."""
    out = lists[0].select("vec_id")
    for more in lists[1:]:
        out = out.unionByName(more.select("vec_id"))
    return out.distinct()


def grep(chunks: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive literal search: the chunks that have ``pattern``, with the line of the first hit and its text."""
    at = F.instr(F.lower("code"), pattern.lower())
    before = F.substring(F.col("code"), F.lit(1), at - 1)
    line = F.col("start_line") + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    number = (line - F.col("start_line")).cast("int")
    excerpt = F.trim(F.get(F.split("code", "\n"), number))
    return chunks.where((F.col("status") == "active") & (at > 0)).select("path", "start_line", "end_line", line.cast("long").alias("match_line"), excerpt.alias("excerpt"))


def grep_counts(chunks: DataFrame, pattern: str, scope: Column) -> DataFrame:
    """What a search without hits tells: hits in and out of scope, chunks and files searched."""
    hit = F.contains(F.lower("code"), F.lit(pattern.lower()))
    live = chunks.where("status = 'active'")
    return live.agg(F.count_if(hit & scope).alias("total"), F.count_if(hit & ~scope).alias("out_of_scope"), F.count_if(scope).alias("searched_chunks"), F.countDistinct(F.when(scope, F.col("path"))).alias("searched_files"))


def normalised(runs: DataFrame, how: str) -> Column:
    """A leg's score on the scale ``how``, within each (leg, q); runs: leg, q, doc_id, score, rank."""
    w = Window.partitionBy("leg", "q")
    s, lo, hi = F.col("score"), F.min("score").over(w), F.max("score").over(w)
    n = F.count(F.lit(1)).over(w)
    return {
        "min-max": F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(F.lit(0.0)),
        "zmuv": F.when(F.stddev_pop("score").over(w) > 0, (s - F.avg("score").over(w)) / F.stddev_pop("score").over(w)).otherwise(F.lit(0.0)),
        "sum": F.when(hi > lo, (s - lo) / (F.sum("score").over(w) - n * lo)).otherwise(F.lit(0.0)),
        "max": s / hi,
        "rank": 1 - (F.col("rank") - 1) / n,
        "borda": (n - F.col("rank") + 1).cast("double") / n,
    }[how]


def fuse(runs: DataFrame, method: str, weights: dict[str, float] | None = None, norm: str = "min-max", top_k: int = 100, digits: int = 6) -> DataFrame:
    """(q, doc_id, score, rank) from several legs by wsum, rrf, sum, mnz, max or wmnz; a missing leg adds nothing."""
    value = 1.0 / (RRF_K + F.col("rank")) if method == "rrf" else F.col("norm")
    w = F.coalesce(F.create_map(*[x for k, v in (weights or {}).items() for x in (F.lit(k), F.lit(float(v)))])[F.col("leg")], F.lit(0.0)) if weights else F.lit(1.0)
    legs = runs if method == "rrf" else runs.withColumn("norm", normalised(runs, norm))
    legs = legs.withColumn("v", value * (w if method in ("wsum", "wmnz", "rrf") else F.lit(1.0)))
    score = {"max": F.max("v"), "mnz": F.sum("v") * F.count(F.lit(1)), "wmnz": F.sum("v") * F.count(F.lit(1))}.get(method, F.sum("v"))
    fused = legs.groupBy("q", "doc_id").agg(F.round(score, digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= top_k)


def best_per_chunk(runs: DataFrame) -> DataFrame:
    """One row per (leg, q, path, start_line, end_line): the best score, ranked anew within each leg and query."""
    key = ["path", "start_line", "end_line"]
    best = runs.groupBy("leg", "q", *key).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("leg", "q").orderBy(F.desc("score"), *key)))


def definition_counts(symbols: DataFrame, name: str, scope: Column, kind: str | None = None) -> DataFrame:
    """One row: total and out_of_scope of the definitions of exactly this name (and kind)."""
    found = symbols.where(F.col("name") == name)
    found = found if kind is None else found.where(F.col("kind") == kind)
    return found.agg(F.count_if(scope).alias("total"), F.count_if(~scope).alias("out_of_scope"))


def rerank(runs: DataFrame, depth: int, new_score: Column) -> DataFrame:
    """The first ``depth`` of each ranking by a new score; the rest keeps its order behind them. runs: q, doc_id, rank."""
    head = F.col("rank") <= depth
    scored = runs.withColumn("_head", head).withColumn("_new", F.when(head, new_score))
    order = Window.partitionBy("q").orderBy(F.desc("_head"), F.desc_nulls_last("_new"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).drop("_head", "_new")


def weight_grid(legs: int, step: float) -> list[tuple[float, ...]]:
    """Every weight vector of ``legs`` parts that sums to 1 in steps of ``step``."""
    parts = round(1 / step)

    def fill(left: int, k: int) -> list[tuple[int, ...]]:
        return [(left,)] if k == 1 else [(x, *rest) for x in range(left + 1) for rest in fill(left - x, k - 1)]

    return [tuple(x / parts for x in w) for w in fill(parts, legs)]


def outline(asked: DataFrame, files: DataFrame, symbols: DataFrame, scope: Column) -> DataFrame:
    """Definitions of the asked paths in source order, with the file's language, indexed, in_scope and the total.

    A path without definitions, or that is not indexed, keeps one row, so that its flags survive.
    """
    f = files.select("path", "programming_language", F.lit(True).alias("_f"))
    j = asked.select("path").distinct().join(f, "path", "left").join(symbols.select("path", "name", "start_line"), "path", "left")
    w = Window.partitionBy("path")
    j = j.withColumn("total", F.count("name").over(w)).withColumn("ord", F.row_number().over(w.orderBy("start_line", "name")))
    return j.select("path", "ord", "name", "start_line", "programming_language", F.coalesce("_f", F.lit(False)).alias("indexed"), scope.alias("in_scope"), "total")


def rank_files_by_symbols(asked: DataFrame, symbols: DataFrame, top_k: int = 100) -> DataFrame:
    """(q, path, idents, definitions, rank): files by distinct asked names defined, then definitions, then path.

    asked: q, name. A file's definitions of a name are counted before the join, which then has a row for each asked name
    and file, however often the file defines it.
    """
    held = symbols.groupBy("name", "path").agg(F.count(F.lit(1)).alias("_n"))
    wanted = asked.groupBy("q", "name").agg(F.count(F.lit(1)).alias("_times"))
    hit = wanted.join(held, "name").groupBy("q", "path").agg(F.count(F.lit(1)).alias("idents"), F.sum(F.col("_n") * F.col("_times")).alias("definitions"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("idents"), F.desc("definitions"), "path"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= top_k)


def lookup_symbols(symbols: DataFrame, name: str, anchor: str, limit: int) -> DataFrame:
    """Definitions of one name: those of the anchor file, then of its folder, then the rest; total tells how many."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    tier = F.when(F.col("path") == anchor, 0).when(folder(F.col("path")) == folder(F.lit(anchor)), 1).otherwise(2)
    found = symbols.where(F.col("name") == name).withColumn("tier", tier)
    total = found.count()
    return found.orderBy("tier", "path", "start_line").limit(limit).select("path", "start_line", "tier", F.lit(total).cast("long").alias("total"))


def nearest_container(spans: DataFrame, key: str = "path") -> DataFrame:
    """Each definition with the innermost one that strictly contains it (null: none). spans: key, name, kind, start, end.

    One sweep: a file's spans pass in the order of their starts, the longest first, beside a stack of those still open.
    What is taken off the stack cannot contain anything that follows: it ends before the span that replaced it, which
    starts later. Spans of equal places do not contain one another; of those the first by name is told. Spans sort on
    disk where they must, and a task holds no more than a file's open ones.
    """
    rows = spans.select(key, "name", "kind", "start", "end")
    schema = T.StructType([*rows.schema.fields, T.StructField("parent_name", rows.schema["name"].dataType), T.StructField("parent_kind", rows.schema["kind"].dataType)])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for batch in batches:
            names: list = []
            kinds: list = []
            for f, name, kind, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if (f,) != file:
                    file, open_ = (f,), []
                while open_ and (open_[-1][1] < end or open_[-1][:2] == (start, end)):
                    open_.pop()
                names.append(open_[-1][2] if open_ else None)
                kinds.append(open_[-1][3] if open_ else None)
                open_.append((start, end, name, kind))
            types = [f.type for f in batch.schema]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, types[1]), pa.array(kinds, types[2])], schema.names)

    return rows.repartition(key).sortWithinPartitions(key, "start", F.desc("end"), F.desc("name")).mapInArrow(sweep, schema)
