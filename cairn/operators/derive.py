"""Windows, packings and vectors of source text; `slicing` follows its structure.

A line's size in tokens is known to Spark; cutting a file into windows depends on what came before, so one small
function does it for a file at a time, inside ``mapInPandas`` over the files of a partition.
"""

from __future__ import annotations

import re
import time
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Token bounds of a window, the least gap, and the costs of a Markdown packing.
MIN_TOKENS, MAX_TOKENS, MIN_GAP = 128, 512, 24
CHUNK_COST, HEADING_COST, MARKDOWN_CAP = 0.35, 0.25, 1024
Tokenizer = Callable[[str], list[int]]
CHUNK = "doc_id long, start_line int, end_line int, tokens int, code string"


#: Characters that are looked at together.
PIECE = 1 << 16
_MARK, _SPACE, _WORD = range(3)


@cache
def _classes() -> np.ndarray:
    """What each code point is to TOKEN: a part of a word, white space, or a mark, which is a token of its own."""
    points, out = "".join(map(chr, range(0x110000))), np.full(0x110000, _MARK, np.uint8)
    for kind, run in ((_WORD, r"\w+"), (_SPACE, r"\s+")):
        for m in re.finditer(run, points):
            out[m.start() : m.end()] = kind
    return out


def token_starts(text: str) -> list[int]:
    """Character offsets at which tokens begin; any tokenizer of this signature can take its place."""
    out: list[int] = []
    within = False  # a word goes on from the piece before
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        kinds = _classes()[np.frombuffer(piece.encode() if piece.isascii() else piece.encode("utf-32-le", "surrogatepass"), np.uint8 if piece.isascii() else np.uint32)]
        word = kinds == _WORD
        begins = word.copy()
        begins[0] &= not within
        begins[1:] &= ~word[:-1]
        begins |= kinds == _MARK
        out += (np.flatnonzero(begins) + at).tolist()
        within = bool(word[-1])
    return out


def windows(text: str, tokenizer: Tokenizer = token_starts, most: int = MAX_TOKENS, least: int = MIN_GAP) -> list[tuple[int, int]]:
    """Whole-line windows (start, end) of at most ``most`` tokens that cover the text.

    A full window ends at its last blank line if ``least`` tokens precede it; a line of too many tokens is cut at token
    starts; a short tail joins the window before it where it fits.
    """
    starts = tokenizer(text)
    bounds = [0, *(m.end() for m in re.finditer("\n", text))]
    if bounds[-1] != len(text):
        bounds.append(len(text))
    count = lambda a, b: bisect_right(starts, b - 1) - bisect_right(starts, a - 1)
    out, at, k = [], 0, 0
    while at < len(text):
        j = k + 1
        while j < len(bounds) - 1 and count(at, bounds[j + 1]) <= most:
            j += 1
        end = bounds[j]
        if count(at, end) > most:  # one line is too long
            end = starts[bisect_right(starts, at - 1) + most]
            out.append((at, end))
            at = end
            continue
        if j < len(bounds) - 1:
            blank = next((b for b in range(j, k, -1) if not text[bounds[b - 1] : bounds[b]].strip() and count(at, bounds[b]) >= least), None)
            if blank is not None:
                j, end = blank, bounds[blank]
        out.append((at, end))
        at, k = end, j
    if len(out) > 1 and count(*out[-1]) < least and count(out[-2][0], out[-1][1]) <= most:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


#: Files that a task unpacks at once, and rows that it tells at once, whatever the size of an Arrow batch.
FILES, ROWS = 64, 4096
#: Texts that a model is given at once.
TEXTS = 512
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def read_batches(batches: Iterable[pa.RecordBatch], rows_of: Callable[..., Iterable[tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """The rows that ``rows_of`` yields for each file of the batches, a few files and rows at a time."""
    names, types = zip(*((name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))

    rows: list[tuple] = []
    for b in batches:
        for at in range(0, b.num_rows, FILES):
            for file in zip(*(c.to_pylist() for c in b.slice(at, FILES).columns)):
                for row in rows_of(*file):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield batch(rows)
                        rows = []
    if rows:
        yield batch(rows)


def by_file(files: DataFrame, rows_of: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``rows_of`` yields for each file (its columns as arguments)."""
    return files.mapInArrow(lambda batches: read_batches(batches, rows_of, schema), schema)


def slice_files(files: DataFrame, tokenizer: Tokenizer = token_starts, most: int = MAX_TOKENS) -> DataFrame:
    """doc_id, start_line, end_line, tokens, code for each window of each file (doc_id, text)."""

    def cut(doc: int, text: str | None) -> Iterator[tuple]:
        text, line = text or "", 1
        for a, b in windows(text, tokenizer, most):
            code = text[a:b]
            yield doc, line, line + code.rstrip("\n").count("\n"), len(tokenizer(code)), code
            line += code.count("\n")

    return by_file(files.select("doc_id", "text"), cut, CHUNK)


def pack(tokens: list[int], levels: list[int], cap: int = MARKDOWN_CAP) -> list[int]:
    """Ends of the cheapest packing of blocks into chunks: each costs CHUNK_COST, each heading of level 3 or deeper
    inside one HEADING_COST; headings of level 1 and 2 always begin one (level 0: no heading)."""
    n = len(tokens)
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        size, cost = 0, CHUNK_COST
        for start in range(end - 1, -1, -1):
            size += tokens[start]
            if size > cap and start < end - 1:
                break
            if best[start] + cost < best[end]:
                best[end], back[end] = best[start] + cost, start
            if levels[start] in (1, 2):
                break
            cost += HEADING_COST if levels[start] >= 3 else 0
    ends, at = [], n
    while at:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def pack_markdown(blocks: DataFrame, cap: int = MARKDOWN_CAP) -> DataFrame:
    """doc_id, chunk, first, last, tokens from (doc_id, tokens, levels): one row per document with its blocks as arrays."""

    def packed(doc: int, t: list[int], h: list[int]) -> Iterator[tuple]:
        at = 0
        for k, end in enumerate(pack(t, h, cap)):
            yield doc, k, at, end - 1, sum(t[at:end])
            at = end

    return by_file(blocks.select("doc_id", "tokens", "levels"), packed, "doc_id long, chunk int, first int, last int, tokens int")


def hash_vector(text: str, dim: int) -> np.ndarray:
    """A unit Gaussian vector seeded by the text: equal texts have equal vectors."""
    v = np.random.default_rng(xxhash.xxh64_intdigest(text)).standard_normal(dim)
    return v / np.linalg.norm(v)


class Busy(Exception):
    """What a model raises when it may be asked again."""


def patient(model: Callable[[list[str]], np.ndarray], texts: list[str], tries: int, wait_s: float, budget_s: float) -> np.ndarray:
    """The model's answer; a busy one is asked again after ever longer waits, within the tries and the seconds given."""
    began = time.monotonic()
    for k in range(tries):
        try:
            return model(texts)
        except Busy:
            pause = wait_s * 2**k
            if k + 1 == tries or time.monotonic() - began + pause > budget_s:
                raise
            time.sleep(pause)
    raise ValueError("tries must be positive")


def embed(text: Column, dim: int = 64, model: Callable[[list[str]], np.ndarray] | None = None, tries: int = 4, wait_s: float = 0.5, budget_s: float = 60.0) -> Column:
    """Vectors of texts, TEXTS of them at a time; every row of the model's answer must have ``dim`` numbers.

    A model that raises Busy is asked again, ``tries`` times at most and for ``budget_s`` seconds of a batch.
    """

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (whole.slice(at, TEXTS) for whole in batches for at in range(0, max(len(whole), 1), TEXTS)):
            rows = [t or "" for t in texts.to_pylist()]
            got = patient(model, rows, tries, wait_s, budget_s) if model else np.array([hash_vector(t, dim) for t in rows]).reshape(len(rows), dim)
            if got.shape != (len(rows), dim):
                raise ValueError(f"the model returned {got.shape}, not {(len(rows), dim)}")
            flat = pa.array(np.ascontiguousarray(got, np.float32).reshape(-1))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), flat)

    return vectors(text)
