"""Words, word shingles and MinHash values of texts, in numpy; used inside tasks only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import NOT_WORD

_GAP = re.compile(NOT_WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut between words."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word, in order: the mixed sum of a value for every letter at its place in the word."""
    out = []
    for piece in pieces((text or "").lower()):
        c = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        is_word = ((c >= 48) & (c <= 57)) | ((c >= 97) & (c <= 122)) | (c >= 128)
        where = np.flatnonzero(is_word)
        if not len(where):
            continue
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1] + 1])
        size = np.diff(np.r_[first, len(where)])
        place = where - np.repeat(where[first], size)
        letters = mix(c[where].astype(np.uint64) * _MIX + place.astype(np.uint64))
        out.append(mix(np.add.reduceat(letters, first) + size.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of ``width`` words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _MIX + hashes[k : k + n]
    return mix(h)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, a text without words none."""
    h = word_hashes(text)
    if not len(h):
        return h
    w = np.sort(windows(h, min(width, len(h))))
    return w[np.r_[True, w[1:] != w[:-1]]]


def minhash(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The leading 32 bits of the minima of multiply-add hashes of a shingle set; slices of it stay in the cache."""
    low = np.full(len(mul), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 256):
        x = shingles[None, at : at + 256] * mul[:, None]
        x += add[:, None]
        np.minimum(low, x.min(1), out=low)
    return low >> np.uint64(32)


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal ``column``, from batches of rows that lie together by it."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        g = np.asarray(t.column(column))
        cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        if rest is not None:
            if rest.column(column)[0].as_py() == g[0]:
                rest = pa.concat_tables([rest, t.slice(0, cut[1])])
                cut = cut[1:]
            if len(cut) > 1:
                yield rest
                rest = None
        for lo, hi in zip(cut[:-2], cut[1:-1]):
            yield t.slice(lo, hi - lo)
        if len(cut) > 1:
            rest = t.slice(cut[-2], cut[-1] - cut[-2])
    if rest is not None:
        yield rest
