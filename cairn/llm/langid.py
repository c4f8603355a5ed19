"""Language identification with interpolated Kneser-Ney character models.

One model per language, of character n-grams up to ORDER. Spark counts the n-grams of a bounded sample of labelled
texts; the counts become probabilities P(last char | the others), interpolated down to a uniform distribution. All
models share sorted arrays of n-gram hashes, one per order, with a row of log-probabilities (seen) and back-off weights
per language. A text gets the language of least cross-entropy per character. It is rejected when even that is above
what training texts of its length showed, or when it has no letter. Where few texts show it, the limit leans towards the
cross-entropy of uniformly drawn letters, which no text of a learned language reaches; so it holds from one text on.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

ORDER, DISCOUNT = 4, 0.75
#: Bound of the training sample: about so many different texts per language, drawn by hash, each read whole. It bounds
#: the model.
TEXTS_PER_LANG = 1500
#: And about so many characters of them, where texts are very long.
CHARS_PER_LANG = 32 << 20
#: Languages of one model: it holds a row of numbers per n-gram and language. More are refused, none is left out.
MOST_LANGS = 1000
#: Rejection: this share of held-back training texts must stay, and so many nats are added on top.
KEEP, SLACK = 0.999, 0.35
#: The uniform distribution weighs as much in the limit as so many held-back texts.
PRIOR_TEXTS = 20
UNKNOWN = "und"
_P = np.uint64(0x9E3779B97F4A7C15)


@cache
def letters() -> np.ndarray:
    """By code point, whether it is a letter or a mark: marks belong to their letter, as in Indic and Thai words."""
    return np.fromiter((unicodedata.category(chr(k))[0] in "LM" for k in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def codes(text: str) -> np.ndarray:
    """Lower-cased letters, every run of anything else as one space, one space around."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    on = letters()[c]
    words = np.where(on, c, ord(" "))[on | np.r_[False, on[:-1]]]  # the first place after a word stands for all that follows
    return np.r_[ord(" "), words, [ord(" ")] * (1 if not len(words) or words[-1] != ord(" ") else 0)].astype(np.uint64)


def gram_hashes(c: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n-gram, in order; the order is part of the hash."""
    if len(c) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(c) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ c[k : len(c) - n + 1 + k]) * _P
        h ^= h >> np.uint64(29)
    return h


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``keys``, and which of ``wanted`` are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    langs: list[str]
    #: For each order from 1: sorted hashes; log-probability by language, interpolated where that language has not seen
    #: the n-gram; log back-off by language of the n-gram as a context.
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    #: Log-probability under the uniform distribution, and the log back-off to it by language.
    floor: float
    empty: np.ndarray
    #: Rejection limit: base + slope / sqrt(length).
    limit: tuple[float, float] = (math.inf, 0.0)

    def entropies(self, text: str) -> np.ndarray:
        """Cross-entropy per character under each language, in nats; the first characters are context only."""
        c = codes(text)
        n = min(ORDER, len(c))
        total, m = np.zeros(len(self.langs)), 0
        for lo in range(0, len(c) - n + 1, 1 << 18):  # slices bound the memory; they overlap by a context
            part = c[lo : lo + (1 << 18) + n - 1]
            h = gram_hashes(part, n)
            m += len(h)
            grams, times = np.unique(h, return_counts=True)
            at, hit = find(self.keys[n - 1], grams)
            total += times[hit] @ self.logp[n - 1][at[hit]].astype(np.float64)
            if not hit.all():
                total += self.log_probabilities(part, np.flatnonzero(np.isin(h, grams[~hit])), n).sum(0, dtype=np.float64)
        return -total / max(m, 1)

    def log_probabilities(self, c: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        """For the n-grams that begin at ``where``: the log-probability of their last character, a column per language."""
        out = np.zeros((len(where), len(self.langs)), np.float32)
        todo = np.arange(len(where))
        for k in range(n, 0, -1):  # the k-gram that ends where the n-gram ends, else its context's back-off
            at, hit = find(self.keys[k - 1], gram_hashes(c, k)[where[todo] + n - k])
            out[todo[hit]] += self.logp[k - 1][at[hit]]
            todo = todo[~hit]
            if k > 1 and len(todo):
                at, hit = find(self.keys[k - 2], gram_hashes(c, k - 1)[where[todo] + n - k])
                out[todo[hit]] += self.back[k - 2][at[hit]]
        out[todo] += self.floor + self.empty
        return out

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, confidence, cross-entropy, rejected)."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, math.nan, True
        h = self.entropies(text)
        best = int(np.argmin(h))
        # confidence: the posterior of the best language, with the evidence of 40 characters at most
        n = min(len(text), 40)
        score = float(1 / np.exp((h[best] - h) * n).sum())
        return self.langs[best], score, float(h[best]), bool(h[best] > self.limit[0] + self.limit[1] / math.sqrt(len(text)))


def sample(train: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` different texts of each language and CHARS_PER_LANG characters, all where it has no more, by
    hash of the text.

    Equal texts fall together; the share of a language is that of its different texts, so that copies change nothing.
    """
    each = train.select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("chars")).distinct()
    by = each.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).limit(MOST_LANGS + 1)
    sizes = {r.lang: min(1.0, per_lang / r.n, CHARS_PER_LANG / max(r.chars, 1)) for r in by.collect()}  # a row per language
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages are labelled")
    if not sizes:
        return train.limit(0)
    share = F.create_map(*[x for k, part in sizes.items() for x in (F.lit(k), F.lit(part))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return train.where(draw < share[F.col("lang")]).dropDuplicates(["lang", "text"])


def count_grams(texts: DataFrame) -> DataFrame:
    """lang, k, h, context, suffix, n: counts of the n-grams of orders 1 to ORDER; distinct texts each count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = b.to_pandas()
            for lang, group in frame.groupby("lang"):
                for k in range(1, ORDER + 1):
                    parts, ctx, suf = [], [], []
                    for text in group["text"]:
                        c = codes(text)
                        if len(c) < k:
                            continue
                        parts.append(gram_hashes(c, k))
                        ctx.append(gram_hashes(c[:-1], k - 1) if k > 1 else np.zeros(len(c), np.uint64))
                        suf.append(gram_hashes(c[1:], k - 1) if k > 1 else np.zeros(len(c), np.uint64))
                    if not parts:
                        continue
                    h, at, n = np.unique(np.concatenate(parts), return_index=True, return_counts=True)
                    x, y = np.concatenate(ctx)[at], np.concatenate(suf)[at]
                    yield pa.record_batch([pa.array([lang] * len(h)), pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "h", "context", "suffix", "n"])

    rows = texts.select("lang", "text").mapInArrow(count, "lang string, k int, h long, context long, suffix long, n long")
    return rows.groupBy("lang", "k", "h", "context", "suffix").agg(F.sum("n").alias("n"))


def kneser_ney(counts: pd.DataFrame, langs: list[str]) -> Model:
    """Interpolated Kneser-Ney from n-gram counts; lower orders count distinct continuations.

    P_k(w | c) = max(a(cw) - D, 0) / a(c.) + D * types(c) / a(c.) * P_{k-1}(w | c'), down to a uniform distribution,
    where a is the count at the top order and the number of distinct left extensions below it.
    """
    alphabet = max(counts.loc[counts.k == 1, "h"].nunique(), 1) + 1
    floor = -math.log(alphabet)
    keys = [np.unique(counts.loc[counts.k == k, "h"].to_numpy().view(np.uint64)) for k in range(1, ORDER + 1)]
    logp = [np.full((len(x), len(langs)), np.nan, np.float32) for x in keys]
    back = [np.zeros((len(x), len(langs)), np.float32) for x in keys]
    empty = np.zeros(len(langs), np.float32)
    for col, lang in enumerate(langs):
        own = counts[counts.lang == lang]
        lower: dict[int, float] | pd.Series = {}
        for k in range(1, ORDER + 1):
            g = own[own.k == k].set_index("h")
            if g.empty:
                break
            if k < ORDER and not (up := own[own.k == k + 1]).empty:
                g = g.assign(n=up.groupby("suffix").size().reindex(g.index).fillna(0))
                g.loc[g.n == 0, "n"] = 1  # at the start of a text: no left extension
            by = g.groupby("context")["n"]
            total, types = by.transform("sum"), by.transform("size")
            below = np.full(len(g), 1 / alphabet) if k == 1 else lower.reindex(g["suffix"]).fillna(1 / alphabet).to_numpy()
            p = np.maximum(g["n"] - DISCOUNT, 0) / total + DISCOUNT * types / total * below
            lower = p
            logp[k - 1][np.searchsorted(keys[k - 1], g.index.to_numpy().view(np.uint64)), col] = np.log(p)
            weight = np.log(DISCOUNT * by.size() / by.sum())
            if k == 1:
                empty[col] = weight.iloc[0]
            else:
                at = np.searchsorted(keys[k - 2], weight.index.to_numpy().view(np.uint64))
                back[k - 2][at, col] = weight.to_numpy()
    # n-grams that only other languages have: the probability by back-off, so that a lookup serves all languages
    for k in range(1, ORDER + 1):
        g = counts[counts.k == k].drop_duplicates("h").sort_values("h", key=lambda x: x.to_numpy().view(np.uint64))
        if g.empty:
            break
        if k == 1:
            below = np.broadcast_to(floor + empty, logp[0].shape)
        else:
            at, hit = find(keys[k - 2], g["context"].to_numpy().view(np.uint64))
            up, known = find(keys[k - 2], g["suffix"].to_numpy().view(np.uint64))
            below = np.where(hit[:, None], back[k - 2][at], 0) + np.where(known[:, None], logp[k - 2][up], floor)
        logp[k - 1] = np.where(np.isnan(logp[k - 1]), below, logp[k - 1]).astype(np.float32)
    return Model(langs, keys, logp, back, floor, empty)


def fit(docs: DataFrame, per_lang: int = TEXTS_PER_LANG, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from labelled rows (null labels and letterless texts are left out); None when there are none.

    Nine tenths of the sample are counted; the rest calibrates the rejection limit, at any size of it. A language whose few texts would all
    be held back is counted whole, so every labelled language is learned.
    """
    train = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    drawn = settle(sample(train.where(F.col("text").rlike(r"\p{L}")), per_lang))
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "text"), F.lit(10)) == 0
    held &= F.col("lang").isin([r.lang for r in drawn.where(~held).select("lang").distinct().collect()])
    # the model's size is bounded by the sample's, not by the corpus
    counts = count_grams(drawn.where(~held)).toPandas()
    if counts.empty:
        return None
    model = kneser_ney(counts, sorted(counts.lang.unique()))
    shared = drawn.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<h: double, n: int>")
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"h": [shared.value.entropies(t).min() for t in texts], "n": [len(t) for t in texts]})

    got = drawn.where(held).select(measure("text").alias("m")).select("m.*").where("h is not null").toPandas()
    model.limit = rejection_limit(got["h"].to_numpy(float), got["n"].to_numpy(float), -model.floor)
    return model


def rejection_limit(h: np.ndarray, n: np.ndarray, uniform: float) -> tuple[float, float]:
    """Base and slope (by 1 / sqrt(length)) from the cross-entropies ``h`` of held-back texts of ``n`` characters.

    They are weighed against the cross-entropy of uniform letters, so the limit is finite whatever their number.
    """
    if not len(h):
        return uniform, 0.0
    weight = len(h) / (len(h) + PRIOR_TEXTS)
    slope = float(h.std() * math.sqrt(np.median(n)))
    base = float(np.quantile(h - slope / np.sqrt(n), KEEP)) + SLACK
    return weight * base + (1 - weight) * uniform, weight * slope


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    """A struct lang_pred, score, cross_entropy, rejected for each text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double, cross_entropy: double, rejected: boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [shared.value.predict(t) if shared.value else (UNKNOWN, 0.0, math.nan, True) for t in texts]
            yield pd.DataFrame(out, columns=["lang_pred", "score", "cross_entropy", "rejected"])

    return predict(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never reads; a null id counts as the empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_languages(docs: DataFrame, per_lang: int = TEXTS_PER_LANG) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Null and letterless texts are ``und`` and rejected, with score 0; so is every text when nothing is labelled. Ties
    go to the language that sorts first. Equal texts get equal rows. Very long texts are read whole, in slices. Training reads text and lang only; an extra column
    of any name is ignored.
    """
    model = fit(docs.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), identify(docs, model).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.cross_entropy", "_p.rejected")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
