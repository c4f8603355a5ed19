"""Figures of a pass, gathered while it runs: no second scan, and what a failed or repeated task saw does not count.

An observation is a small row of sums that Spark completes with the action that writes or collects the frame; reading it
before waits for that action.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .derive import Busy, hash_vector


def counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """``df`` and its figures (aggregates), told by the first action on what is returned."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in figures.items()]), seen


def counted_reasons(df: DataFrame, reason: Column, reasons: list[str]) -> tuple[DataFrame, Observation]:
    """``df`` and how many rows each of the named reasons drops; ``kept`` counts the rows with a null reason."""
    return counted(df, kept=F.count_if(reason.isNull()), **{r: F.count_if(F.coalesce(reason == r, F.lit(False))) for r in reasons})


def first_reason(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that holds; null where none does."""
    return F.coalesce(*[F.when(on, name) for name, on in rules.items()], F.lit(None).cast("string"))


def metered_embedding(df: DataFrame, text: str, out: str, dim: int = 64, model: Callable[[list[str]], np.ndarray] | None = None, tries: int = 4, wait_s: float = 0.5, budget_s: float = 60.0) -> tuple[DataFrame, Observation]:
    """``df`` with the vectors of its texts in ``out``, and the figures calls, busy (calls that were turned away), texts,
    rows and millis of the model. A call that fails for good fails its task and counts nothing."""
    schema = "struct<v: array<float>, calls: int, busy: int, texts: int, millis: int>"

    @F.pandas_udf(schema)
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in batches:
            rows = [t or "" for t in own]
            began, busy = time.monotonic(), 0
            while True:
                try:
                    got = model(rows) if model else np.array([hash_vector(t, dim) for t in rows]).reshape(len(rows), dim)
                    break
                except Busy:
                    pause = wait_s * 2**busy
                    busy += 1
                    if busy >= tries or time.monotonic() - began + pause > budget_s:
                        raise
                    time.sleep(pause)
            if got.shape != (len(rows), dim):
                raise ValueError(f"the model returned {got.shape}, not {(len(rows), dim)}")
            # a batch's figures stand at its first row
            at_first = lambda n: [n] + [0] * (len(rows) - 1) if rows else []
            yield pd.DataFrame({"v": list(got.astype(np.float32)), "calls": at_first(busy + 1), "busy": at_first(busy), "texts": at_first(len(rows)), "millis": at_first(round((time.monotonic() - began) * 1000))})

    made = df.withColumn("_e", embedded(F.col(text)))
    sums = {name: F.coalesce(F.sum(f"_e.{name}"), F.lit(0)) for name in ("calls", "busy", "texts", "millis")}
    seen, observation = counted(made, rows=F.count(F.lit(1)), **sums)
    return seen.withColumn(out, F.col("_e.v")).drop("_e"), observation
