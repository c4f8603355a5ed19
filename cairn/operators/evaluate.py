"""Ranking metrics, strata, noise between runs and paired significance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_files(results: DataFrame) -> DataFrame:
    """(q, path, rank) from chunk rankings (q, path, rank): a file stands where its first chunk stands."""
    first = results.groupBy("q", "path").agg(F.min("rank").alias("_r"))
    return first.select("q", "path", F.row_number().over(Window.partitionBy("q").orderBy("_r", "path")).alias("rank"))


def ideal_dcg(n: Column, k: int) -> Column:
    sums = [0.0]
    for i in range(1, k + 1):
        sums.append(sums[-1] + 1 / math.log2(i + 1))
    return F.element_at(F.array(*[F.lit(x) for x in sums]), F.least(n, F.lit(k)).cast("int") + 1)


def per_query(ranked: DataFrame, gold: DataFrame, digits: int = 6) -> DataFrame:
    """nDCG@10, RR@10, AP@20, recall@1/5/10/20 and accuracy@5 for each query that has gold; an empty ranking scores 0."""
    n = gold.groupBy("q").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranked.join(gold, ["q", "path"], "left_semi")
    seen = F.row_number().over(Window.partitionBy("q").orderBy("rank"))
    hits = hits.withColumn("seen", seen)
    at = lambda k: F.count_if(F.col("rank") <= k)
    per = hits.groupBy("q").agg(
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 20, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"), *[at(k).alias(f"h{k}") for k in (1, 5, 10, 20)],
    )
    j = n.join(per, "q", "left").na.fill(0)
    r = lambda c, name: F.round(c, digits).alias(name)
    return j.select(
        "q", "n_gold", r(F.col("dcg") / ideal_dcg(F.col("n_gold"), 10), "ndcg10"), r(F.when(F.col("first").between(1, 10), 1 / F.col("first")).otherwise(0.0), "rr10"),
        r(F.col("ap") / F.least("n_gold", F.lit(20)), "ap20"), *[r(F.col(f"h{k}") / F.col("n_gold"), f"recall{k}") for k in (1, 5, 10, 20)], (F.col("h5") == F.col("n_gold")).cast("int").alias("acc5"),
    )


def recall_curve(ranked: DataFrame, gold: DataFrame, k: int = 20, digits: int = 6) -> DataFrame:
    """Mean recall at 1..k: hits per rank, summed along the ranks; nothing is expanded per query."""
    n = gold.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    queries = n.count()
    gain = ranked.where(F.col("rank") <= k).join(gold, ["q", "path"], "left_semi").join(n, "q").groupBy("rank").agg(F.sum(1 / F.col("n")).alias("g"))
    ranks = gold.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("rank"))
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    return ranks.join(gain, "rank", "left").select(F.col("rank").alias("k"), F.round(F.sum(F.coalesce("g", F.lit(0.0))).over(run) / F.lit(float(max(queries, 1))), digits).alias("recall"))


def macro(rows: DataFrame, group: str, metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """The mean over groups of the groups' means: each group counts once."""
    by = rows.groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics])
    return by.agg(*[F.round(F.avg(m), digits).alias(m) for m in metrics], F.count(F.lit(1)).alias("groups"))


def strata(rows: DataFrame, fields: Sequence[str], metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """field, stratum, n and mean metrics for each value of each field in one pass; null is a stratum of its own."""
    keyed = rows.select(*metrics, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stratum")) for f in fields])).alias("s"))
    out = keyed.groupBy("s.field", "s.stratum").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])
    some = out.groupBy("field").agg(F.count("stratum").alias("_some")).where("_some > 0").select("field")
    return out.join(F.broadcast(some), "field", "left_semi")  # a field that is null throughout is left out


def noise_floor(runs: DataFrame, digits: int = 6) -> DataFrame:
    """corpus, sd between the runs' means, queries whose value moved; runs: run, corpus, q, value."""
    mean = runs.groupBy("corpus", "run").agg(F.avg("value").alias("m")).groupBy("corpus").agg(F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), digits).alias("sd"))
    moved = runs.groupBy("corpus", "q").agg((F.count_distinct(F.round("value", 9)) > 1).cast("int").alias("m")).groupBy("corpus").agg(F.sum("m").alias("unstable"), F.count(F.lit(1)).alias("queries"))
    return mean.join(moved, "corpus")


def accuracy_at(ranked: DataFrame, gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """q and acc<k>: whether all gold files stand in the first k; an empty ranking has none."""
    n = gold.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.join(gold, ["q", "path"], "left_semi").groupBy("q").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    return n.join(hits, "q", "left").select("q", *[(F.coalesce(F.col(f"h{k}"), F.lit(0)) == F.col("n")).cast("int").alias(f"acc{k}") for k in ks])


def refusals(results: DataFrame) -> DataFrame:
    """corpus, refusal, n: why results were refused; those that were not are left out. results: corpus, refusal."""
    return results.where("refusal is not null").groupBy("corpus", "refusal").agg(F.count(F.lit(1)).alias("n"))


def noise_report(runs: DataFrame, alpha: float = 0.05, power: float = 0.8, target: float = 0.02, floor: float = 0.01, multiple: float = 2.0, step: float = 0.005, digits: int = 6) -> DataFrame:
    """One row over repeated runs (run, corpus, q, value), of the queries that every run has.

    macro_sd: of the runs' means over corpora; pooled_sd: root mean square of the corpora's SDs; delta: the smallest
    difference to believe, a multiple of it rounded up; sigma_d: of the differences between every two runs; ceiling:
    the root of two times the SD between queries' means; needed, needed_ceiling: queries that show ``target``.
    """
    n_runs = runs.select("run").distinct().count()
    by = runs.groupBy("corpus", "run").agg(F.avg("value").alias("m"))
    pooled = by.groupBy("corpus").agg(F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd")).agg(F.sqrt(F.avg(F.col("sd") ** 2)).alias("pooled_sd"))
    macro = by.groupBy("run").agg(F.avg("m").alias("m")).agg(F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("macro_sd"))
    # a difference of every two runs has mean 0 over ordered pairs; its square sums to n * sum of squares - square of sum,
    # so the pairs themselves need not be made; the signed mean of the unordered pairs is a weighted sum by run order
    k = F.dense_rank().over(Window.orderBy("run"))
    order = runs.select("run").distinct().withColumn("_k", k)  # a row per run
    per = runs.join(F.broadcast(order), "run").groupBy("corpus", "q").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"), F.sum(F.col("value") * (F.lit(n_runs + 1) - 2 * F.col("_k"))).alias("d"), (F.count_distinct(F.round("value", 9)) > 1).cast("int").alias("moved"), F.avg("value").alias("m")
    )
    per = per.where(F.col("n") == n_runs)
    pairs = F.lit(n_runs * (n_runs - 1) / 2.0)
    sums = per.agg(F.count(F.lit(1)).alias("queries"), F.sum("moved").alias("unstable"), F.sum(F.col("n") * F.col("ss") - F.col("s") ** 2).alias("sq"), F.sum("d").alias("d"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sq_sd"))
    total = F.col("queries") * pairs
    var = (F.col("sq") - F.col("d") ** 2 / total) / (total - 1)
    sums = sums.withColumn("sigma_d", F.when(total > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)).withColumn("ceiling", F.lit(math.sqrt(2)) * F.col("sq_sd"))
    z = normal_ppf(1 - alpha / 2) + normal_ppf(power)
    need = lambda c: F.when(F.col(c) > 0, F.ceil((F.lit(z) * F.col(c) / target) ** 2))
    one = sums.withColumn("_one", F.lit(1)).join(pooled.withColumn("_one", F.lit(1)), "_one").join(macro.withColumn("_one", F.lit(1)), "_one")  # one row each
    delta = F.greatest(F.lit(floor), F.ceil(F.col("pooled_sd") * multiple / step - 1e-9) * step)
    r = lambda c, name: F.round(c, digits).alias(name)
    return one.select("queries", "unstable", r(F.col("macro_sd"), "macro_sd"), r(F.col("pooled_sd"), "pooled_sd"), r(delta, "delta"), r(F.col("sigma_d"), "sigma_d"), r(F.col("ceiling"), "ceiling"), need("sigma_d").alias("needed"), need("ceiling").alias("needed_ceiling"))


def non_inferior(intervals: DataFrame, margin: float) -> DataFrame:
    """Intervals (lo) with margin and non_inferior: the whole interval clears minus the margin."""
    return intervals.withColumn("margin", F.lit(margin)).withColumn("non_inferior", F.col("lo") > -margin)


def best_weights(scores: DataFrame, train: str, test: str) -> DataFrame:
    """The weights with the best mean on one corpus, and their mean on another. scores: corpus, weights, value.

    Choosing and reporting on the same corpus is refused. Ties go to the first weights in order.
    """
    if train == test:
        raise ValueError("weights are chosen on one corpus and reported on another")
    mean = scores.where(F.col("corpus").isin(train, test)).groupBy("corpus", "weights").agg(F.avg("value").alias("m"))
    order = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("m"), "weights"))
    chosen = mean.where(F.col("corpus") == train).withColumn("_k", order).where("_k = 1").select("weights", F.col("m").alias("train"))
    return chosen.join(mean.where(F.col("corpus") == test).select("weights", F.col("m").alias("test")), "weights", "left")


def paired_spread(runs: DataFrame, digits: int = 6) -> DataFrame:
    """a, b, sigma: the SD of the per-query differences of every two runs. Runs are few; the join is on the query."""
    x, y = runs.select("q", F.col("run").alias("a"), F.col("value").alias("va")), runs.select("q", F.col("run").alias("b"), F.col("value").alias("vb"))
    return x.join(y, "q").where("a < b").groupBy("a", "b").agg(F.round(F.stddev_samp(F.col("va") - F.col("vb")), digits).alias("sigma"), F.count(F.lit(1)).alias("n"))


def paired_deltas(*legs: DataFrame) -> DataFrame:
    """q and d1, d2, ...: each later leg's value less the first one's, for the queries that every leg has. legs: q, value."""
    out = legs[0].select("q", F.col("value").alias("_v0"))
    for k, leg in enumerate(legs[1:], 1):
        out = out.join(leg.select("q", F.col("value").alias(f"_v{k}")), "q")
    return out.select("q", *[(F.col(f"_v{k}") - F.col("_v0")).alias(f"d{k}") for k in range(1, len(legs))])


def permutation_p(deltas: DataFrame, rounds: int, digits: int = 6, seed: str = "p") -> DataFrame:
    """stratum, n, mean, p: two-sided sign permutation test with add-one; signs come from a hash of query and round.

    A row meets its rounds as it is read; tasks sum them by stratum and round, so that only a row per round and stratum
    is shuffled. Round 0 changes no sign.
    """
    even = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "q", F.col("b").cast("string")).cast("binary")), 1, 1).isin(*"02468ace")
    keyed = deltas.where("stratum is not null").select("stratum", "q", "delta", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("b"))
    sums = keyed.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when((F.col("b") == 0) | even, F.col("delta")).otherwise(-F.col("delta"))).alias("s"))
    real = F.max(F.when(F.col("b") == 0, F.col("s"))).over(Window.partitionBy("stratum")).alias("t")
    over = sums.select("stratum", "b", "n", "s", real).groupBy("stratum", "n", "t").agg(F.count_if((F.col("b") > 0) & (F.abs("s") >= F.abs("t") - 1e-9)).alias("k"))
    return over.select("stratum", "n", F.round(F.col("t") / F.col("n"), digits).alias("mean"), F.round((F.col("k") + 1) / F.lit(float(rounds + 1)), digits).alias("p"))


def normal_ppf(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def bca_intervals(deltas: DataFrame, rounds: int = 2000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """stratum, n, mean, lo, hi: BCa bootstrap intervals. Each round weighs each query (q) by a Poisson(1) count.

    The counts come from a seeded hash of query and round. Tasks sum them by stratum and round, so that only a row per
    round and stratum is shuffled. A round that takes no query has no mean and is left out.
    """
    upto = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        key = mix(np.arange(rounds, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32)))
        for b in batches:
            names, h, d = b.column(0).to_pylist(), np.asarray(b.column(1)).view(np.uint64), np.asarray(b.column(2))
            for name in set(names):
                at = np.flatnonzero([x == name for x in names])
                total = sums.setdefault(name, np.zeros((2, rounds)))
                for lo in range(0, len(at), 512):
                    part = at[lo : lo + 512]
                    u = (mix(h[part, None] ^ key) >> np.uint64(11)) * 2.0**-53
                    w = np.searchsorted(upto, u, side="right").astype(np.float64)
                    total += d[part] @ w, w.sum(0)
        for name, (s, n) in sums.items():
            yield pa.record_batch([pa.array([name] * rounds, pa.string()), pa.array(np.arange(rounds, dtype=np.int32)), pa.array(s), pa.array(n)], ["stratum", "b", "s", "w"])

    drawn = deltas.select("stratum", F.xxhash64("q").alias("h"), F.col("delta").cast("double")).mapInArrow(resample, "stratum string, b int, s double, w double")
    boot = drawn.groupBy("stratum", "b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean")).where("mean is not null").select("stratum", "mean")
    jack = deltas.join(deltas.groupBy("stratum").agg(F.sum("delta").alias("t"), F.count(F.lit(1)).alias("n")), "stratum").withColumn("j", (F.col("t") - F.col("delta")) / F.greatest(F.col("n") - 1, F.lit(1)))
    acc = jack.join(jack.groupBy("stratum").agg(F.avg("j").alias("jm")), "stratum").groupBy("stratum", "n", "t").agg(F.sum(F.pow(F.col("jm") - F.col("j"), 3)).alias("c"), F.sum(F.pow(F.col("jm") - F.col("j"), 2)).alias("s"))

    def interval(key: tuple, means: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        n, t, c, s = a.loc[0, ["n", "t", "c", "s"]]
        m, mean = np.sort(means["mean"].to_numpy()), t / n
        z0 = normal_ppf(min(max((m < mean).mean(), 1e-6), 1 - 1e-6))
        acc_ = c / (6 * s**1.5) if s > 0 else 0.0
        from statistics import NormalDist

        at = [NormalDist().cdf(z0 + (z0 + z) / (1 - acc_ * (z0 + z))) for z in (normal_ppf(alpha / 2), normal_ppf(1 - alpha / 2))]
        return pd.DataFrame({"stratum": [key[0]], "n": [int(n)], "mean": [mean], "lo": [np.quantile(m, at[0])], "hi": [np.quantile(m, at[1])]})

    return boot.groupBy("stratum").cogroup(acc.groupBy("stratum")).applyInPandas(interval, "stratum string, n long, mean double, lo double, hi double")
