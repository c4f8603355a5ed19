"""Evaluation queries: orders are the queries, their lineitems the ranked results and gold files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..registry import query, table

_RANKED = """res AS (SELECT l_orderkey AS q, l_partkey % 20 AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem),
ranked AS (SELECT q, path, row_number() OVER (PARTITION BY q ORDER BY r, path) AS rank FROM (SELECT q, path, min(rank) AS r FROM res GROUP BY q, path)),
gold AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 20 AS path FROM lineitem WHERE l_quantity > 30)"""
_PERQ = f"""{_RANKED}, n AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q),
h AS (SELECT q, rank, row_number() OVER (PARTITION BY q ORDER BY rank) AS seen FROM ranked SEMI JOIN gold USING (q, path)),
p AS (SELECT q, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) AS f, sum(CASE WHEN rank <= 20 THEN seen / rank ELSE 0 END) AS ap,
  count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20 FROM h GROUP BY q),
perq AS (SELECT q, n_gold, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg10,
  round(CASE WHEN f <= 10 THEN 1 / f ELSE 0 END, 6) AS rr10, round(coalesce(ap, 0) / least(n_gold, 20), 6) AS ap20, round(coalesce(h1, 0) / n_gold, 6) AS recall1, round(coalesce(h5, 0) / n_gold, 6) AS recall5,
  round(coalesce(h10, 0) / n_gold, 6) AS recall10, round(coalesce(h20, 0) / n_gold, 6) AS recall20, (coalesce(h5, 0) = n_gold)::INT AS acc5 FROM n LEFT JOIN p USING (q))"""
_ROWS = f"{_PERQ}, rows_ AS (SELECT perq.*, o_custkey % 5 AS corpus, o_orderstatus AS language, o_orderpriority AS category, CASE WHEN n_gold <= 1 THEN '1' WHEN n_gold = 2 THEN '2' WHEN n_gold <= 4 THEN '3-4' ELSE '5+' END AS gold_size, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 2 = 0 END AS leak FROM perq JOIN orders ON o_orderkey = q)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    return li.select(F.col("l_orderkey").alias("q"), (F.col("l_partkey") % 20).alias("path"), rank.alias("rank"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("q"), (F.col("l_partkey") % 20).alias("path")).distinct()


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_query(E.ranked_files(results(spark, sf_dir)), gold(spark, sf_dir))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    leak = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 2 == 0)
    o = o.select(F.col("o_orderkey").alias("q"), (F.col("o_custkey") % 5).alias("corpus"), F.col("o_orderstatus").alias("language"), F.col("o_orderpriority").alias("category"), leak.alias("leak"))
    return metrics(spark, sf_dir).join(o, "q").withColumn("gold_size", T.gold_size(F.col("n_gold")))


@query("chunk_to_file_rank", f"WITH {_RANKED} SELECT q, path, rank FROM ranked")
def chunk_to_file_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranked_files(results(spark, sf_dir))


@query("ranking_metrics", f"WITH {_PERQ} SELECT * FROM perq")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


@query("recall_curve", f"WITH {_RANKED}, n AS (SELECT q, count(*) AS n FROM gold GROUP BY q), g AS (SELECT rank, sum(1 / n) AS g FROM ranked SEMI JOIN gold USING (q, path) JOIN n USING (q) GROUP BY rank) SELECT k::INT AS k, round(coalesce((SELECT sum(g) FROM g WHERE rank <= k), 0) / (SELECT count(*) FROM n), 6) AS recall FROM range(1, 21) t(k)")
def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall_curve(E.ranked_files(results(spark, sf_dir)), gold(spark, sf_dir))


@query("macro_metrics", f"WITH {_ROWS}, c AS (SELECT corpus, avg(ndcg10) AS ndcg10, avg(rr10) AS rr10, avg(ap20) AS ap20, avg(recall10) AS recall10 FROM rows_ GROUP BY corpus) SELECT round(avg(ndcg10), 6) AS ndcg10, round(avg(rr10), 6) AS rr10, round(avg(ap20), 6) AS ap20, round(avg(recall10), 6) AS recall10, count(*) AS groups FROM c")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(rows(spark, sf_dir), "corpus", ["ndcg10", "rr10", "ap20", "recall10"])


_STRATA = " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS stratum, ndcg10, recall10 FROM rows_" for f in ("language", "category", "gold_size", "leak"))


@query("strata", f"WITH {_ROWS}, u AS ({_STRATA}) SELECT field, stratum, count(*) AS n, round(avg(ndcg10), 6) AS ndcg10, round(avg(recall10), 6) AS recall10 FROM u GROUP BY field, stratum")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.strata(rows(spark, sf_dir), ["language", "category", "gold_size", "leak"], ["ndcg10", "recall10"])


@query("strata_grouping_sets", f"WITH {_ROWS} SELECT language, category, gold_size, grouping(language) * 4 + grouping(category) * 2 + grouping(gold_size) AS level, count(*) AS n, round(avg(ndcg10), 6) AS ndcg10 FROM rows_ GROUP BY GROUPING SETS ((language), (category), (gold_size), (language, category), ())")
def strata_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, dims = rows(spark, sf_dir), [F.col("language"), F.col("category"), F.col("gold_size")]
    sets = [[dims[0]], [dims[1]], [dims[2]], [dims[0], dims[1]], []]
    return r.groupingSets(sets, *dims).agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg10"), 6).alias("ndcg10"))


@query("ranking_depth", f"WITH {_RANKED}, d AS (SELECT q, count(*) AS depth FROM ranked GROUP BY q) SELECT round(avg(depth), 6) AS mean_depth, min(depth) AS min_depth, count(*) FILTER (depth < 3) AS shorter_than_3, count(*) AS queries FROM d")
def ranking_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.ranked_files(results(spark, sf_dir)).groupBy("q").agg(F.count(F.lit(1)).alias("depth"))
    return d.agg(F.round(F.avg("depth"), 6).alias("mean_depth"), F.min("depth").alias("min_depth"), F.count_if(F.col("depth") < 3).alias("shorter_than_3"), F.count(F.lit(1)).alias("queries"))


@query("gold_in_top_k", f"WITH {_RANKED} SELECT q, count(*) AS hits FROM ranked SEMI JOIN gold USING (q, path) WHERE rank <= 3 GROUP BY q")
def gold_in_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranked_files(results(spark, sf_dir)).where("rank <= 3").join(gold(spark, sf_dir), ["q", "path"], "left_semi").groupBy("q").agg(F.count(F.lit(1)).alias("hits"))


_RUNS = f"{_ROWS}, runs AS (SELECT r AS run, corpus, q, ndcg10 + CASE WHEN (q + r) % 4 = 0 THEN r * 0.01::DOUBLE ELSE 0 END AS value FROM rows_, range(3) t(r))"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs: the same scores, some of them moved."""
    r = rows(spark, sf_dir).select("corpus", "q", "ndcg10", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("run"))
    return r.select("run", "corpus", "q", (F.col("ndcg10") + F.when((F.col("q") + F.col("run")) % 4 == 0, F.col("run") * 0.01).otherwise(0.0)).alias("value"))


@query("noise_floor", f"WITH {_RUNS}, m AS (SELECT corpus, run, avg(value) AS m FROM runs GROUP BY ALL), s AS (SELECT corpus, round(coalesce(stddev_samp(m), 0), 6) AS sd FROM m GROUP BY corpus), u AS (SELECT corpus, q, (count(DISTINCT round(value, 9)) > 1)::INT AS m FROM runs GROUP BY ALL) SELECT corpus, any_value(sd) AS sd, sum(m)::BIGINT AS unstable, count(*) AS queries FROM u JOIN s USING (corpus) GROUP BY corpus")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.noise_floor(_runs(spark, sf_dir))


@query("paired_spread", f"WITH {_RUNS} SELECT x.run AS a, y.run AS b, round(stddev_samp(x.value - y.value), 6) AS sigma, count(*) AS n FROM runs x JOIN runs y ON x.q = y.q AND x.run < y.run GROUP BY ALL")
def paired_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.paired_spread(_runs(spark, sf_dir))


@query("noise_report", f"""WITH {_RUNS}, m AS (SELECT corpus, run, avg(value) AS m FROM runs GROUP BY ALL), sd AS (SELECT corpus, stddev_samp(m) AS sd FROM m GROUP BY corpus), po AS (SELECT sqrt(avg(sd * sd)) AS pooled_sd FROM sd),
ma AS (SELECT stddev_samp(m) AS macro_sd FROM (SELECT run, avg(m) AS m FROM m GROUP BY run)), di AS (SELECT stddev_samp(x.value - y.value) AS sigma_d FROM runs x JOIN runs y ON x.q = y.q AND x.run < y.run),
pe AS (SELECT q, avg(value) AS m, (count(DISTINCT round(value, 9)) > 1)::INT AS moved FROM runs GROUP BY q), ce AS (SELECT count(*) AS queries, sum(moved)::BIGINT AS unstable, sqrt(2) * stddev_samp(m) AS ceiling FROM pe), z AS (SELECT 1.959963984540054::DOUBLE + 0.8416212335729143 AS z)
SELECT queries, unstable, round(macro_sd, 6) AS macro_sd, round(pooled_sd, 6) AS pooled_sd, round(greatest(0.01, ceil(pooled_sd * 2 / 0.005 - 1e-9) * 0.005), 6)::DOUBLE AS delta, round(sigma_d, 6) AS sigma_d, round(ceiling, 6) AS ceiling,
  ceil(pow(z * sigma_d / 0.02, 2))::BIGINT AS needed, ceil(pow(z * ceiling / 0.02, 2))::BIGINT AS needed_ceiling FROM po, ma, di, ce, z""")
def noise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.noise_report(_runs(spark, sf_dir))


@query("weight_choice", """WITH s AS (SELECT o_custkey % 2 AS corpus, o_orderkey % 6 AS weights, o_totalprice::DOUBLE AS value FROM orders), m AS (SELECT corpus, weights, avg(value) AS m FROM s GROUP BY ALL), b AS (SELECT weights, m FROM m WHERE corpus = 0 ORDER BY m DESC, weights LIMIT 1)
SELECT b.weights, round(b.m, 4) AS train, round(m.m, 4) AS test FROM b LEFT JOIN m ON m.weights = b.weights AND m.corpus = 1""")
def weight_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 2).cast("string").alias("corpus"), (F.col("o_orderkey") % 6).alias("weights"), F.col("o_totalprice").cast("double").alias("value"))
    return E.best_weights(s, "0", "1").select("weights", F.round("train", 4).alias("train"), F.round("test", 4).alias("test"))


_DELTA = f"{_ROWS}, deltas AS (SELECT q, language AS stratum, ndcg10 - recall5 AS delta FROM rows_)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("q", F.col("language").alias("stratum"), (F.col("ndcg10") - F.col("recall5")).alias("delta"))


@query("permutation_sign", f"WITH {_DELTA}, s AS (SELECT stratum, b, sum(CASE WHEN ('0x' || md5('p:' || q || ':' || b)[1])::INT % 2 = 0 THEN delta ELSE -delta END) AS s FROM deltas, range(1, 65) t(b) GROUP BY ALL), r AS (SELECT stratum, count(*) AS n, sum(delta) AS t FROM deltas GROUP BY stratum) SELECT stratum, n, round(t / n, 6) AS mean, round((count(*) FILTER (abs(s) >= abs(t) - 1e-9) + 1) / 65.0::DOUBLE, 6) AS p FROM s JOIN r USING (stratum) GROUP BY stratum, n, t")
def permutation_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.permutation_p(_deltas(spark, sf_dir), 64)


@query("non_inferiority", "SELECT s_suppkey AS id, s_acctbal::DOUBLE AS lo, 100.0::DOUBLE AS margin, s_acctbal > -100 AS non_inferior FROM supplier")
def non_inferiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.non_inferior(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("lo")), 100.0)


@query("bca_bootstrap")
def bca_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bca_intervals(_deltas(spark, sf_dir), 800)
