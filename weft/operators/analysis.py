"""Score distributions of judged pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(rows: DataFrame, score: str, *by: str) -> DataFrame:
    """(*by, s, n): how often each score occurs, so that quartiles keep different scores only."""
    return rows.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))


def _spread(population: bool) -> Column:
    """The standard deviation from (s, n)."""
    n, total = F.sum(F.when(F.col("s").isNotNull(), F.col("n"))), F.sum(F.col("s") * F.col("n"))
    square = F.sum(F.col("s") * F.col("s") * F.col("n")) - total * total / n
    return F.when(n > (0 if population else 1), F.sqrt(F.greatest(square, F.lit(0.0)) / (n if population else n - 1)))


def describe(rows: DataFrame, by: str, score: str = "score") -> DataFrame:
    """count, mean, std (sample), min, linear quartiles and max of the scores of each group.  Equal scores are
    counted first; null scores count nowhere."""
    some = F.col("s").isNotNull()
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    count = F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0))
    g = _counted(rows, score, by).groupBy(by).agg(count.alias("count"), (F.sum(F.col("s") * F.col("n")) / count).alias("mean"), _spread(False).alias("std"), F.min("s").alias("min"), q.alias("q"), F.max("s").alias("max"))
    return g.select(by, "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def summary(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row: mean, median, standard deviation of the population, quartiles.  Equal scores are counted first."""
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    g = _counted(rows.where(F.col(score).isNotNull()), score).agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean"), _spread(True).alias("std"), q.alias("q"))
    return g.select("mean", F.col("q")[1].alias("median"), "std", F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"))


def score_bins(rows: DataFrame, gold: str = "gold", score: str = "score") -> DataFrame:
    """(bin, n_true, n_false, n_all, pct_true, pct_false) for ten bins closed on the right (the first on both
    sides), every bin present, and a row "total"; scores out of [0, 1], null and NaN are left out."""
    spark = rows.sparkSession
    s = F.col(score)
    bin_no = F.when(s == 0, 0)
    for i in range(10):
        bin_no = bin_no.when((s > i / 10) & (s <= (i + 1) / 10), i)
    got = rows.select(bin_no.alias("i"), F.col(gold).alias("gold")).where("i is not null")
    got = got.groupBy("i").agg(F.count_if(F.col("gold")).alias("t"), F.count_if(~F.col("gold")).alias("f"))
    dim = spark.range(10).select(F.col("id").cast("int").alias("i"), F.format_string("%.1f-%.1f", F.col("id") / 10.0, (F.col("id") + 1) / 10.0).alias("bin"))
    each = dim.join(F.broadcast(got), "i", "left").select("bin", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("f", F.lit(0)).alias("f"))
    rolled = each.rollup("bin").agg(F.sum("t").alias("n_true"), F.sum("f").alias("n_false"))
    n_all = F.col("n_true") + F.col("n_false")
    pct = lambda c: F.when(n_all > 0, F.round(F.col(c) / n_all * 100, 2)).otherwise(0.0)
    return rolled.select(F.coalesce("bin", F.lit("total")).alias("bin"), "n_true", "n_false", n_all.alias("n_all"), pct("n_true").alias("pct_true"), pct("n_false").alias("pct_false"))


def score_band(rows: DataFrame, gold: str = "gold", score: str = "score", low: float = 0.4, high: float = 0.6) -> DataFrame:
    """One row: scores within [low, high], by gold and in all."""
    inside = F.col(score).between(low, high)
    return rows.agg(F.count_if(inside & F.col(gold)).alias("near_true"), F.count_if(inside & ~F.col(gold)).alias("near_false"), F.count_if(inside).alias("near_all"))


def decision_gap(rows: DataFrame, predicted: str = "predicted", score: str = "score") -> DataFrame:
    """One row: the least score predicted true, the greatest predicted false, whether a gap parts them."""
    g = rows.agg(F.min(F.when(F.col(predicted), F.col(score))).alias("min_true"), F.max(F.when(~F.col(predicted), F.col(score))).alias("max_false"))
    return g.select("min_true", "max_false", (F.col("max_false") < F.col("min_true")).alias("has_gap"))


def histogram(rows: DataFrame, score: str = "score", bins: int = 50) -> DataFrame:
    """(bin, n) of ``bins`` equal bins between the least and the greatest score, the last closed; all present."""
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    s: Column = F.col(score)
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((s - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    got = rows.where(s.isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dim = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return dim.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def density(rows: DataFrame, by: str, score: str = "score", points: int = 50, bandwidth: float = 0.05) -> DataFrame:
    """(by, x, density): a Gaussian kernel density of each group over ``points`` places in [0, 1].  Equal scores
    are counted first, so the kernel meets different scores, not rows."""
    grid = _counted(rows.where(F.col(score).isNotNull()), score, by)
    spots = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / float(points - 1)))
    k = F.exp(-F.pow((F.col("x") - F.col("s")) / bandwidth, 2) / 2) / (bandwidth * 2.5066282746310002)
    return grid.select(by, "s", "n", spots.alias("x")).groupBy(by, "x").agg((F.sum(k * F.col("n")) / F.sum("n")).alias("density"))
