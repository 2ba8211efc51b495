"""Mergeable rank sketches of scores.

A sketch of one day's, chunk's or micro-batch's scores is a few kilobytes, made by one aggregate, and
sketches merge: a threshold over any set of days needs the days' sketches, not their rows.  The rank of a
quantile is off by at most RANK_ERROR of the rows (with SKETCH_K; `rank_errors` measures it).  Exact
thresholds are those of `flags.score_threshold`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_K = 1024
#: Three times the normalised rank error that a sketch of this size has at 99 % confidence, which is about 0.3 %.
RANK_ERROR = 0.01


def rank_sketches(df: DataFrame, by: list[str], col: str = "anomaly_score", k: int = SKETCH_K) -> DataFrame:
    """(by..., n, sketch) of the non-null values."""
    value = F.col(col).cast("double")
    return (df.filter(value.isNotNull()).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch")))


def merged(sketches: DataFrame, by: list[str] = (), k: int = SKETCH_K) -> DataFrame:
    """(by..., n, sketch): the sketches of each group as one; without groups no row for no sketches."""
    return (sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
            .filter("n > 0"))


def sketch_thresholds(sketches: DataFrame, p: float) -> DataFrame:
    """The sketches with `threshold`, the value at the p-th percentile."""
    return sketches.withColumn("threshold", F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0)))


def rank_errors(df: DataFrame, thresholds: DataFrame, by: list[str], p: float, col: str = "anomaly_score") -> DataFrame:
    """(by..., n, threshold, error): how far the share of rows below or at the threshold is from p, 0 where the
    threshold is an exact order statistic.  One pass, the thresholds broadcast if small."""
    v, t = F.col(col).cast("double"), F.col("threshold")
    joined = df.filter(v.isNotNull()).join(thresholds.select(*by, "threshold"), by)
    low, high = F.count_if(v < t) / F.count(F.lit(1)), F.count_if(v <= t) / F.count(F.lit(1))
    share = F.lit(p / 100.0)
    return (joined.groupBy(*by, "threshold").agg(F.count(F.lit(1)).alias("n"), F.greatest(
        low - share, share - high, F.lit(0.0)).alias("error")).select(*by, "n", "threshold", "error"))
