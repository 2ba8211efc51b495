"""Thresholds, rule flags, allow-list, combined flag, confidence and the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import contains_any
from logsieve.operators.rank import value_at_rank

# Keyword lists (literal, case-sensitive) and the confidence scaling.
ANOMALY_KEYWORDS = ["[ERR]", "[WRN]", "[CRIT]"]
ALLOW_KEYWORDS = ["[INF]", "[DBG]", "[OK]"]
CONFIDENCE_EPS = 1e-5
CONFIDENCE_DIGITS = 4
DEFAULT_PERCENTILE = 70


def rule_flags(df: DataFrame, col: str = "message", anomaly_keywords=ANOMALY_KEYWORDS,
               allow_keywords=ALLOW_KEYWORDS) -> DataFrame:
    """rule_based_flag / is_whitelisted before the allow-list override."""
    c = F.col(col)
    return (df.withColumn("rule_based_flag", contains_any(c, anomaly_keywords))
              .withColumn("is_whitelisted", contains_any(c, allow_keywords)))


def apply_allowlist(df: DataFrame) -> DataFrame:
    """Allow-listed rows lose both the model flag and the rule flag."""
    ok = ~F.col("is_whitelisted")
    return (df.withColumn("is_anomaly", F.col("is_anomaly") & ok)
              .withColumn("rule_based_flag", F.col("rule_based_flag") & ok))


def combine_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("combined_anomaly", F.col("is_anomaly") | F.col("rule_based_flag"))


def flag_scores(df: DataFrame, threshold: DataFrame, col: str = "anomaly_score") -> DataFrame:
    """is_anomaly = score > threshold (strict); `threshold` is a one-row frame."""
    return (df.crossJoin(F.broadcast(threshold.select("threshold")))
              .withColumn("is_anomaly", F.coalesce(F.col(col) > F.col("threshold"), F.lit(False)))
              .drop("threshold"))


def score_threshold(df: DataFrame, col: str = "anomaly_score", p: float = DEFAULT_PERCENTILE,
                    method: str = "select") -> DataFrame:
    """p-th percentile with linear interpolation (as NumPy's default), as a one-row frame
    (null for no scores).

    select: two neighbouring order statistics by a radix select (operators.rank).
    exact:  Spark's `percentile` (one reducer merges a value -> count map).
    """
    if method == "exact":
        return df.agg(F.percentile(F.col(col), F.lit(p / 100.0)).alias("threshold"))
    vals = df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL")
    place = (F.count(F.lit(1)) - 1) * F.lit(p) / 100.0
    wanted = vals.agg(place.alias("place")).select("place", F.floor("place").alias("rank"))
    low = value_at_rank(vals, "v", wanted).crossJoin(wanted)
    # the next order statistic: the same value again, or the smallest one above it
    around = vals.crossJoin(F.broadcast(low)).agg(
        F.count_if(F.col("v") <= F.col("value")).alias("upto"),
        F.min(F.when(F.col("v") > F.col("value"), F.col("v"))).alias("above"),
        *[F.max(c).alias(c) for c in ("value", "place", "rank")])
    share = F.col("place") - F.col("rank")
    high = F.when((F.col("rank") + 1 < F.col("upto")) | (share == 0), F.col("value")).otherwise(F.col("above"))
    return around.select((F.col("value") + (high - F.col("value")) * share).alias("threshold"))


def confidence(df: DataFrame, col: str = "anomaly_score", out: str = "confidence_score",
               eps: float = CONFIDENCE_EPS, digits: int | None = CONFIDENCE_DIGITS) -> DataFrame:
    """Min-max scaling over all rows: (x - min) / (max - min + eps), rounded."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    v = (F.col(col) - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + F.lit(eps))
    if digits is not None:
        v = F.round(v, digits)
    return df.crossJoin(F.broadcast(mm)).withColumn(out, v).drop("_mn", "_mx")


def anomaly_type(df: DataFrame) -> DataFrame:
    m, r = F.col("is_anomaly"), F.col("rule_based_flag")
    return df.withColumn("anomaly_type", F.when(m & ~r, "MLM").when(r & ~m, "Rule-Based")
                         .when(m & r, "Both").otherwise("Normal"))


def summarize(df: DataFrame) -> DataFrame:
    """Totals and percentages of model, rule and combined flags (one aggregate)."""
    total = F.count(F.lit(1))
    out = df.agg(
        total.alias("total_logs"),
        F.count_if("is_anomaly").alias("mlm_anomalies"),
        F.count_if("rule_based_flag").alias("rule_anomalies"),
        F.count_if("combined_anomaly").alias("combined_anomalies"),
    )
    for name, src in [("mlm_percent", "mlm_anomalies"), ("rule_percent", "rule_anomalies"),
                      ("combined_percent", "combined_anomalies")]:
        out = out.withColumn(name, F.round(F.try_divide(F.col(src) * F.lit(100.0),
                                                        F.col("total_logs").cast("double")), 6))
    return out
