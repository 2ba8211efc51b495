"""Report tables: per-log HTML rows, chart series and the heat-map matrix in long form.
They stay distributed DataFrames; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import lookup
from logsieve.operators.flags import CONFIDENCE_EPS, anomaly_type
from logsieve.operators.parse import coerce_timestamp

# Colours per anomaly type and the heat-map row labels.
TYPE_COLOURS = {"MLM": "red", "Rule-Based": "orange", "Both": "purple"}
HEATMAP_LABELS = ["Anomaly Score", "Confidence Score", "Combined Anomaly"]


def html_escape(c: Column) -> Column:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fixed(c: Column, digits: int) -> Column:
    """Decimal text with `digits` places, rounded half away from zero on the decimal
    value (exact for inputs already rounded to 6 places)."""
    return F.round(c.cast("decimal(24,6)"), digits).cast(f"decimal(24,{digits})").cast("string")


def report_row(df: DataFrame) -> DataFrame:
    flag = lambda c: F.col(c).cast("int").cast("string")
    cls = F.when(F.col("combined_anomaly"), F.lit("anomaly-log")).otherwise(F.lit("normal-log"))
    html = F.concat(
        F.lit("<div class='"), cls, F.lit("'><p><strong>Timestamp:</strong> "),
        html_escape(F.coalesce("timestamp", F.lit("N/A"))),
        F.lit("<br/><strong>Log:</strong> "), html_escape(F.col("message")),
        F.lit("<br/><strong>Anomaly Score:</strong> "), fixed(F.col("anomaly_score"), 4),
        F.lit(" | <strong>Confidence:</strong> "), fixed(F.col("confidence_score"), 2),
        F.lit(" | <strong>MLM Prediction:</strong> "), flag("is_anomaly"),
        F.lit(" | <strong>Rule Match:</strong> "), flag("rule_based_flag"),
        F.lit(" | <strong>Combined:</strong> "), flag("combined_anomaly"),
        F.lit("<br/><strong>Explanation:</strong> "), html_escape(F.col("explanation")),
        F.lit("</p></div><hr>"))
    return df.withColumn("html", html)


def hover_text(df: DataFrame) -> DataFrame:
    return df.withColumn("hover", F.concat(F.col("anomaly_type"), F.lit("<br>"), F.col("message")))


def anomaly_series(df: DataFrame) -> DataFrame:
    """Flagged logs with type, colour, parsed time and hover text (score-over-time chart)."""
    out = anomaly_type(df.filter(F.col("combined_anomaly")))
    out = out.withColumn("colour", lookup(F.col("anomaly_type"), TYPE_COLOURS))
    out = out.withColumn("ts", coerce_timestamp(F.col("timestamp")))
    return hover_text(out)


def anomaly_counts(summary: DataFrame) -> DataFrame:
    """Three bars: MLM, Rule-Based, Combined."""
    return summary.select(F.inline(F.array(
        F.struct(F.lit("MLM").alias("type"), F.col("mlm_anomalies").alias("count")),
        F.struct(F.lit("Rule-Based").alias("type"), F.col("rule_anomalies").alias("count")),
        F.struct(F.lit("Combined").alias("type"), F.col("combined_anomalies").alias("count")))))


def heatmap_long(df: DataFrame, index_col: str = "idx", id_col: str = "log_id") -> DataFrame:
    """(log_id, label `Log i+1`, measure, value): unrounded scaled score, confidence and
    the combined flag as 0/1; `index_col` is the log's 0-based position."""
    mm = df.agg(F.min("anomaly_score").alias("_mn"), F.max("anomaly_score").alias("_mx"))
    d = df.crossJoin(F.broadcast(mm))
    scaled = (F.col("anomaly_score") - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + F.lit(CONFIDENCE_EPS))
    label = F.concat(F.lit("Log "), (F.col(index_col) + 1).cast("string"))
    return d.select(id_col, label.alias("label"), F.inline(F.array(
        F.struct(F.lit(HEATMAP_LABELS[0]).alias("measure"), F.round(scaled, 6).alias("value")),
        F.struct(F.lit(HEATMAP_LABELS[1]).alias("measure"), F.col("confidence_score").cast("double").alias("value")),
        F.struct(F.lit(HEATMAP_LABELS[2]).alias("measure"), F.col("combined_anomaly").cast("double").alias("value")))))


# ---------------------------------------------------------------- chart tables of a bounded size
def series_reduced(series: DataFrame, pixels: int = 500, by: str = "anomaly_type", ts_col: str = "ts",
                   score_col: str = "anomaly_score", id_col: str = "log_id") -> DataFrame:
    """The score-over-time chart with at most `pixels` columns per series: of each column the first, last, least and
    greatest score, which draw the same line as all points do.  (by, bucket, n, first_score, last_score, least,
    greatest); rows without a time are bucket -1.  One aggregate after the range of times; ties of time go
    by the id."""
    seconds = F.col(ts_col).cast("timestamp").cast("long")
    d = series.withColumn("_s", seconds)
    ends = d.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    bucket = F.coalesce(F.expr(f"(_s - _lo) * {int(pixels)} div (_hi - _lo + 1)"), F.lit(-1).cast("long"))
    d = d.crossJoin(F.broadcast(ends)).withColumn("bucket", bucket)
    order, score = F.struct("_s", id_col), F.col(score_col)
    return d.groupBy(by, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(score, order).alias("first_score"), F.max_by(score, order).alias("last_score"),
        F.min(score).alias("least"), F.max(score).alias("greatest"))


def heatmap_reduced(long: DataFrame, positions: DataFrame, cells: int = 200, id_col: str = "log_id") -> DataFrame:
    """The heat map with at most `cells` columns: of each column and measure the number of logs, the least, the greatest
    and the mean value (exact decimal, rounded to 6 places).  `positions` is (id, idx), the logs' 0-based order."""
    size = positions.agg(F.count(F.lit(1)).alias("_n"))
    cell = positions.crossJoin(F.broadcast(size)).select(id_col, F.expr(f"idx * least({int(cells)}, _n) div _n").alias("cell"))
    value = F.col("value").cast("decimal(18,6)")
    return long.join(cell, id_col).groupBy("cell", "measure").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"),
        F.round(F.sum(value) / F.count(F.lit(1)), 6).cast("double").alias("mean"))
