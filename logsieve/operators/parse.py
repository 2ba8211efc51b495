"""Line parsers (pure projections and filters; they also run on streaming frames)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import split_words, strip

# The timestamp shape at the start of a line, and the label tags.
STRICT_TS_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
# Strings a CSV reader treats as missing by default.
DEFAULT_NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                     "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
ANOMALY_TAG = "##ANOMALY"
NORMAL_TAG = "##NORMAL"
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_strict(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Timestamp = a leading `yyyy-MM-dd HH:mm:ss` shape (not validated), message = the
    stripped rest; lines without it keep the whole line as message and a null time."""
    line = F.col(line_col)
    d = lines.withColumn("_ts", F.nullif(F.regexp_extract(line, STRICT_TS_PATTERN, 1), F.lit("")))
    msg = F.when(F.col("_ts").isNull(), line).otherwise(strip(F.substring(line, 20, 1 << 30)))
    return (d.withColumn("message", msg).withColumnRenamed("_ts", "timestamp")
            .drop(line_col).select(*[c for c in d.columns if c not in (line_col, "_ts")], "timestamp", "message"))


def parse_positional(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Split on white space: the first two words are the timestamp (not validated), the
    rest joined by single spaces is the message; a one-word line gets `N/A`.
    The stripped line and its words are computed once, as columns (an expression object
    reused in several places would be evaluated once per use)."""
    rest = [c for c in lines.columns if c != line_col]
    d = lines.select(*rest, strip(F.col(line_col)).alias("_s"))
    d = d.select(*rest, "_s", split_words(F.col("_s")).alias("_w"))
    w, n = F.col("_w"), F.size(F.col("_w"))
    ts = F.when(n >= 2, F.concat_ws(" ", F.get(w, 0), F.get(w, 1))).otherwise(F.lit("N/A"))
    msg = F.when(n >= 2, F.array_join(F.slice(w, 3, F.greatest(n - 2, F.lit(0))), " ")).otherwise(F.col("_s"))
    return d.select(*rest, ts.alias("timestamp"), msg.alias("message"))


def parse_labelled(lines: DataFrame, line_col: str = "line", strip_timestamp: bool = False) -> DataFrame:
    """`##ANOMALY` anywhere -> label 1, else `##NORMAL` -> 0, else the row is dropped.
    The message is the text before the first `##` (timestamp and trailing space kept,
    unless strip_timestamp=True, which removes a leading timestamp as parse_strict does
    so that fitted text looks like scored text)."""
    line = F.col(line_col)
    label = (F.when(line.contains(ANOMALY_TAG), F.lit(1))
             .when(line.contains(NORMAL_TAG), F.lit(0)))
    msg = F.split_part(line, F.lit("##"), F.lit(1))
    if strip_timestamp:
        msg = strip(F.regexp_replace(msg, STRICT_TS_PATTERN, ""))
    return (lines.withColumn("label", label.cast("int"))
            .filter(F.col("label").isNotNull())
            .withColumn("message", msg)
            .drop(line_col))


def drop_blank(df: DataFrame, col: str = "message") -> DataFrame:
    """Drop rows whose message is null or only white space."""
    # one reference to the column: the optimizer inlines its definition per reference
    return df.filter(F.coalesce(strip(F.col(col)) != "", F.lit(False)))


def coerce_timestamp(c: Column, fmt: str = TS_TEXT_FORMAT) -> Column:
    """Timestamp text -> timestamp without zone; text of another shape -> null."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def null_tokens(c: Column, na_values=tuple(DEFAULT_NA_VALUES)) -> Column:
    """CSV-style missing-value strings become null (as a CSV reader does by default)."""
    return F.when(c.isin(*na_values), F.lit(None).cast("string")).otherwise(c)
