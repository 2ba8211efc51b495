"""Log-line sources.

`read_log_lines` reads text files; `logs_from_events` turns the `events` table into
log lines (plain, labelled or deliberately messy) so every operator can run on the
shared test tables.  Both return `(log_id BIGINT, line STRING)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.functions.text import strip
from logsieve.session import written

#: Rows of the table of splits (about 200 bytes each) that are broadcast: at most some 20 MB.
SPLITS_AT_ONCE = 100_000

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def clean_lines(df: DataFrame, col: str = "line") -> DataFrame:
    """Strip both ends (Unicode white space) and drop blank lines."""
    return df.withColumn(col, strip(F.col(col))).filter(F.col(col) != "")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 text -> one row per non-blank line, stripped; `log_id` 0..n-1 follows the file order
    (files by path, lines as they stand).

    Spark packs the splits of several files into partitions by size, but the lines of one split
    stay together and in order.  So the splits are numbered (one row per split: its path, offset,
    first row number and line count), and a line's id is the count of lines before its
    split plus its place in it.  There is one row per split (some 100 MB of text, or a file), so that table is
    a small fraction of the input; it is broadcast up to SPLITS_AT_ONCE rows, counted first, and beyond that
    the join is left to the planner.  The lines are never sorted."""
    at = ["file_path", "block_start"]
    df = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"),
                                       F.col("_metadata.file_block_start").alias("block_start"),
                                       strip(F.col("value")).alias("line"))
          .filter(F.col("line") != "").withColumn("_row", F.monotonically_increasing_id()))
    splits = df.groupBy(*at).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*at)) - F.col("_n")        # one task over the splits
    table = written(splits.withColumn("_before", before))
    few = table.count() <= SPLITS_AT_ONCE
    return (df.join(F.broadcast(table) if few else table, at)
            .select((F.col("_before") + F.col("_row") - F.col("_first")).cast("bigint").alias("log_id"), "line"))


def _channel(et):
    return (F.when(et == "signup", "mon").when(et == "view", "client").otherwise("cluster"))


def _severity(et):
    return (F.when(et == "error", "ERR").when(et == "purchase", "WRN")
            .when(et == "view", "DBG").when(et == "click", "INF").when(et == "signup", "NTC")
            .otherwise("UNK"))


def logs_from_events(events: DataFrame, view: str = "plain") -> DataFrame:
    """Log lines derived from `events`.

    plain:     `<ts> log_channel(<ch>) log [<SEV>] : <event_type> user <u> k <k>`
    labelled:  plain + ` ##ANOMALY` for errors, ` ##NORMAL` for others, no tag for signups
    messy:     plain lines damaged by `event_id % 7` (doubled spaces and a tab, missing
               timestamp, one word, two words, blank, month 13, both severity tags)

    The time text and the body are projected once as columns and the variants refer to
    them (an expression object reused in several branches would be evaluated, and
    printed in every plan, once per use).
    """
    if view not in ("plain", "labelled", "messy"):
        raise ValueError(f"unknown view {view!r}")
    et = F.col("event_type")
    base = events.select(
        F.col("event_id").alias("log_id"), et,
        F.col("user_id").cast("string").alias("_u"),
        F.date_format(F.col("ts"), TS_FORMAT).alias("_ts"),
        F.concat(
            F.lit("log_channel("), _channel(et), F.lit(") log ["), _severity(et), F.lit("] : "),
            et, F.lit(" user "), F.col("user_id").cast("string"),
            F.lit(" k "), F.get_json_object(F.col("props"), "$.k"),
        ).alias("_body"))
    base = base.select("log_id", "event_type", "_u", "_ts", "_body",
                       F.concat(F.col("_ts"), F.lit(" "), F.col("_body")).alias("_plain"))
    plain, body, ts = F.col("_plain"), F.col("_body"), F.col("_ts")
    if view == "plain":
        line = plain
    elif view == "labelled":
        line = (F.when(et == "error", F.concat(plain, F.lit(" ##ANOMALY")))
                .when(et == "signup", plain)
                .otherwise(F.concat(plain, F.lit(" ##NORMAL"))))
    else:
        r = F.col("log_id") % 7
        line = (F.when(r == 0, F.concat(F.replace(plain, F.lit(" "), F.lit("  ")), F.lit("\t")))
                .when(r == 1, F.concat(F.lit(" "), body))
                .when(r == 2, et)
                .when(r == 3, F.concat(et, F.lit(" "), F.col("_u")))
                .when(r == 4, F.lit(" \t "))
                .when(r == 5, F.concat(F.substring(ts, 1, 5), F.lit("13"), F.substring(ts, 8, 12),
                                       F.lit(" "), body))
                .otherwise(F.concat(plain, F.lit(" [ERR] [OK]"))))
    return base.select("log_id", line.alias("line"))


def training_log_from_events(events: DataFrame) -> DataFrame:
    """A training log `(chunk, step, epoch, loss, learning_rate)` with gaps, from events."""
    eid = F.col("event_id")
    return events.select(
        (eid % 5 + 1).cast("int").alias("chunk"),
        eid.alias("step"),
        F.when(eid % 3 == 0, F.lit(None).cast("double"))
         .otherwise((eid % 5).cast("double")).alias("epoch"),
        F.when(F.col("event_type") == "click", F.lit(None).cast("double"))
         .otherwise(F.col("value")).alias("loss"),
        F.when(eid % 4 == 0, F.lit(None).cast("double"))
         .otherwise((eid % 10).cast("double") * F.lit(3e-6)).alias("learning_rate"),
    )
