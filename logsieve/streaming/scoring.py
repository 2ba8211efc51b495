"""Scoring a stream in one streaming plan.

`score_stream` explodes the lines of a stream into token positions, looks their losses up in the stored
model's tables (stream-static joins: positions with frequent contexts are not shuffled, and only those with contexts that
the model never saw need its marginals) and sums the losses of each line: the same loss and score as
`plans.detect`, without foreachBatch.  A line's positions are in one micro-batch, so its sum is final when it
is first emitted (update mode), and the watermark on the arrival time lets the state of earlier batches go.

`run_scores` writes the scores, one partition per micro-batch, and keeps a rank sketch of each batch beside
them; `current_threshold` merges the sketches, so the threshold follows the stream without reading a score
again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators.model import ContextModel, loss_of, mean_of_units, positions, units_of
from logsieve.operators.parse import drop_blank, parse_positional
from logsieve.operators.sketch import merged, rank_sketches, sketch_thresholds
from logsieve.operators.tokens import MAX_LENGTH, tokenize
from logsieve.session import dealt


def score_stream(lines: DataFrame, model: ContextModel, max_length: int = MAX_LENGTH) -> DataFrame:
    """(log_id, timestamp, message, anomaly_score, arrived) for a stream (or a table) of (log_id, line); `model` should
    hold its marginals as tables (`summed()`, a loaded or a bucketed model).  log_id must be unique.  The losses of
    the model's own contexts are written once, when the plan is made."""
    # dealt, because a stream's file may be one task, and exchanged once for all branches of the losses
    logs = drop_blank(parse_positional(dealt(lines))).withColumn("arrived", F.current_timestamp())
    pos = positions(tokenize(logs), "log_id", "tokens", max_length, keep=("timestamp", "message", "arrived"))
    # the line's text travels with its first position only
    head = F.when(F.col("pos") == 1, F.struct("timestamp", "message"))
    losses = loss_of(model, pos.select("arrived", "log_id", head.alias("head"), "l", "t", "r")).withWatermark("arrived", "0 seconds")
    return (losses.groupBy("arrived", "log_id")
            .agg(F.first("head", ignorenulls=True).alias("head"),
                 mean_of_units(F.sum(units_of(F.col("loss"))), F.lit(max_length)).alias("anomaly_score"))
            .select("log_id", "head.timestamp", "head.message", "anomaly_score", "arrived"))


def run_scores(scores: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None):
    """Start the stream: `sink`/scores has the rows and `sink`/sketches one rank sketch per micro-batch; a batch that
    is replayed after a failure replaces its partitions."""
    def put(df: DataFrame, name: str, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{sink.rstrip('/')}/{name}"))

    def run(batch: DataFrame, batch_id: int) -> None:
        put(batch, "scores", batch_id)
        # read back, pruned to this batch: the stream is not run again for the sketch
        stored = batch.sparkSession.read.schema("anomaly_score double, batch_id long").parquet(f"{sink.rstrip('/')}/scores")
        put(rank_sketches(stored.filter(F.col("batch_id") == batch_id), []).filter("n > 0"), "sketches", batch_id)

    return (scores.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_threshold(spark: SparkSession, sink: str, p: float) -> DataFrame:
    """(n, threshold) over all micro-batches so far: a merge of their sketches."""
    return sketch_thresholds(merged(spark.read.parquet(f"{sink.rstrip('/')}/sketches")), p).select("n", "threshold")
