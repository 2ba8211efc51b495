"""Streaming detection.

The parse, blank filter and keyword flags are per-row expressions, so they run on a
streaming DataFrame as they are (`flag_stream`).  Model scoring needs whole logs'
positions and the stored model; it runs per micro-batch through `foreachBatch`
(`detect_stream`): each batch is scored against the stored context counts with the
stored threshold and min/max (a percentile or min/max over a stream would need
unbounded state), then appended to the sink.  The stream's checkpoint location makes
the sink restartable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators import explain as ex
from logsieve.operators import flags as fl
from logsieve.operators.model import ContextModel, positions, score, token_losses
from logsieve.operators.parse import drop_blank, parse_positional
from logsieve.operators.tokens import tokenize
from logsieve.plans.detect import RESULT_COLUMNS, score_logs


def flag_stream(lines: DataFrame) -> DataFrame:
    """(log_id, timestamp, message, rule_based_flag, is_whitelisted) for a stream of
    (log_id, line); rule flags already have the allow-list override applied."""
    d = fl.rule_flags(drop_blank(parse_positional(lines)))
    return d.withColumn("rule_based_flag", F.col("rule_based_flag") & ~F.col("is_whitelisted"))


@dataclass
class StoredDetector:
    """What scoring a stream needs from a batch fit: the model, the threshold and the
    min/max of the fitted scores (for the confidence scale)."""
    model: ContextModel
    threshold: float
    min_score: float
    max_score: float

    @classmethod
    def fit(cls, lines: DataFrame, percentile: float = fl.DEFAULT_PERCENTILE) -> "StoredDetector":
        from logsieve.operators.model import fit
        from logsieve.session import written
        logs = drop_blank(parse_positional(lines))
        # the marginals are summed here, once, not again in every batch
        model = fit(positions(tokenize(logs))).summed()
        scores = written(score_logs(logs, model))
        thr = fl.score_threshold(scores, "anomaly_score", percentile).first()["threshold"]
        mm = scores.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
        return cls(model, float(thr), float(mm[0]), float(mm[1]))

    def score_batch(self, lines: DataFrame) -> DataFrame:
        logs = drop_blank(parse_positional(lines))
        # straight from the logs' positions: a batch stores and caches nothing
        pos = positions(tokenize(logs.select("log_id", "message")))
        s = score(token_losses(pos, self.model, keep=lambda table: table))
        out = logs.join(s, "log_id")
        out = out.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(self.threshold))
        out = fl.combine_flags(fl.apply_allowlist(fl.rule_flags(out)))
        conf = (F.col("anomaly_score") - F.lit(self.min_score)) / F.lit(self.max_score - self.min_score
                                                                           + fl.CONFIDENCE_EPS)
        out = out.withColumn("confidence_score", F.round(conf, fl.CONFIDENCE_DIGITS))
        return ex.explain(out).select(*RESULT_COLUMNS)


def detect_stream(lines: DataFrame, detector: StoredDetector, sink_path: str, checkpoint: str,
                  trigger: dict | None = None):
    """Start a streaming query that scores each micro-batch and appends it to Parquet."""
    def run(batch: DataFrame, batch_id: int) -> None:
        # one partition per micro-batch, overwritten when a batch is replayed after a
        # failure: the sink holds each batch exactly once
        (detector.score_batch(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))

    w = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
