"""Classification metrics and training-metric summaries, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Display names of the overall metrics, in report order.
METRIC_NAMES = [("eval_accuracy", "Accuracy"), ("eval_precision", "Precision"),
                ("eval_recall", "Recall"), ("eval_f1", "F1-Score")]


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                           by: list | None = None, ignore_label=-100, weight: str | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (a class's score is 0 when
    its denominator is 0); rows whose label is `ignore_label` or null are left out.  `weight`
    is a column with the number of examples that a row stands for.

    Plan: one confusion-count aggregate (partial counts, so a label holding most rows
    is no problem), then per-class totals over the small confusion table.
    """
    by = list(by or [])
    d = df.filter(F.col(label).isNotNull())
    if ignore_label is not None:
        d = d.filter(F.col(label) != F.lit(ignore_label))
    conf = d.groupBy(*by, F.col(label).alias("_y"), F.col(pred).alias("_p")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    support = conf.groupBy(*by, "_y").agg(F.sum("_n").alias("_s"),
                                          F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)).alias("_tp"))
    predicted = conf.groupBy(*by, F.col("_p").alias("_y")).agg(F.sum("_n").alias("_pc"))
    per = support.join(predicted, by + ["_y"], "left").fillna(0, subset=["_pc"])
    prec = F.coalesce(F.try_divide(F.col("_tp").cast("double"), F.col("_pc").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("_tp").cast("double"), F.col("_s").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("_tp") * F.lit(2.0), (F.col("_s") + F.col("_pc")).cast("double")), F.lit(0.0))
    total = F.sum("_s").cast("double")
    return per.groupBy(*by).agg(
        (F.sum("_tp") / total).alias("accuracy"),
        (F.sum(F.col("_s") * prec) / total).alias("precision"),
        (F.sum(F.col("_s") * rec) / total).alias("recall"),
        (F.sum(F.col("_s") * f1) / total).alias("f1"),
    )


def train_loss_by_chunk(log: DataFrame) -> DataFrame:
    """Mean loss per chunk over training-log entries that have both loss and epoch."""
    return (log.filter(F.col("loss").isNotNull() & F.col("epoch").isNotNull())
            .groupBy("chunk").agg(F.avg("loss").alias("avg_train_loss")))


def lr_by_chunk(log: DataFrame) -> DataFrame:
    """Mean learning rate per chunk over entries that have one."""
    return (log.filter(F.col("learning_rate").isNotNull())
            .groupBy("chunk").agg(F.avg("learning_rate").alias("avg_learning_rate")))


def round_all(df: DataFrame, cols: list, digits: int) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


def overall_metrics(eval_metrics: DataFrame, digits: int = 2) -> DataFrame:
    """Mean of accuracy, precision, recall and F1 over chunks, as (Metric, Value) rows."""
    means = eval_metrics.agg(*[F.avg(c).alias(c) for c, _ in METRIC_NAMES])
    long = means.unpivot([], [c for c, _ in METRIC_NAMES], "metric_key", "Value")
    names = F.create_map(*[x for c, n in METRIC_NAMES for x in (F.lit(c), F.lit(n))])
    return long.select(F.try_element_at(names, F.col("metric_key")).alias("Metric"),
                       F.round(F.col("Value"), digits).alias("Value"))


def join_metrics(eval_metrics: DataFrame, train_loss: DataFrame) -> DataFrame:
    """Evaluation rows with the training loss of the same chunk (left join; both sides
    have one row per chunk)."""
    return eval_metrics.join(train_loss.select("chunk", "avg_train_loss"), "chunk", "left")


def metric_series(eval_metrics: DataFrame, train_loss: DataFrame, lr: DataFrame) -> DataFrame:
    """Long table (chunk, series, value) of every by-chunk chart series."""
    j = join_metrics(eval_metrics, train_loss)
    a = j.unpivot(["chunk"], ["eval_accuracy", "eval_precision", "eval_recall", "eval_f1",
                              "avg_train_loss", "eval_loss"], "series", "value")
    b = lr.unpivot(["chunk"], ["avg_learning_rate"], "series", "value")
    return a.unionByName(b)
