"""Sinks and readers: parsed-log CSV, encoded data sets, metrics tables, fitted models,
detection results and per-log report rows.  All are distributed writes/reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from logsieve.operators.model import MARGINALS, ContextModel
from logsieve.operators.parse import DEFAULT_NA_VALUES, null_tokens

PARSED_SCHEMA = StructType([StructField("timestamp", StringType()), StructField("message", StringType())])
EVAL_SCHEMA = StructType([StructField(c, DoubleType()) for c in
                          ["eval_loss", "eval_accuracy", "eval_precision", "eval_recall", "eval_f1",
                           "eval_runtime", "eval_samples_per_second", "eval_steps_per_second", "epoch"]]
                         + [StructField("chunk", IntegerType())])
TRAIN_LOSS_SCHEMA = StructType([StructField("chunk", IntegerType()), StructField("avg_train_loss", DoubleType())])
LR_SCHEMA = StructType([StructField("chunk", IntegerType()), StructField("avg_learning_rate", DoubleType())])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; fields are quoted only when they need it."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_parsed_csv(spark: SparkSession, path: str, na_values=DEFAULT_NA_VALUES) -> DataFrame:
    """Parsed logs back from CSV with a fixed schema; missing-value strings become null."""
    df = (spark.read.schema(PARSED_SCHEMA).option("header", True).option("escape", '"')
          .option("nullValue", None).option("emptyValue", "").csv(path))
    return df.select(*[null_tokens(F.col(c), na_values).alias(c) for c in df.columns])


def write_encoded(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_metrics(df: DataFrame, path: str, chunk_col: str = "chunk") -> None:
    """One row (or more) per chunk, stored partitioned by chunk.  Dynamic partition
    overwrite replaces the rows of the chunks being written, so a rerun does not
    duplicate them; other chunks are kept."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(chunk_col).parquet(path))


def read_metrics(spark: SparkSession, directory: str) -> dict:
    """The three metric files (eval metrics, train loss, learning rate) with fixed schemas."""
    def rd(name, schema):
        return spark.read.schema(schema).option("header", True).csv(f"{directory.rstrip('/')}/{name}")
    return {"eval": rd("eval_metrics.csv", EVAL_SCHEMA),
            "train_loss": rd("train_loss.csv", TRAIN_LOSS_SCHEMA),
            "learning_rate": rd("learning_rate_log.csv", LR_SCHEMA)}


def save_model(model: ContextModel, path: str, vocab: DataFrame | None = None) -> None:
    """Context counts as Parquet (partitioned by chunk for a chunked model, so one
    chunk's model is read by partition pruning), their marginals, the mixture weights and alpha,
    and the vocabulary, side by side."""
    root = path.rstrip("/")

    def put(df: DataFrame, name: str) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*model.by) if model.by else w).parquet(f"{root}/{name}")

    put(model.counts, "counts")
    for name in MARGINALS:
        put(model.marginal(name), name)
    put(model.totals(), "totals")
    spark = model.counts.sparkSession
    settings = spark.createDataFrame([(list(model.weights), float(model.alpha), list(model.by))],
                                     "weights array<double>, alpha double, by array<string>")
    settings.coalesce(1).write.mode("overwrite").parquet(f"{root}/settings")
    if vocab is not None:
        vocab.write.mode("overwrite").parquet(f"{root}/vocab")


def load_model(spark: SparkSession, path: str, chunk: int | None = None, chunk_col: str = "chunk") -> ContextModel:
    """The stored model, with its weights, alpha and marginals; `chunk` picks one chunk's model."""
    root = path.rstrip("/")
    settings = spark.read.parquet(f"{root}/settings").first()
    by = tuple(settings["by"])
    one = chunk is not None and chunk_col in by

    def get(name: str) -> DataFrame:
        df = spark.read.parquet(f"{root}/{name}")
        return df.filter(F.col(chunk_col) == chunk).drop(chunk_col) if one else df

    by = tuple(c for c in by if not (one and c == chunk_col))
    tables = {name: get(name) for name in (*MARGINALS, "totals")}
    return ContextModel(get("counts").select(*by, "l", "t", "r", "n"), by, tuple(settings["weights"]),
                        settings["alpha"], tables)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/vocab")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """All scored rows (not only anomalies)."""
    if fmt == "csv":
        cols = [F.array_join(F.col(c), " ").alias(c) if str(df.schema[c].dataType).startswith("ArrayType")
                else F.col(c) for c in df.columns]
        write_csv(df.select(*cols), path, mode)
    else:
        df.write.mode(mode).parquet(path)


def write_report_rows(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """One HTML fragment per log, files in log order: range partitioning by log id, each
    partition sorted -- part files concatenated in name order give the whole report.  The rows are stored
    once, before they are counted, sampled for the ranges and sorted."""
    from logsieve.operators.report import report_row
    from logsieve.session import written
    df = written(df)
    rows = report_row(df).select("log_id", "html")
    n = max(1, -(-df.count() // rows_per_file))
    (rows.repartitionByRange(n, "log_id").sortWithinPartitions("log_id")
     .select("html").write.mode("overwrite").text(path))
