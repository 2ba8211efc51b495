"""A model store that grows by chunks.

Context counts and their marginals are tables bucketed and sorted by their keys.  A lookup on those keys reads the
buckets as they lie: only the scored contexts are exchanged, never the model.  `merge` adds the counts of new
logs: every table is joined with the (few) new counts bucket by bucket, and rows that it did not have are
appended, so no table is exchanged either.  A merge writes new versions of the tables beside the old ones and
then moves the pointer, so a failed merge leaves the store as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators.model import MARGINALS, ContextModel
from logsieve.session import written

KEYS = {"counts": ["l", "t", "r"]} | MARGINALS


class ModelStore:
    """Tables `<name>_<table>_v<version>` of the session's catalogue, with files under `path` (a shared folder)."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path.rstrip("/")

    # ------------------------------------------------------------ the pointer
    def _settings(self):
        return self.spark.read.parquet(f"{self.path}/current").first()

    def _point(self, version: int, buckets: int, weights, alpha: float) -> None:
        row = self.spark.createDataFrame([(version, buckets, list(weights), float(alpha))],
                                         "version int, buckets int, weights array<double>, alpha double")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/current")

    def _table(self, table: str, version: int) -> str:
        return f"{self.name}_{table}_v{version}"

    # ------------------------------------------------------------ reading and writing
    def _write(self, df: DataFrame, table: str, version: int, buckets: int, mode: str) -> None:
        keys = KEYS[table]
        (df.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
         .option("path", f"{self.path}/v{version}/{table}").saveAsTable(self._table(table, version)))

    def table(self, table: str, version: int | None = None) -> DataFrame:
        """The current version, registered in this session's catalogue if another session wrote it."""
        at = self._settings()
        version = at["version"] if version is None else version
        full = self._table(table, version)
        if not self.spark.catalog.tableExists(full):
            value = "n BIGINT" if table == "counts" else f"{table} BIGINT, rows BIGINT"
            keys = ", ".join(KEYS[table])
            self.spark.sql(f"CREATE TABLE {full} ({', '.join(f'{k} STRING' for k in KEYS[table])}, {value}) USING parquet "
                           f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {at['buckets']} BUCKETS "
                           f"LOCATION '{self.path}/v{version}/{table}'")
        return self.spark.table(full)

    def save(self, model: ContextModel, buckets: int | None = None) -> None:
        """The first version; `buckets` should be at least the shuffle partitions of the jobs that score."""
        if model.by:
            raise ValueError("a store holds one model")
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for table, keys in KEYS.items():
            df = model.counts.select("l", "t", "r", "n") if table == "counts" else model.marginal(table)
            self._write(df.repartition(buckets, *keys), table, 0, buckets, "overwrite")
        self._point(0, buckets, model.weights, model.alpha)

    def merge(self, counts: DataFrame) -> None:
        """Add the context counts (l, t, r, n) of new logs."""
        at = self._settings()
        version, buckets = at["version"], at["buckets"]
        new = written(counts.groupBy("l", "t", "r").agg(F.sum("n").alias("n")))
        old = self.table("counts", version)
        seen = old.select("l", "t", "r", F.lit(0).cast("long").alias("rows"))
        new = written(new.join(seen, ["l", "t", "r"], "left").withColumn("rows", F.coalesce("rows", F.lit(1).cast("long"))))
        for table, keys in KEYS.items():
            values = ["n"] if table == "counts" else [table, "rows"]
            added = new.groupBy(*keys).agg(F.sum("n").alias(values[0]), *[F.sum(c).alias(c) for c in values[1:]])
            added = added.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
            base = self.table(table, version)
            summed = base.join(added, keys, "left").select(
                *[base[k] for k in keys], *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in values])
            self._write(summed, table, version + 1, buckets, "overwrite")
            fresh = added.join(base.select(*keys), keys, "left_anti").select(*keys, *[F.col(f"_{c}").alias(c) for c in values])
            self._write(fresh, table, version + 1, buckets, "append")
        self._point(version + 1, buckets, at["weights"], at["alpha"])

    def model(self) -> ContextModel:
        """The current model; its lookups do not exchange the store's tables."""
        at = self._settings()
        tables = {name: self.table(name) for name in MARGINALS}
        tables["totals"] = written(tables["n_t"].agg(F.sum("n_t").alias("_N"), F.count(F.lit(1)).alias("_V")))
        return ContextModel(self.table("counts"), (), tuple(at["weights"]), at["alpha"], tables)
