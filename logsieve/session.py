"""Session helpers.

Everything in the library takes an existing SparkSession; `get_spark` is only a
convenience for tests, the bench and notebooks.  On a cluster the session comes
from the platform and its settings win: we only fill in settings that are unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on.  AQE re-plans joins at run time: it turns a join into a
# broadcast only after measuring the real size of a side (so no broadcast is made on
# a guess), coalesces small shuffle partitions and splits skewed ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the status store keeps every job, stage and SQL execution of a session (with or
    # without the UI); long sessions of many small queries keep only recent ones
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "10000",
    "spark.sql.ui.retainedExecutions": "50",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "logsieve", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Read from the session (`spark.checkpoint.dir`, or the context's directory).  Only
    when nothing is configured -- local tests and the bench -- a private folder under
    the system temp dir is created and registered.  A cluster must configure a
    shared, durable folder; a machine-local one would not survive executor loss.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="logsieve-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


#: The folder of the innermost `scratch` block.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that are written inside the block lie in a folder of their own in the checkpoint folder, and go with it
    at the end of the block.  Store or collect what is needed before: results made inside cannot be read
    afterwards."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write the frame as a table in the shared checkpoint folder and go on from the files.

    Used where several later steps read one result: the plan above is run once, nothing stays
    in the executors' memory, and a lost executor costs no recomputation.  The tables live
    as long as the folder, or as the `scratch` block around.  With `spread` the rows are dealt over the shuffle
    partitions first: for narrow rows that much work follows on (token positions), which may come from one file."""
    spark = df.sparkSession
    if spread:
        df = dealt(df)
    path = f"{(_FOLDER.get() or checkpoint_dir(spark)).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, dealt over the session's shuffle partitions: evenly, or by `keys`."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
