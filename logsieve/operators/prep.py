"""Row positions, splits, chunks and shuffles.

A global position (`with_global_index`) never uses an un-partitioned window: the order keys are
range-partitioned, sorted inside each partition, numbered inside the partition, and
shifted by the running count of the partitions before them (a table with one row per
partition, so broadcasting it is bounded by the partition count).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions.hashing import h01
from logsieve.operators.rank import value_at_rank
from logsieve.session import written

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row within partition
#: Rows that one partition numbers.
INDEX_ROWS = 1_000_000


def with_global_index(df: DataFrame, order: list, index_col: str = "idx", id_col: str | None = None,
                      rows_per_partition: int = INDEX_ROWS) -> DataFrame:
    """Add `index_col` = 0..n-1 following `order` (names, expressions, or `descending(...)` of one).

    The order must be total (end it with a unique key), otherwise the numbering of
    ties is arbitrary.  With `id_col` (a unique column) only it and the order keys are
    sorted and numbered, and the number is joined back to the rows; without it the
    whole rows are (for narrow frames).  The numbered keys are written to the shared
    folder, so that a lost executor cannot renumber a partition.
    """
    keys = [F.col(id_col).alias("_id")] if id_col else [F.col(c) for c in df.columns]
    names = [f"_o{i}" for i in range(len(order))]
    terms, sorts = [], []
    for c, name in zip(order, names):
        backwards = isinstance(c, Descending)
        inner = c.inner if backwards else c
        terms.append((F.col(inner) if isinstance(inner, str) else inner).alias(name))
        sorts.append(F.col(name).desc() if backwards else F.col(name).asc())
    narrow = written(df.select(*keys, *terms))
    parts = max(1, -(-narrow.count() // rows_per_partition))
    numbered = written(narrow.repartitionByRange(parts, *sorts).sortWithinPartitions(*sorts).drop(*names)
                       .withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    sizes = numbered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the running sum runs in one task on a table of `parts` rows
    offsets = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    indexed = (numbered.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
               .withColumn(index_col, (F.col("_off") + local).cast("bigint")).drop("_mid", "_pid", "_off"))
    if id_col is None:
        return indexed
    return df.join(indexed.withColumnRenamed("_id", id_col), id_col)


@dataclass
class Descending:
    inner: object


def descending(c) -> Descending:
    """A descending term for `with_global_index`."""
    return Descending(c)


def shuffle(df: DataFrame, key: str, seed: int = 0, out: str = "place") -> DataFrame:
    """A seeded random order: `out` = 0..n-1 by `h01(seed, 'shuffle', key)` (ties by key)."""
    return with_global_index(df, [h01(seed, "shuffle", F.col(key)), key], out, key)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 0,
                     exact: bool = True, out: str = "is_test") -> DataFrame:
    """Random split marked in `out` (no rows dropped).

    exact: the test part has exactly ceil(test_size * n) rows -- the rows with the
    smallest `h01(seed, key)`, ties by the (whole-number) key, found by a radix select.  Otherwise each row is test when
    its draw is below `test_size` (no extra job, size only approximately right).
    """
    h = h01(seed, "split", F.col(key))
    if not exact:
        return df.withColumn(out, h < F.lit(test_size))
    draws = written(df.select(F.col(key).alias("_k"), h.alias("_h")))
    wanted = draws.agg((F.ceil(F.count(F.lit(1)) * F.lit(test_size)) - 1).alias("rank"))
    draw = written(value_at_rank(draws, "_h", wanted))            # one row
    # ties of the draw go by key
    at = draws.crossJoin(F.broadcast(draw))
    below = at.agg(F.count_if(F.col("_h") < F.col("value")).alias("below"))
    rest = wanted.crossJoin(below).select((F.col("rank") - F.col("below")).alias("rank"))
    last = value_at_rank(at.filter(F.col("_h") == F.col("value")).select("_k"), "_k", rest)
    edge = draw.select(F.col("value").alias("_edge")).crossJoin(last.select(F.col("value").alias("_last")))
    test = (F.col("_h") < F.col("_edge")) | ((F.col("_h") == F.col("_edge")) & (F.col(key) <= F.col("_last")))
    return (df.withColumn("_h", h).crossJoin(F.broadcast(edge))
            .withColumn(out, F.coalesce(test, F.lit(False))).drop("_h", "_edge", "_last"))


def chunk_of(idx: Column, n: Column, k: int, remainder: str = "last") -> Column:
    """Chunk number 1..k of a 0-based position when n rows are cut into k contiguous
    chunks of n div k rows.  remainder='last': the last chunk also takes the rest;
    remainder='drop': rows after k full chunks get null."""
    size = F.floor(n / F.lit(k))
    if remainder == "last":
        return F.when(size == 0, F.lit(k)).otherwise(
            F.least(F.floor(idx / size), F.lit(k - 1)) + 1).cast("int")
    if remainder == "drop":
        c = F.floor(idx / size) + 1
        return F.when((size > 0) & (c <= k), c).cast("int")
    raise ValueError(remainder)


def chunk(df: DataFrame, k: int, order: list, remainder: str = "last", out: str = "chunk",
          keep_index: bool = False, id_col: str = "log_id") -> DataFrame:
    """Contiguous chunks over `order`; with remainder='drop' the rest rows are removed."""
    indexed = with_global_index(df, order, "_idx", id_col)
    n = df.select(F.count(F.lit(1)).alias("_n"))
    res = (indexed.crossJoin(F.broadcast(n))
           .withColumn(out, chunk_of(F.col("_idx"), F.col("_n"), k, remainder))
           .drop("_n"))
    if remainder == "drop":
        res = res.filter(F.col(out).isNotNull())
    return res if keep_index else res.drop("_idx")
