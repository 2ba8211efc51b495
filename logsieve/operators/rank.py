"""Order statistics without sorting: a radix select in a fixed number of rounds.

Each round counts the rows of at most 2**18 buckets (map-side combined), finds the bucket that
holds the wanted rank and hands its bounds to the next round as a one-row frame.  Nothing
comes to the driver and there is one plan for every size.  The input is read once per round:
pass a written table or a cheap projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Buckets of a round for doubles, and digits of a round for longs.
BUCKETS, DIGITS = 1 << 18, 1 << 16
#: After the exponent round a bucket spans a factor of two, i.e. at most 2**52 doubles;
#: three rounds of 18 bits leave one value.
DOUBLE_ROUNDS = 3
LONG_ROUNDS = 4


def _pick(counted: DataFrame, keep: list) -> DataFrame:
    """The bucket that holds the rank, and the rank inside it (no row if there is none).
    `counted`: bucket, c, rank (the same in all rows), and what `keep` needs."""
    running = F.sum("c").over(Window.orderBy("bucket"))      # one task over <= BUCKETS rows
    return (counted.withColumn("_up", running)
            .filter((F.col("_up") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("_up")))
            .select((F.col("rank") - F.col("_up") + F.col("c")).alias("rank"), *keep))


def value_at_rank(df: DataFrame, col: str, rank: DataFrame) -> DataFrame:
    """One row, column `value`: the value of 0-based `rank` among the non-null values of `col`, null if
    there is no such rank.  `rank` is a one-row frame with the column `rank`.  Every round reads
    the round before once (its one row goes along with the counted rows)."""
    floating = isinstance(df.schema[col].dataType, (DoubleType, FloatType))
    rows = df.select(F.col(col).cast("double" if floating else "long").alias("v")).filter("v IS NOT NULL")
    state = rank.select(F.col("rank").cast("long").alias("rank"))
    v, same = F.col("v"), F.max("rank").alias("rank")
    if floating:
        found = [F.count(F.lit(1)).alias("c"), same, F.min("v").alias("lo"), F.max("v").alias("hi")]
        exponent = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v))).cast("double") + 2000))
        state = _pick(rows.crossJoin(F.broadcast(state)).groupBy(exponent.alias("bucket")).agg(*found), ["lo", "hi"])
        for _ in range(DOUBLE_ROUNDS):
            inside = rows.crossJoin(F.broadcast(state)).filter((v >= F.col("lo")) & (v <= F.col("hi")))
            part = F.floor((v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * BUCKETS)
            bucket = F.when(F.col("hi") > F.col("lo"), F.least(part, F.lit(BUCKETS - 1))).otherwise(F.lit(0))
            state = _pick(inside.select(bucket.alias("bucket"), "rank", "v").groupBy("bucket").agg(*found), ["lo", "hi"])
        return state.agg(F.max("lo").alias("value"))
    # longs: 16 bits at a time from the top, the sign bit turned so that digits sort
    state = state.withColumn("prefix", F.lit(0).cast("long"))
    turned = v.bitwiseXOR(F.lit(-2**63))
    for i in range(LONG_ROUNDS):
        shift = 64 - 16 * (i + 1)
        inside = rows.crossJoin(F.broadcast(state))
        if i:
            inside = inside.filter(F.shiftrightunsigned(turned, shift + 16) == F.col("prefix"))
        digit = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit(DIGITS - 1))
        counted = inside.groupBy(digit.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), same, F.max("prefix").alias("prefix"))
        state = _pick(counted, [F.shiftleft("prefix", 16).bitwiseOR(F.col("bucket")).alias("prefix")])
    return state.agg(F.max(F.col("prefix").bitwiseXOR(F.lit(-2**63))).alias("value"))
