"""Joins that stay balanced when one key holds a large share of the rows.

`frequency_split_join` joins a big frame to a keyed table that knows how often each
key occurs (a count column).  Hot keys come from two sides:

* of the keyed table: keys whose count is at least total/max_hot, of which there are at most
  `max_hot` by construction;
* of the big frame: keys that a mergeable heavy-hitter sketch of its rows (`heavy_keys`) names, at most
  HEAVY_KEYS, whether the keyed table has them or not.

The hot slice of the keyed table has a proven size bound and is broadcast.  Rows that it has served,
and rows whose heavy key the table does not have, travel under a key of their own that matches
nothing, so they are dealt evenly; the rest is a plain join on the keys, so a keyed table
that is bucketed by them is not moved.  The big frame is read once, so lookups can be chained without
the plan doubling.

`apart_join` is for one lookup of many rows (token positions): rows of hot keys stay where they are and only the
rest is shuffled, which it pays for by reading the big frame twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Heavy keys that a sketch names at most, and keys that it tracks: with so many, every key that holds more
#: than about a thousandth of the rows is named.  A key of fewer than LEAST_ROWS rows burdens no task.
HEAVY_KEYS, TRACKED, LEAST_ROWS = 1024, 4096, 250_000


def key_hash(keys: list[str]) -> Column:
    """A hash that does not depend on the keys' exact types (int or bigint)."""
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


def heavy_keys(rows: DataFrame, key_sets: dict[str, list[str]], least_rows: int = LEAST_ROWS) -> dict[str, DataFrame]:
    """name -> (_heavy): hashes of the keys that hold a large share of the rows, and at least `least_rows`;
    names without such keys are left out.  One pass for all key sets: each partition makes a frequent-items
    sketch per set, and the sketches are merged, so nothing is shuffled but those; the driver gets at most
    HEAVY_KEYS numbers per set.  `rows` should be a written table."""
    if rows.count() < least_rows:
        return {}
    sketches = [F.expr(f"approx_top_k(_{name}, {HEAVY_KEYS}, {TRACKED})").alias(name) for name in key_sets]
    found = (rows.select(*[key_hash(keys).alias(f"_{name}") for name, keys in key_sets.items()])
             .agg(F.count(F.lit(1)).alias("_rows"), *sketches).first())
    share = max(least_rows, found["_rows"] / HEAVY_KEYS)
    named = {name: [(x["item"],) for x in found[name] if x["count"] >= share] for name in key_sets}
    return {name: rows.sparkSession.createDataFrame(x, "_heavy long") for name, x in named.items() if x}


def frequency_split_join(big: DataFrame, keyed: DataFrame, keys: list[str], freq_col: str,
                         how: str = "inner", max_hot: int = 50_000, heavy: DataFrame | None = None) -> DataFrame:
    """`keyed` has one row per key; its columns other than the keys and `freq_col` are added.
    Every read of `keyed` (its total, hot rows, all rows) should be cheap: pass a written table
    or an aggregate whose exchange can be reused.  `heavy` is a result of `heavy_keys` for the same
    keys of `big`.  Null keys match nothing."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    payload = [c for c in keyed.columns if c != freq_col and c not in keys]
    found = lambda name: F.struct(*[F.col(c) for c in payload], F.lit(True).alias("_ok")).alias(name)
    # a scalar subquery, so that the planner still knows how small the keyed table is
    frequent = F.col(freq_col) * F.lit(max_hot) >= keyed.agg(F.sum(freq_col)).scalar()
    rows = big
    if heavy is None:
        hot = keyed.filter(frequent)                                                    # <= max_hot rows
    else:
        marked = keyed.withColumn("_heavy", key_hash(keys)).join(F.broadcast(heavy.withColumn("_is", F.lit(True))), "_heavy", "left")
        hot = marked.filter(frequent | F.col("_is")).drop("_heavy", "_is")              # <= max_hot + HEAVY_KEYS
        rows = (big.withColumn("_heavy", key_hash(keys))
                .join(F.broadcast(heavy.withColumn("_is", F.lit(True))), "_heavy", "left").drop("_heavy"))
    rows = rows.join(F.broadcast(hot.select(*keys, found("_served"))), keys, "left")
    alone = F.col("_served").isNotNull() if heavy is None else F.col("_served").isNotNull() | F.col("_is").isNotNull()
    own = F.xxhash64(*[F.col(c) for c in big.columns]).bitwiseOR(F.lit(1))
    text = next((k for k in keys if isinstance(keyed.schema[k].dataType, StringType)
                 and isinstance(big.schema[k].dataType, StringType)), None)
    if text is not None:
        # a string key that no table has: the keyed side stays as it is stored
        spread = F.when(alone, F.concat(F.lit("\u0000"), own.cast("string"))).otherwise(F.col(text))
        other = keyed.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], found("_other"))
        rows = rows.withColumn("_spread", spread)
        same = [F.col("_spread" if k == text else k) == F.col(f"_key_{i}") for i, k in enumerate(keys)]
        out = rows.join(other, same, "left")
    else:
        other = keyed.select(*keys, F.lit(0).cast("long").alias("_spread"), found("_other"))
        out = rows.withColumn("_spread", F.when(alone, own).otherwise(0)).join(other, [*keys, "_spread"], "left")
    if how == "inner":
        out = out.filter("_served IS NOT NULL OR _other IS NOT NULL")
    value = lambda c: F.coalesce(F.col("_served").getField(c), F.col("_other").getField(c)).alias(c)
    return out.select(*big.columns, *[value(c) for c in payload])


def apart_join(big: DataFrame, keyed: DataFrame, keys: list[str], freq_col: str, max_hot: int = 50_000) -> DataFrame:
    """The inner join of `frequency_split_join`, for rows that are cheap to make again (exploded from a table):
    rows of hot keys meet the broadcast hot slice (at most `max_hot` rows, since their counts are at least
    total / max_hot) and are not shuffled; of the others only a total / max_hot can have one key.  `keyed`, a written
    table, counts each key of `big`; its keys are not null, and null keys of `big` match nothing."""
    payload = [c for c in keyed.columns if c != freq_col and c not in keys]
    total = keyed.agg(F.sum(freq_col)).scalar()
    hot = keyed.filter(F.col(freq_col) * F.lit(max_hot) >= total).select(*keys, *payload)
    cold = keyed.filter(F.col(freq_col) * F.lit(max_hot) < total).select(*keys, *payload)
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    rest = big.filter(known).join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    columns = [*big.columns, *payload]
    return big.join(F.broadcast(hot), keys).select(*columns).unionByName(rest.select(*columns))
