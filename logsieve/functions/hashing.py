"""Seeded, order-independent random draws.

A draw is a pure function of (seed, row key, draw name): the same row gets the same
value whatever the partitioning, the input order or a task retry, and DuckDB can
compute the same value (`('0x'||substr(md5(..),1,8))::BIGINT / 4294967296.0`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def h01(seed, *parts) -> Column:
    """Uniform double in [0, 1) from md5 of `seed:part1:part2...`."""
    key = F.concat_ws(":", *[_as_col(p).cast("string") for p in (seed, *parts)])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rand_int(h: Column, lo: int, hi: int) -> Column:
    """Integer in lo..hi (both ends) from a uniform draw."""
    return (F.lit(lo) + F.floor(h * F.lit(hi - lo + 1))).cast("bigint")


def rand_choice(h: Column, choices) -> Column:
    """One element of a literal list, picked by a uniform draw."""
    arr = F.array(*[F.lit(c) for c in choices])
    return F.get(arr, F.floor(h * F.lit(len(choices))).cast("int"))
