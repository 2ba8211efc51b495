"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.ship import ship_by_value
from logsieve.session import written as cut  # noqa: F401  the operators cut their plans with it

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Text handled at once inside a Python task; word lists of a chunk stay small.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct: operators carry it beside their own columns,
    so extra columns never clash with theirs.  `unwrap` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unwrap(df: DataFrame, row: str = "__row", **replaced: Column) -> DataFrame:
    """The columns of the struct; `replaced` gives new values for some of them."""
    fields = df.schema[row].dataType.names
    return df.select(*[replaced.get(c, F.col(row).getField(c)).alias(c) for c in fields])


def map_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str, *modules: str) -> DataFrame:
    """mapInArrow with the code of `modules` sent along with the task."""
    ship_by_value(__name__, *modules)
    return df.mapInArrow(fn, schema)


def chunks(texts: list[str], size_limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at least one text and at most about `size_limit` characters."""
    return sized(map(len, texts), size_limit)


def ranges(texts: pa.Array, size_limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """`chunks` of a column of strings, before they are Python objects; null counts as empty."""
    return sized(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), size_limit)


def sized(sizes: Iterable[int], size_limit: int) -> Iterator[tuple[int, int]]:
    start, size, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > start and size + n > size_limit:
            yield start, i
            start, size = i, 0
        size += n
    if start <= i:
        yield start, i + 1
