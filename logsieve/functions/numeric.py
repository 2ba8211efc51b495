"""Array arithmetic: cross entropy and argmax over logits arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cross_entropy(logits: Column, label: Column) -> Column:
    """logsumexp(x) - x[label] (label 0-based), computed around max(x) for stability."""
    x = logits.cast("array<double>")
    m = F.array_max(x)
    s = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))
    return m + F.log(s) - F.get(x, label.cast("int"))


def argmax(arr: Column) -> Column:
    """0-based index of the largest element; the first one on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
