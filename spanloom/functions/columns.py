"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once.  A higher-order function evaluates what its lambda
    captures once per element; a bound variable is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def indices(n: Column) -> Column:
    """``[0 .. n-1]``; empty for n = 0 (``sequence(0, -1)`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def pairs_of_neighbours(arr: Column, after_last: Column, body) -> Column:
    """``body(arr[i], arr[i+1])`` for every i, the last one paired with ``after_last``."""
    return F.zip_with(arr, F.array_append(F.slice(arr, 2, F.size(arr)), after_last), body)


def joined_text(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def hash60(*parts: Column) -> Column:
    """60 bits of md5 over the parts joined by ``:``; the same number in any engine."""
    return F.conv(F.substring(F.md5(joined_text(*parts)), 1, 15), 16, 10).cast("bigint")


def hash_bucket(*parts: Column, buckets: int = 100) -> Column:
    return (hash60(*parts) % F.lit(buckets)).cast("int")


def encode(names: Column, name: Column) -> Column:
    """Code of ``name`` in an array of names, null if it is not there."""
    pos = F.array_position(names, name)
    return F.when(pos > 0, (pos - 1).cast("int"))
