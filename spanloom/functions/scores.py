"""Logits, probabilities and losses of one span."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# the batch functions travel with the plan
register_pickle_by_value(sys.modules[__name__])


def _shifted(col: pa.Array) -> tuple[np.ndarray, ...]:
    """Lengths, exp(x - max) of all values, their sums per non-empty row, and which rows are those."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
    some = lengths > 0
    x = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
    if not len(x):
        return lengths, x, x, some
    at = (np.cumsum(lengths) - lengths)[some]
    with np.errstate(all="ignore"):
        power = np.exp(x - np.repeat(np.maximum.reduceat(x, at), lengths[some]))
        return lengths, power, np.add.reduceat(power, at), some


def _null_rows(col: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Rows with a null among their values."""
    nulls = np.asarray(col.flatten().is_null().to_numpy(zero_copy_only=False))
    return np.bincount(np.repeat(np.arange(len(lengths)), lengths)[nulls], minlength=len(lengths)) > 0


def batch_softmax(col: pa.Array) -> pa.Array:
    lengths, power, sums, some = _shifted(col)
    null = np.repeat(_null_rows(col, lengths), lengths)
    values = pa.array(power / np.repeat(sums, lengths[some]), mask=null)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=col.is_null())


def batch_top(col: pa.Array) -> pa.Array:
    lengths, _, sums, some = _shifted(col)
    out = np.zeros(len(lengths))
    out[some] = 1.0 / sums
    return pa.array(out, mask=~some | _null_rows(col, lengths))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _exp_sum(logits: Column, top: Column) -> Column:
    return F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))


def softmax(logits: Column) -> Column:
    """Probabilities per type, shifted by the largest logit; null where a logit is null."""


    @F.arrow_udf("array<double>")
    def probabilities(col: pa.Array) -> pa.Array:
        return batch_softmax(col)

    return probabilities(logits.cast("array<double>"))


def argmax(logits: Column) -> Column:
    """Lowest index of the largest value.  No lambda: it compiles into the stage, and a
    filter on it that is pushed down costs next to nothing."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def top_probability(logits: Column) -> Column:
    """Softmax value at the argmax: 1 / sum(exp(x - max))."""

    @F.arrow_udf("double")
    def top(col: pa.Array) -> pa.Array:
        return batch_top(col)

    return top(logits.cast("array<double>"))


def neg_log_softmax(logits: Column, label: Column) -> Column:
    return let(
        F.array_max(logits), lambda m: F.log(_exp_sum(logits, m)) + m
    ) - F.get(logits, label)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda a: a * a)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def cosine(x: Column, y: Column) -> Column:
    """1 - x.y/|x||y|; a zero vector counts as distance 1."""
    dot = _sum(F.zip_with(x, y, lambda a, b: a * b))
    return F.lit(1.0) - F.coalesce(F.try_divide(dot, norm(x) * norm(y)), F.lit(0.0))


DISTANCES = {"euclidean": euclidean, "cosine": cosine}
