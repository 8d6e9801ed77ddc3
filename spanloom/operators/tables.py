"""Table idioms used by all operators."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packs import freeze_batches, pack_batches, part_ids, thaw_batches


def unfold(df: DataFrame, keep: Sequence[str | Column], array: str | Column, item: str, pos="ord") -> DataFrame:
    """One row per array element with its 0-based position.

    The outer form plus a filter on the position: the plain form makes Spark infer a
    ``size > 0`` filter and push it below, where a computed array is built once more."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def join_large(left: DataFrame, right: DataFrame, on: Sequence[str], how="inner") -> DataFrame:
    """Join of two tables that both grow with the data.

    Span tables are made by unfolding rows, which Spark's size estimate does not see: it
    may take such a table for a small one and broadcast it.  The merge hint rules that
    out; the join spills and AQE splits its skewed partitions."""
    return left.join(right.hint("merge"), list(on), how)


def fields_of(df: DataFrame, *cols: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def packed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Span rows (keys, values) -> one row per sentence and batch with the values as arrays.
    A sentence whose rows do not lie together gives several; none is lost."""
    keys = list(keys)
    rows = df.select(*keys, *[c for c in df.columns if c not in keys])
    lists = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in rows.schema[len(keys) :])
    return rows.mapInArrow(partial(pack_batches, key_count=len(keys)), f"{fields_of(rows, *keys)}, {lists}")


def placed_packs(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """All rows of a sentence in one task, for the kernels of ``functions.packs`` that open them.
    Compressed parts of many sentences are exchanged, neither span rows nor single packs; the
    hash of the key, modulo ``parts`` (default: the session's shuffle partitions), is the part."""
    keys = list(keys)
    ids = part_ids(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.hash(*keys).alias("__hash"), *keys, *[c for c in df.columns if c not in keys])
    frozen = rows.mapInArrow(partial(freeze_batches, key_count=len(keys), ids=ids), "__part int, __weight bigint, __rows binary")
    return frozen.repartition("__part").sortWithinPartitions("__part")


def placed_rows(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows, exchanged like that: those of a sentence side by side, keys first."""
    rows = df.select(*keys, *[c for c in df.columns if c not in keys])
    return placed_packs(rows, keys, parts).mapInArrow(partial(thaw_batches, key_count=len(keys), names=rows.columns), fields_of(rows, *rows.columns))


def placed_by(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the table lies in partitions by the hash of its key already, as stored span tables do."""
    placed = df._jdf.queryExecution().executedPlan().outputPartitioning().toString()
    found = re.fullmatch(r"hashpartitioning\((.*), \d+\)", placed)
    return bool(found) and re.sub(r"#\d+L?", "", found[1]).split(", ") == list(keys)
