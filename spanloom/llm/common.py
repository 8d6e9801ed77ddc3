"""Words, text keys and written tables that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Words, and the white space between them.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PART_BYTES = 1 << 22  # of a batch, that a worker holds as Python values at once


def text_of(col: str | Column) -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column) -> Column:
    """Words of a text that is not null; an empty array if it has none."""
    return F.array_remove(F.split(text, GAP), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back.

    Cuts the lineage for steps that must not see an input twice in different forms, and
    survives lost executors.  The folder is a fresh one under ``spark.checkpoint.dir``."""
    spark: SparkSession = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(batch: pa.RecordBatch, using: Sequence[str], size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts whose columns ``using`` have about ``size`` bytes."""
    held = sum(batch.column(batch.schema.get_field_index(c)).nbytes for c in using)
    step = max(1, batch.num_rows * size // max(held, size))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def appended(
    df: DataFrame, kept: Sequence[str], using: Sequence[str], fields: dict[str, tuple[str, pa.DataType]],
    start: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """``df[kept]`` and the columns ``fields`` (name: Spark and Arrow type), made per batch.

    ``start`` is called once a task and gives a function from the values of ``using`` to one
    sequence per field.  The kept columns pass as they are, so null or large keys stay exact.
    A batch of long values is worked off in parts of about ``PART_BYTES``, in its order, so
    that a worker holds one part's values and results, not a batch's."""
    kept, using = list(kept), list(using)
    types = {name: arrow for name, (_, arrow) in fields.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in batches:
            if not b.num_rows:
                continue
            for part in parted(b, using):
                column = lambda c: part.column(part.schema.get_field_index(c))
                made = make(*(column(c).to_pylist() for c in using))
                arrays = [column(c) for c in kept] + [pa.array(v, t) for v, t in zip(made, types.values())]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *types])

    shape = df.select(*kept, *(F.lit(None).cast(t).alias(name) for name, (t, _) in fields.items())).schema
    return df.select(*dict.fromkeys([*kept, *using])).mapInArrow(run, shape)


def running_base(totals: DataFrame, key: str, value: str, by: tuple[str, ...] = (), fan: int = 1024) -> DataFrame:
    """``by``, ``key``, ``base``: the sum of ``value`` over smaller keys (``key`` is a long
    that counts from 0 without large holes, one row per key).

    Two levels, so that a window sees ``fan`` rows, or one row per ``fan`` keys."""
    from pyspark.sql import Window

    by = list(by)
    rows = totals.withColumn("__top", F.floor(F.col(key) / fan).cast("long"))
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, "__top").agg(F.sum(value).alias("__sum"))
    tops = tops.select(
        *by, "__top", F.coalesce(F.sum("__sum").over(before(*by).orderBy("__top")), F.lit(0)).alias("__from")
    )
    inner = before(*by, "__top").orderBy(key)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(tops, [*by, "__top"]).select(*by, key, (F.col("__in") + F.col("__from")).alias("base"))
