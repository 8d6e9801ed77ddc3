"""Tag sequences to spans, tag names to type names."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import indices, let, pairs_of_neighbours
from .scans import tag_lists

# the batch functions travel with the plan
register_pickle_by_value(sys.modules[__name__])

# Tag prefixes of the IOB scheme and the pattern of a type tag.
BEGIN, INSIDE = "B-", "I-"
TYPE_TAG = r"^[BI]-(.*)"


def iob_spans(tags: Column) -> Column:
    """``array<string>`` of tags -> ``array<struct<start,end,label>>``, end exclusive.

    A span ends at the next boundary, and a boundary is any position that is not an
    inside tag, or an inside tag with no open span before it.  So: list the
    boundaries, pair each with the next one, keep those that open a span.  Linear in
    the sentence, no window, no shuffle.
    """

    def inside(tag: Column) -> Column:
        return F.coalesce(tag.startswith(INSIDE), F.lit(False))

    def outside(tag: Column) -> Column:
        return ~(inside(tag) | F.coalesce(tag.startswith(BEGIN), F.lit(False)))

    def spans(t: Column) -> Column:
        boundaries = F.filter(
            indices(F.size(t)),
            lambda i: ~inside(F.get(t, i)) | (i == 0) | outside(F.get(t, i - 1)),
        )
        paired = let(
            boundaries,
            lambda b: pairs_of_neighbours(
                b,
                F.size(t),
                lambda lo, hi: F.struct(
                    lo.alias("start"), hi.alias("end"), F.get(t, lo).alias("tag")
                ),
            ),
        )
        return F.transform(
            F.filter(paired, lambda x: ~outside(x["tag"])),
            lambda x: F.struct(
                x["start"].alias("start"),
                x["end"].alias("end"),
                F.substr(x["tag"], F.lit(3)).alias("label"),
            ),
        )

    return let(tags, spans)


def iob_span_lists(tags: Column) -> Column:
    """``iob_spans`` in numpy over a batch of sentences: cheaper per tag, but a Python function,
    so it may not stand inside a higher-order function."""

    @F.arrow_udf("array<struct<start: int, end: int, label: string>>")
    def spans(col: pa.Array) -> pa.Array:
        return tag_lists(col)

    return spans(tags)


def type_name(tag: Column) -> Column:
    """``B-X`` / ``I-X`` -> ``X``; other names stay as they are."""
    return F.when(tag.rlike(TYPE_TAG), F.regexp_extract(tag, TYPE_TAG, 1)).otherwise(tag)
