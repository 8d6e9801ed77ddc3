"""Gold spans among the clusters of their own sentence, without a row per cluster.

A sentence's clusters are one sorted array of span numbers beside its gold spans, so which
gold spans are clusters is an intersection of two arrays in the row.  Only gold spans are
unfolded, and only sums per label are exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import KEYS
from ..functions.columns import let
from .clusters import cluster_indices
from .metrics import _ratio
from .sampling import at_index, span_index
from .tables import unfold


def gold_hits(
    df: DataFrame, label: Column | None = None, distinct=False, gaps="gaps", spans="spans", keys=KEYS
) -> DataFrame:
    """One row per gold span: keys, ord, s, e, label, is_cluster.

    ``df`` has the sentence's ``gaps`` between words and its gold ``spans`` (end exclusive).
    ``label`` maps the first word's position to another label (an array column's name is given
    as ``F.col``); ``distinct`` counts equal spans with equal labels once, at their first
    place.  A sentence without gaps has its one word as cluster, one without spans no rows."""
    found = cluster_indices(F.coalesce(F.col(gaps), F.array().cast("array<double>")))
    rows = df.withColumn("__clusters", found)
    name = (lambda x: F.get(label, x["start"])) if label is not None else (lambda x: x["label"])

    def body(x: Column) -> Column:
        listed = F.transform(
            x["spans"], lambda sp: F.struct(span_index(sp["start"], sp["end"] - 1).alias("ix"), name(sp).alias("label"))
        )
        places = F.transform(x["spans"], lambda sp: span_index(sp["start"], sp["end"] - 1))
        hits = F.array_intersect(places, x["clusters"])
        return let(
            hits,
            lambda h: F.transform(
                F.array_distinct(listed) if distinct else listed,
                lambda g: F.struct(g["ix"].alias("ix"), g["label"].alias("label"), F.array_contains(h, g["ix"]).alias("hit")),
            ),
        )

    marked = let(F.struct(F.col(spans).alias("spans"), F.col("__clusters").alias("clusters")), body)
    out = unfold(rows, keys, marked, "__g").select(
        *keys, "ord", F.col("__g.ix").alias("__ix"), F.col("__g.label").alias("label"), F.col("__g.hit").alias("is_cluster")
    )
    return at_index(out, "__ix").select(*keys, "ord", "s", "e", "label", "is_cluster")


def potential_recall_of_hits(hits: DataFrame, total=False) -> DataFrame:
    """Share of gold spans that are clusters, per label, and overall (label null) if ``total``."""
    grouped = hits.rollup("label") if total else hits.groupBy("label")
    counts = grouped.agg(F.count("*").alias("n_gold"), F.count_if("is_cluster").alias("n_found"))
    return counts.withColumn("potential_recall", _ratio(F.col("n_found"), F.col("n_gold")))
