"""Potential recall of the same clustering over several vector sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import DISTANCES
from .clusters import clusters_to_tokens, vector_clusters
from .tables import join_large
from .vectors import pool_words


def source_comparison(
    sources: dict[str, DataFrame], gold: DataFrame, extents: DataFrame, metric="euclidean"
) -> DataFrame:
    """One plan for all sources: a ``source`` column runs through pooling, clustering and
    counting.  Rows per (source, label) and, with label null, per source.

    ``sources``: token vectors (sid, word_ix, v).  ``gold``: token spans (sid, s, e,
    label).  ``extents``: first and last token per (sid, word_id)."""
    tokens = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(n).alias("source"), "sid", "word_ix", "v") for n, df in sources.items()],
    )
    keys = ("source", "sid")
    words = pool_words(tokens, keys)
    clusters = vector_clusters(words, DISTANCES[metric], keys)
    names = F.array(*[F.lit(n) for n in sources])

    def each_source(df: DataFrame) -> DataFrame:
        return df.withColumn("source", F.explode(names))

    spans = clusters_to_tokens(clusters, each_source(extents), keys).select(
        *keys, F.col("tok_s").alias("s"), F.col("tok_e").alias("e"), F.lit(1).alias("hit")
    )
    refs = each_source(gold.select("sid", "s", "e", "label").distinct())
    found = join_large(refs, spans, [*keys, "s", "e"], "left")
    return (
        found.groupingSets([["source", "label"], ["source"]], "source", "label")
        .agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_found"))
        .withColumn("potential_recall", F.col("n_found") / F.col("n_gold"))
    )
