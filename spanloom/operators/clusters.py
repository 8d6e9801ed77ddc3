"""Candidate spans: single-linkage clustering of neighbouring words."""

from __future__ import annotations

import sys
from functools import partial

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import KEYS
from ..functions.columns import indices, let
from ..functions.scans import cluster_batches, cluster_places
from ..functions.packs import token_packs, word_packs
from .tables import fields_of, placed_packs

# the batch functions travel with the plan
register_pickle_by_value(sys.modules[__name__])


def gap_arrays(gaps: DataFrame, keys=KEYS, ix="ix", d="d") -> DataFrame:
    """Gap rows -> one ``gaps`` array per sentence (a sentence is one row by design)."""
    return gaps.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(ix, d))), lambda x: x[d]).alias("gaps")
    )


def chain_edges(df: DataFrame, word_ids="word_ids", keys=KEYS) -> DataFrame:
    """Neighbour pairs (i, j) of a sentence's words, both directions.  Pads are dropped
    and consecutive repeats of a word id (its subwords) count as one position."""
    words = let(
        F.filter(F.col(word_ids), lambda x: x >= 0),
        lambda w: F.size(
            F.filter(indices(F.size(w)), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        ),
    )
    pairs = F.transform(
        indices(words - 1),
        lambda i: F.array(
            F.struct(i.alias("i"), (i + 1).alias("j")), F.struct((i + 1).alias("i"), i.alias("j"))
        ),
    )
    return df.select(*keys, F.inline(F.flatten(pairs)))


def chain_clusters(df: DataFrame, gaps="gaps", keys=KEYS, singles=False, packs=False) -> DataFrame:
    """Every merge of the full single-linkage tree over the chain, as span rows, or with
    ``packs`` as arrays ``s, e`` in the row of their sentence.

    ``gaps`` holds the distances between neighbours (n - 1 of them).  One narrow pass
    over the sentence rows, n log n in the sentence; ``singles`` adds the words."""
    source = df.select(*keys, F.coalesce(F.col(gaps), F.array()).cast("array<double>").alias("gaps"))
    fields = [source.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(
        partial(cluster_batches, key_count=len(keys), singles=singles, packs=packs),
        f"{schema}, s array<int>, e array<int>" if packs else f"{schema}, s int, e int",
    )


def cluster_set(df: DataFrame, gaps="gaps", keys=KEYS, packs=False) -> DataFrame:
    """All merges plus every single word.  Merges span two words or more and each gap
    yields another interval, so the rows are distinct as they come."""
    return chain_clusters(df, gaps, keys, singles=True, packs=packs)


def cluster_indices(gaps: Column) -> Column:
    """The cluster set of a gap array as sorted places in the list of all spans by end, then
    start, ``e (e + 1) / 2 + s``: one array per sentence, for work within its row."""

    @F.arrow_udf("array<bigint>")
    def places(col: pa.Array) -> pa.Array:
        return cluster_places(col)

    return places(gaps)


def clusters_to_tokens(clusters: DataFrame, extents: DataFrame, keys=KEYS) -> DataFrame:
    """Word spans -> subword spans through the word extents (``word_id, first, last``).  Both
    meet as packs in their sentence."""
    others = [c for c in clusters.columns if c not in (*keys, "s", "e")]
    no = [F.lit(None).cast(clusters.schema[c].dataType).alias(c) for c in others]
    spans = clusters.select(*keys, "s", "e", F.lit(None).cast("int").alias("__last"), F.lit(False).alias("__word"), *others)
    words = extents.select(
        *keys, F.col("word_id").cast("int").alias("s"), F.col("first").alias("e"), F.col("last").alias("__last"), F.lit(True).alias("__word"), *no
    )
    scan = partial(token_packs, key_count=len(keys), names=["s", "e", *others])
    shape = f"{fields_of(clusters, *keys, 's', 'e', *others)}, tok_s int, tok_e int"
    return placed_packs(spans.unionByName(words), keys).mapInArrow(scan, shape)


def whole_word_clusters(token_spans: DataFrame, sentences: DataFrame, keys=KEYS) -> DataFrame:
    """Keep the token spans (``tok_s, tok_e``) that do not cut a word.

    A word is cut if it has a token inside the span and one outside.  With the words of
    a sentence in token order that can only happen at the two borders: the neighbour
    beyond a border must belong to another word.  Spans and word ids meet as packs in their
    sentence."""
    return beside_words(token_spans, sentences, keys, whole=True)


def beside_words(token_spans: DataFrame, sentences: DataFrame, keys, whole: bool) -> DataFrame:
    """Token spans beside the word ids of their sentence, as in an inner join on it.  Spans have an
    empty list of ids: the Arrow writer goes back over all rows of a batch for a null one."""
    spans = ["tok_s", "tok_e", *[c for c in token_spans.columns if c not in (*keys, "tok_s", "tok_e")]]
    none = [F.lit(None).cast(token_spans.schema[c].dataType).alias(c) for c in spans]
    empty = F.array().cast("array<int>")
    rows = token_spans.select(*keys, empty.alias("__w"), F.lit(False).alias("__ids"), *spans)
    ids = sentences.select(*keys, F.coalesce(F.col("word_ids").cast("array<int>"), empty).alias("__w"), F.lit(True).alias("__ids"), *none)
    scan = partial(word_packs, key_count=len(keys), names=spans, whole=whole)
    shape = fields_of(token_spans, *keys, *spans) + ("" if whole else ", s int, e int")
    opened = placed_packs(rows.unionByName(ids), keys).mapInArrow(scan, shape)
    return opened.select(*keys, *[c for c in token_spans.columns if c not in keys], *([] if whole else ["s", "e"]))


def neighbour_gaps(vectors: DataFrame, distance, keys=("sid",), ix="word_ix", v="v") -> DataFrame:
    """Distances between each vector and the next one of its sentence, as gap rows."""
    w = Window.partitionBy(*keys).orderBy(ix)
    step = vectors.select(
        *keys,
        (F.row_number().over(w) - 1).alias("ix"),
        F.col(v).alias("x"),
        F.lead(v).over(w).alias("y"),
    )
    return step.select(
        *keys,
        "ix",
        F.when(F.col("y").isNotNull(), F.round(distance(F.col("x"), F.col("y")), 9)).alias("d"),
    )


def vector_clusters(vectors: DataFrame, distance, keys=("sid",), ix="word_ix", v="v") -> DataFrame:
    """Cluster set of word vectors.  The last word's empty gap keeps one-word sentences."""
    gaps = gap_arrays(neighbour_gaps(vectors, distance, keys, ix, v), keys)
    present = gaps.withColumn("gaps", F.filter("gaps", lambda d: d.isNotNull()))
    return cluster_set(present, "gaps", keys)
