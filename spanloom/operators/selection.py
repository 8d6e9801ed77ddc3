"""From logits to assigned, flat and word-level spans."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import KEYS
from ..functions import scores
from ..functions.packs import flat_packs, parent_packs
from .clusters import beside_words
from .tables import fields_of, join_large, placed_packs

OUTSIDE = 0


def softmax_probs(df: DataFrame, logits="logits") -> DataFrame:
    return df.withColumn("probs", scores.softmax(F.col(logits)))


def assign_types(df: DataFrame, logits="logits") -> DataFrame:
    """Label (argmax) and confidence (its probability) per span; label 0 means no entity."""
    return df.withColumns(
        {
            "label": scores.argmax(F.col(logits)),
            "confidence": scores.top_probability(F.col(logits)),
        }
    )


def assignments(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("label") != OUTSIDE)


def _ranked(scored: DataFrame, keys, flag: bool) -> DataFrame:
    """The greedy choice over packs: a sentence's spans are exchanged as arrays, ranked and
    scanned where they arrive."""
    rows = scored.select(*keys, "s", "e", "label", "confidence")
    shape = fields_of(rows, *rows.columns) + (", is_flat boolean" if flag else "")
    return placed_packs(rows, keys).mapInArrow(partial(flat_packs, key_count=len(keys), flag=flag), shape)


def flat_select(scored: DataFrame, keys=KEYS) -> DataFrame:
    """Greedy choice per sentence by confidence, then length, then start: a span stays
    unless it contains, or lies in, a span that stays.  Crossing spans both stay.

    The rows of a sentence are ranked and scanned together, best first by confidence, length,
    start."""
    return _ranked(assignments(scored), keys, False)


def flat_flags(scored: DataFrame, keys=KEYS) -> DataFrame:
    """All scored spans with ``is_flat``: the same choice where the other spans are needed
    too, so that candidates are made and exchanged once."""
    return _ranked(scored, keys, True)


def all_predictions(scored: DataFrame, keys=KEYS) -> DataFrame:
    """Flat assignments plus the spans labelled O; assigned spans that lost are absent."""
    return (
        flat_flags(scored, keys)
        .filter(F.col("is_flat") | (F.col("label") == OUTSIDE))
        .select(*keys, "s", "e", "label")
    )


def word_assignments(token_spans: DataFrame, sentences: DataFrame, keys=KEYS) -> DataFrame:
    """Token spans (``tok_s, tok_e``) -> word spans.  Spans and word ids meet as packs in their
    sentence."""
    return beside_words(token_spans, sentences, keys, whole=False)


def cluster_membership(gold: DataFrame, clusters: DataFrame, keys=KEYS) -> DataFrame:
    """Flag the gold spans that are clusters.  ``clusters`` must be distinct."""
    flag = clusters.select(*keys, "s", "e", F.lit(True).alias("is_cluster"))
    return join_large(gold, flag, [*keys, "s", "e"], "left").withColumn(
        "is_cluster", F.coalesce("is_cluster", F.lit(False))
    )


def span_confidence(spans: DataFrame, scored: DataFrame, keys=KEYS) -> DataFrame:
    """Confidence of each span, 0 where it is no assignment."""
    conf = assignments(scored).select(*keys, "s", "e", "confidence")
    return join_large(spans, conf, [*keys, "s", "e"], "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.0))
    )


def span_tree(scored: DataFrame, words: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """Hierarchy of assignments, O spans, single words and the root: every node with its
    parent, the shortest span that strictly contains it (of equal ones the later).

    A full cluster set holds each word and the root already.  Where ``scored`` does not,
    ``words`` gives the word spans (keys, s, e), and they and the root between them are
    added as O nodes.  Equal spans become one node, an entity before an O."""
    entity = F.col("label") != OUTSIDE
    confidence = F.when(entity, F.col("confidence")).otherwise(0.0).alias("confidence")
    nodes = scored.select(*keys, "s", "e", "label", confidence)
    if words is not None:
        plain = [F.lit(OUTSIDE).alias("label"), F.lit(0.0).alias("confidence")]
        root = words.groupBy(*keys).agg(F.min("s").alias("s"), F.max("e").alias("e"))
        for extra in (words, root):
            nodes = nodes.unionByName(extra.select(*keys, "s", "e", *plain))
    shape = f"{fields_of(nodes, *nodes.columns)}, parent_s int, parent_e int"
    return placed_packs(nodes, keys).mapInArrow(partial(parent_packs, key_count=len(keys)), shape)
