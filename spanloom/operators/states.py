"""Metric state that merges: counts of a batch, an epoch or a partition of the corpus, added up
later to the report of the whole.

A state is a small table (kind, gold, pred, n).  Per label: ``tp``, ``fp``, ``fn``, distinct
gold spans (``gold``) and those among the clusters (``found``); per label pair: ``pair``.
Sums of disjoint parts are the sums of the whole, so parts may be counted where and when
they are made and stored side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import KEYS
from ..functions.packs import CLUSTER, GOLD, NAMED, PRED, state_packs
from .metrics import flat_packs_beside_gold, report_of
from .tables import placed_packs

STATE = "kind string, gold int, pred int, n bigint"


def batch_state(scored: DataFrame, gold: DataFrame, chosen: Column, keys: Sequence[str] = KEYS, order="ord") -> DataFrame:
    """The state of some sentences: all their scored clusters (keys, s, e, label), of which
    those where ``chosen`` holds are the predictions, and their gold spans with a place
    ``order`` in the list.  Rows labelled O count as O in the label pairs.

    One exchange, of packs by sentence: counting per label and what concerns the whole span
    (is it a cluster, its last gold label, is anything predicted) run where they arrive."""
    named = chosen | (F.col("label") == 0)
    bits = F.lit(CLUSTER) + F.when(chosen, PRED).otherwise(0) + F.when(named, NAMED).otherwise(0)
    row = lambda label, f, at: [*keys, "s", "e", label.cast("int").alias("label"), f.cast("tinyint").alias("f"), at.cast("bigint").alias("ord")]
    found = scored.select(*row(F.when(named, F.col("label")), bits, F.lit(None)))
    refs = gold.select(*row(F.col("label"), F.lit(GOLD), F.col(order)))
    packs = placed_packs(found.unionByName(refs), keys)
    return _added(packs.mapInArrow(partial(state_packs, key_count=len(keys)), STATE))


def flat_state(scored: DataFrame, gold: DataFrame, keys: Sequence[str] = KEYS, order="ord") -> DataFrame:
    """The same of the flat choice among the scored clusters (keys, s, e, label, confidence), as
    ``selection.flat_flags`` makes it, in the one exchange of ``metrics.flat_report``."""
    packs = flat_packs_beside_gold(scored, gold, keys, F.col(order).cast("bigint"))
    return _added(packs.mapInArrow(partial(state_packs, key_count=len(keys), flat=True), STATE))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "gold", "pred").agg(F.sum("n").alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all parts together; the parts must not share a sentence."""
    return _added(reduce(DataFrame.unionByName, (s.select("kind", "gold", "pred", "n") for s in states)))


def save_state(state: DataFrame, path: str, part: str) -> None:
    """Store the state of one part (a batch, a shard, an epoch) under ``path``.  Stored again,
    the part is replaced, so a repeated batch does not count twice."""
    state.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """All parts under ``path`` (``kind, gold, pred, n, part``), to be filtered and merged."""
    return spark.read.schema(f"{STATE}, part string").parquet(path)


def report_from_state(state: DataFrame) -> DataFrame:
    """Precision, recall, F1 and potential recall per label and overall (label null)."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    names = {"tp": "tp", "fp": "fp", "fn": "fn", "gold": "n_gold", "found": "n_found"}
    labels = state.filter("kind <> 'pair'").groupBy(F.col("gold").alias("label"))
    return report_of(labels.agg(*(n(kind).alias(name) for kind, name in names.items())))


def confusion_from_state(state: DataFrame) -> DataFrame:
    """(gold, pred) label counts; unmatched predictions pair with gold O, unmatched gold with
    predicted O."""
    return state.filter("kind = 'pair'").groupBy("gold", "pred").agg(F.sum("n").alias("n"))
