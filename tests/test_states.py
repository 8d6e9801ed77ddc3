"""Metric states, stored span tables, global positions and one-row negatives."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import clusters, membership, metrics, numbering, sampling, selection, states
from spanloom.sources import spantables

SCORED = "doc_id int, sent_ix int, s int, e int, label int, is_flat boolean"
GOLD = "doc_id int, sent_ix int, s int, e int, label int, ord int"


@pytest.fixture(scope="module")
def tables(spark):
    """Random scored clusters (one row a span) and gold spans with repeats and several types."""
    rng = random.Random(11)
    spans = [(d, i, s, e) for d in range(12) for i in range(3) for s in range(3) for e in range(s, 4)]
    scored = [(*x, rng.randrange(4), rng.random() < 0.6) for x in spans if rng.random() < 0.7]
    scored = [(*r[:5], r[5] and r[4] != 0) for r in scored]
    gold = [(*rng.choice(spans), rng.randrange(1, 4), k) for k in range(250)]
    return spark.createDataFrame(scored, SCORED), spark.createDataFrame(gold, GOLD)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_states_of_parts_add_up(spark, tables, tmp_path):
    scored, gold = tables
    part = lambda df, k: df.filter(F.col("doc_id") % 3 == k)
    count = lambda a, b: states.batch_state(a, b, F.col("is_flat"))
    whole = count(scored, gold)
    parts = [count(part(scored, k), part(gold, k)) for k in range(3)]
    assert rows(states.merge_states(*parts)) == rows(whole)
    assert rows(states.report_from_state(whole)) == rows(metrics.scored_report(scored, gold, F.col("is_flat")))
    predictions = scored.filter(F.col("is_flat") | (F.col("label") == 0))
    assert rows(states.confusion_from_state(whole)) == rows(metrics.confusion_pairs(gold, predictions))
    for k in (0, 1, 2, 1):  # the second time replaces the first
        states.save_state(parts[k], str(tmp_path), f"epoch-{k}")
    back = states.load_state(spark, str(tmp_path))
    assert rows(states.merge_states(back)) == rows(whole)
    assert rows(states.merge_states(back.filter("part = 'epoch-1'"))) == rows(parts[1])
    assert rows(states.merge_states(count(scored.limit(0), gold.limit(0)), whole)) == rows(whole)


def test_stored_tables_meet_without_exchange(spark, tables):
    scored, gold = tables
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    predicted = spantables.store_spans(scored, "scored")
    refs = spantables.store_spans(gold, "gold")
    report = metrics.stored_report(predicted, refs, F.col("is_flat"))
    assert "hashpartitioning(doc_id" not in plan(report) and "hashpartitioning(label" in plan(report)
    assert rows(report) == rows(metrics.scored_report(scored, gold, F.col("is_flat")))
    fresh = sampling.not_gold(refs, predicted.select("doc_id", "sent_ix", "s", "e"))
    assert "Exchange" not in plan(fresh)
    assert rows(fresh) == rows(sampling.not_gold(gold, scored.select("doc_id", "sent_ix", "s", "e")))
    assert spantables.store_spans(gold.limit(0), "none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_positions_in_many_ranges(spark, monkeypatch, n):
    monkeypatch.setattr(numbering, "RANGE_ROWS", 64)
    keys = [(None if i == 3 else i // 7 - 20, f"k{i % 7}") for i in range(n)]
    mixed = random.Random(n).sample(keys, n)
    df = spark.createDataFrame(mixed, "a int, b string").repartition(3)
    out = numbering.with_row_index(df, "a", "b", name="at")
    got = [(r.a, r.b) for r in sorted(out.collect(), key=lambda r: r.at)]
    assert got == sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert sorted(r.at for r in out.collect()) == list(range(n))
    if n == 1000:
        placed = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" not in placed  # read from the stored ranges


def test_negatives_from_the_row(spark):
    rows_ = [
        (1, 0, [1.0, 2.0], [(0, 1, 1), (0, 3, 2)]), (1, 1, [], [(0, 1, 3)]), (2, 0, [2.0, 2.0, 1.0], []),
        (3, 0, None, []), (4, 0, [1.0], [(0, 2, 1), (0, 2, 2)]),
    ]
    df = spark.createDataFrame(rows_, "doc_id int, sent_ix int, gaps array<double>, spans array<struct<start:int,end:int,label:int>>")
    got = rows(sampling.negative_spans_in_row(df))
    gold = sampling.positive_spans(df)
    assert got == rows(sampling.negative_spans(gold, clusters.cluster_set(df)))
    few = sampling.negative_spans_in_row(df, limit_samples=1).filter("label = 0")
    assert few.groupBy("doc_id", "sent_ix").count().filter("count > 1").count() == 0
    plan = sampling.negative_spans_in_row(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_membership_in_the_row(spark):
    """Equal to the joins of gold and cluster rows, without a row per cluster."""
    rng = random.Random(13)
    data = []
    for d in range(60):
        n = rng.choice([1, 2, 5, 12])
        spans = [(s, rng.randrange(s + 1, n + 1), rng.randrange(1, 4)) for s in (rng.randrange(n) for _ in range(rng.choice([0, 1, 6])))]
        data.append((d, 0, [float(rng.randrange(4)) for _ in range(n - 1)], spans + spans[:1], [f"t{rng.randrange(3)}" for _ in range(n)]))
    df = spark.createDataFrame(data, "doc_id int, sent_ix int, gaps array<double>, spans array<struct<start:int,end:int,label:int>>, tags array<string>")
    gold, found = sampling.positive_spans(df), clusters.cluster_set(df)
    cols = ["doc_id", "sent_ix", "ord", "s", "e", "label", "is_cluster"]
    hits = membership.gold_hits(df)
    assert rows(hits.select(cols)) == rows(selection.cluster_membership(gold, found).select(cols))
    recall = membership.potential_recall_of_hits
    assert rows(recall(hits)) == rows(metrics.potential_recall_listed(gold, found))
    assert rows(recall(membership.gold_hits(df, distinct=True), total=True)) == rows(metrics.potential_recall(gold, found))
    tags = df.select("doc_id", "sent_ix", F.posexplode("tags").alias("tok_ix", "tag"))
    assert rows(recall(membership.gold_hits(df, F.col("tags")))) == rows(metrics.potential_recall_tagged(gold, tags, found))
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([(1, 0, None, None, None)], df.schema)
    assert membership.gold_hits(empty).count() == 0


def test_tables_are_stored_from_packs(spark, monkeypatch):
    """The exchange of a stored table moves packs; rows, column order and null keys stay."""
    seen, plain = [], spantables.packed
    monkeypatch.setattr(spantables, "packed", lambda df, keys: seen.append(df.columns) or plain(df, keys))
    data = [("x", 1, 0, 2), (None, 1, 0, 2), ("x", None, 1, 1), ("y", 2, None, 3), ("x", 1, 0, 2)]
    df = spark.createDataFrame(data, "name string, doc_id int, sent_ix int, s int").repartition(3)
    back = spantables.store_spans(df, "mixed")
    assert back.columns == df.columns and rows(back) == rows(df) and seen == [df.columns]
