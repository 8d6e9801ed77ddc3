"""Span tables meet as packs: few rows are exchanged, and repeated or null keys keep their meaning."""

import random

from pyspark.sql import functions as F

from spanloom.operators import alignment, clusters, metrics, sampling, selection, states

SPAN = "doc_id int, sent_ix int, s int, e int"


def exchanged(df) -> int:
    """Joins, groupings and windows on (sentence, span) or rows per span would show here."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Window") + plan.count("Join") + plan.count("Aggregate")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clusters_to_tokens_and_words(spark):
    sents = spark.createDataFrame([(1, 0, [0, 0, 1, 2, 2, -1]), (2, 0, [0, 1, 1]), (3, 0, None)], "doc_id int, sent_ix int, word_ids array<int>")
    spans = spark.createDataFrame(
        [(1, 0, 0, 1, "x"), (2, 0, 1, 1, "y"), (1, 0, 2, 2, "z"), (1, 0, 2, 9, "no"), (None, 0, 0, 0, "no"), (1, 0, 0, 1, "x")], SPAN + ", label string"
    )
    found = clusters.clusters_to_tokens(spans, alignment.word_extents(sents))
    assert exchanged(found) == 0
    assert rows(found) == [
        (1, 0, 0, 1, "x", 0, 2), (1, 0, 0, 1, "x", 0, 2), (1, 0, 2, 2, "z", 3, 4), (2, 0, 1, 1, "y", 1, 2)
    ]
    tokens = found.select("doc_id", "sent_ix", "tok_s", "tok_e", "label")
    words = selection.word_assignments(tokens, sents)
    assert rows(words) == [(1, 0, 0, 2, "x", 0, 1), (1, 0, 0, 2, "x", 0, 1), (1, 0, 3, 4, "z", 2, 2), (2, 0, 1, 2, "y", 1, 1)]
    cut = tokens.withColumn("tok_e", F.col("tok_e") - F.when(F.col("label") == "z", 1).otherwise(0))
    assert {r.label for r in clusters.whole_word_clusters(cut, sents).collect()} == {"x", "y"}


def test_not_gold_and_limit(spark):
    gold = spark.createDataFrame([(1, 0, 0, 1), (None, 0, 0, 0)], SPAN)
    found = spark.createDataFrame([(1, 0, 3, 3), (1, 0, 0, 1), (1, 0, 2, 2), (1, 0, 1, 2), (2, 0, 0, 1), (None, 0, 0, 0)], SPAN)
    fresh = sampling.not_gold(gold, found)
    assert exchanged(fresh) == 0
    assert rows(fresh) == [(1, 0, 1, 2), (1, 0, 2, 2), (1, 0, 3, 3), (2, 0, 0, 1), (None, 0, 0, 0)]
    assert rows(sampling.limit_negatives(fresh, 2)) == [(1, 0, 1, 2), (1, 0, 2, 2), (2, 0, 0, 1), (None, 0, 0, 0)]


def test_last_gold_labels_and_report(spark):
    gold = spark.createDataFrame([(1, 0, 0, 1, 2, 0), (1, 0, 0, 1, 1, 1), (1, 0, 5, 5, 1, 2)], SPAN + ", label int, ord int")
    spans = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 0), (2, 0, 0, 1)], SPAN)
    labelled = metrics.last_gold_labels(spans, gold)
    assert exchanged(labelled) == 0
    assert rows(labelled) == [(1, 0, 0, 0, None), (1, 0, 0, 1, 1), (2, 0, 0, 1, None)]
    scored = spans.withColumn("label", F.lit(1)).withColumn("confidence", F.col("s") + 0.5)
    flags = selection.flat_flags(scored)
    assert exchanged(flags) == 0
    assert {(r.doc_id, r.s, r.e): r.is_flat for r in flags.collect()} == {(1, 0, 1): True, (1, 0, 0): False, (2, 0, 1): True}
    report = {r.label: (r.tp, r.fp, r.fn) for r in metrics.scored_report(flags, gold, F.col("is_flat")).collect()}
    assert report == {1: (1, 1, 1), 2: (0, 0, 1), None: (1, 1, 2)}


def test_softmax_has_no_lambda(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, None],), (None,)], "logits array<double>")
    out = selection.softmax_probs(df)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.probs for r in out.collect()] == [[0.5, 0.5], [None, None], None]


def test_flat_choice_is_counted_where_it_is_made(spark):
    """Report and state of the flat choice equal those of its rows, from one exchange by sentence."""
    rng = random.Random(4)
    key = lambda: (rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1]))
    span = lambda: (s := rng.randrange(6), s + rng.randrange(4))
    pred = [(*key(), *span(), rng.choice([0, 1, 2, 3]), rng.choice([0.25, 0.5, 0.75])) for _ in range(300)]
    refs = [(*key(), *span(), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(9)])) for _ in range(150)]
    scored = spark.createDataFrame(pred, "doc_id int, sent_ix int, s int, e int, label int, confidence double").repartition(5)
    gold = spark.createDataFrame(refs, "doc_id int, sent_ix int, s int, e int, label int, ord int").repartition(3)
    flags = selection.flat_flags(scored)
    report = metrics.flat_report(scored, gold)
    assert rows(report) == rows(metrics.scored_report(flags, gold, F.col("is_flat")))
    assert rows(states.flat_state(scored, gold)) == rows(states.batch_state(flags, gold, F.col("is_flat")))
    assert report._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert states.flat_state(scored.limit(0), gold.limit(0)).count() == 0


def test_cooccurrence_meets_as_packs(spark):
    """Equal to the join of equal spans and the label sets of a sentence, without a join."""
    rng = random.Random(5)
    spans = lambda n: [(rng.choice([None, 1, 2]), rng.choice([0, 1]), rng.randrange(3), rng.randrange(3, 5), rng.choice([None, 1, 2, 3])) for _ in range(n)]
    left, right = spans(60), spans(90)
    shape = "doc_id int, sent_ix int, s int, e int, label int"
    out = metrics.confusion_cooccur(spark.createDataFrame(left, shape).repartition(3), spark.createDataFrame(right, shape).repartition(4))
    want = {}
    for g in left:
        for p in right:
            if g[0] is not None and g[:4] == p[:4]:
                want[g[4], p[4]] = want.get((g[4], p[4]), 0) + 1
            if g[:2] == p[:2] and None not in (g[4], p[4]):
                want.setdefault((g[4], p[4]), 0)
    assert {(r.gold, r.pred): r.n for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_filters_exchange_packs(spark):
    gold = [(1, 0, 2, 3), (1, 0, 2, 3), (None, 0, 1, 1), (2, 0, 0, None)]
    cand = [(1, 0, 2, 3), (1, 0, 2, 3), (1, 0, 1, 4), (1, 0, 3, 3), (1, 0, None, 5), (1, 0, 3, None), (None, 0, 1, 1), (None, 0, 0, 0), (2, 0, 0, 5), (3, 0, 0, 9)]
    g, c = spark.createDataFrame(gold, SPAN), spark.createDataFrame(cand, SPAN)
    chunk, flat = sampling.filter_chunk(g, c), sampling.filter_flat(g, c)
    assert exchanged(chunk) == exchanged(flat) == 0
    always = [(1, 0, 3, None), (2, 0, 0, 5), (2, 0, 0, None), (3, 0, 0, 9), (None, 0, 0, 0)]
    assert rows(chunk) == sorted([(1, 0, 3, 3), *always], key=str)
    assert rows(flat) == sorted([(1, 0, 1, 4), (1, 0, None, 5), *always], key=str)
    # several packs of a sentence, and empty ones, say the same
    lists = "doc_id int, sent_ix int, s array<int>, e array<int>"
    in_packs = lambda spans: spark.createDataFrame([(d, i, [s], [e]) for d, i, s, e in spans] + [(1, 0, [], []), (9, 0, [], [])], lists)
    for found, one in ((chunk, sampling.filter_chunk), (flat, sampling.filter_flat)):
        assert rows(one(in_packs(gold), in_packs(cand), packs=True)) == rows(found)


def test_cluster_packs_are_the_cluster_rows(spark):
    df = spark.createDataFrame([(1, 0, [2.0, 1.0, 1.0]), (2, 0, []), (2, 1, None), (1, 0, [3.0, 3.0])], "doc_id int, sent_ix int, gaps array<double>")
    packs = clusters.cluster_set(df, packs=True)
    assert packs.count() == df.count()
    opened = packs.select("doc_id", "sent_ix", F.inline(F.arrays_zip("s", "e")))
    assert rows(opened) == rows(clusters.cluster_set(df))
