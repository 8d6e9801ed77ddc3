import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.scores import DISTANCES
from spanloom.operators import ablation, alignment, clusters, training, vectors

from .plain import merges

TOK = "sid int, tok_ix int, word_ix int, v array<double>"


def test_pool_and_layers(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, [1.0, 2.0]), (1, 1, 0, [3.0, 4.0]), (1, 2, 1, [5.0, 6.0]), (1, 3, -1, [9.0, 9.0])], TOK
    )
    assert {r.word_ix: r.v for r in vectors.pool_words(df).collect()} == {0: [2.0, 3.0], 1: [5.0, 6.0]}
    layers = spark.createDataFrame([(1, 0, 1, [3.0]), (1, 0, 0, [1.0, 2.0])], "sid int, tok_ix int, layer int, v array<double>")
    assert vectors.concat_layers(layers).first()["v"] == [1.0, 2.0, 3.0]


def test_linear_head(spark):
    rng = np.random.default_rng(1)
    w1, b1, w2, b2 = rng.normal(size=(5, 4)), rng.normal(size=5), rng.normal(size=(3, 5)), rng.normal(size=3)
    cells = [
        (layer, r, c, float(x))
        for layer, (w, b) in enumerate([(w1, b1), (w2, b2)])
        for r, row in enumerate(np.column_stack([w, b]))
        for c, x in enumerate(row)
    ]
    weights = spark.createDataFrame(cells, "layer int, r int, c int, x double")
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(x)], "k int, features array<double>")
    got = vectors.score_spans(df, vectors.load_layer(weights, 0), vectors.load_layer(weights, 1)).orderBy("k")
    expected = np.maximum(x @ w1.T + b1, 0) @ w2.T + b2
    assert np.allclose([r.logits for r in got.collect()], expected)
    with pytest.raises(ValueError, match="no weights"):
        vectors.load_layer(weights, 7)


def test_distances(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [3.0, 4.0]), (1, 2, [6.0, 8.0])], "sid int, word_ix int, v array<double>")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "sid int, i int, j int")
    d = lambda m: {(r.i, r.j): r.d for r in vectors.pairwise_distance(df, pairs, m).collect()}
    assert d("euclidean") == {(0, 1): 5.0, (1, 2): 5.0}
    cos = d("cosine")
    assert cos[(0, 1)] == 1.0 and math.isclose(cos[(1, 2)], 0.0, abs_tol=1e-12)


def _cohesion(rows, examples, metric):
    """Dense square per example, as batches of one size."""
    def dist(x, y):
        if metric == "euclidean":
            return math.dist(x, y)
        nx, ny = math.hypot(*x), math.hypot(*y)
        return 1 - (sum(a * b for a, b in zip(x, y)) / (nx * ny) if nx and ny else 0)

    out = {}
    for batch in {b for b, *_ in examples}:
        mine = [x for x in examples if x[0] == batch]
        far = max(dist(p, q) for _, sid, *_ in mine for p in rows[sid] for q in rows[sid])
        ratios = []
        for _, sid, s, e in mine:
            vs, inside = rows[sid], (lambda i: s is not None and s <= i <= e)
            n = range(len(vs))
            inner = max([dist(vs[i], vs[j]) for i in n for j in n if inside(i) and inside(j)], default=0)
            across = min([dist(vs[i], vs[j]) for i in n for j in n if inside(i) and not inside(j)], default=far)
            ratios.append((inner + 1) / (across + 1))
        out[batch] = sum(ratios) / len(ratios) if any(s is not None for *_, s, _ in mine) else None
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("block", [256, 3])
def test_cohesion(spark, metric, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = {sid: [list(map(float, rng.normal(size=3))) for _ in range(n)] for sid, n in enumerate([8, 7, 1, 5])}
    examples = [(0, 0, 2, 4), (0, 1, 0, 6), (0, 0, 2, 4), (1, 2, 0, 0), (1, 3, None, None), (2, 3, None, None)]
    vec = spark.createDataFrame([(s, i, v) for s, vs in rows.items() for i, v in enumerate(vs)], "sid int, tok_ix int, v array<double>")
    ex = spark.createDataFrame(examples, "batch_id int, sid int, s int, e int")
    got = {r.batch_id: r.loss for r in vectors.cohesion_ratio(ex, vec, metric).collect()}
    expected = _cohesion(rows, examples, metric)
    assert got.keys() == expected.keys()
    for k, x in expected.items():
        assert (got[k] is None) == (x is None) and (x is None or math.isclose(got[k], x, rel_tol=1e-9))
    labelled = ex.withColumn("label", F.when(F.col("batch_id") == 0, 1).otherwise(0))
    only = {r.batch_id: r.loss for r in vectors.cohesion_entities_only(labelled, vec, metric).collect()}
    assert only[1] is None and only[2] is None and math.isclose(only[0], expected[0], rel_tol=1e-9)


def test_vector_clusters_and_sources(spark):
    rng = np.random.default_rng(3)
    toks = [(sid, t, t // 2, list(map(float, rng.normal(size=4)))) for sid in range(5) for t in range(2 * (sid + 1))]
    df = spark.createDataFrame(toks, TOK)
    words = vectors.pool_words(df)
    got = {}
    for r in clusters.vector_clusters(words, DISTANCES["euclidean"]).collect():
        got.setdefault(r.sid, []).append((r.s, r.e))
    pooled = {}
    for r in words.orderBy("sid", "word_ix").collect():
        pooled.setdefault(r.sid, []).append(r.v)
    for sid, vs in pooled.items():
        gaps = [round(math.dist(a, b), 9) for a, b in zip(vs, vs[1:])]
        assert sorted(got[sid]) == sorted(merges(gaps) + [(i, i) for i in range(len(vs))])
    gold = spark.createDataFrame([(4, 0, 9, 1), (4, 0, 1, 2), (4, 1, 2, 2)], "sid int, s int, e int, label int")
    ids = df.groupBy("sid").agg(F.sort_array(F.collect_list("word_ix")).alias("word_ids"))
    out = ablation.source_comparison({"a": df, "b": df}, gold, alignment.word_extents(ids, keys=("sid",)))
    rows = {(r.source, r.label): (r.n_gold, r.n_found) for r in out.collect()}
    assert rows[("a", 1)] == (1, 1) and rows[("b", 2)] == (2, 1) and rows[("a", None)] == (3, 2)


def test_features_and_training(spark):
    vec = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(6)], "sid int, tok_ix int, v array<double>")
    spans = spark.createDataFrame([(1, 0, 1), (1, 2, 3), (1, 3, 5)], "sid int, s int, e int")
    got = {(r.s, r.e): r.features for r in vectors.span_features(spans, vec).collect()}
    assert got == {(0, 1): [0.0, 1.0, 1.0, 1.0], (2, 3): [2.0, 1.0, 3.0, 1.0], (3, 5): [3.0, 1.0, 5.0, 1.0]}
    marked = spark.createDataFrame(
        [(1, s, e, i, [float(10 * s + i)]) for s, e in ((0, 1), (2, 3), (3, 5)) for i in range(8)],
        "sid int, s int, e int, tok_ix int, v array<double>",
    )
    got = {(r.s, r.e): r.features for r in vectors.marked_span_features(spans, marked).collect()}
    assert got == {(0, 1): [0.0, 3.0], (2, 3): [22.0, 25.0], (3, 5): [33.0, 37.0]}
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(size=3) + 4 * (np.arange(3) == i % 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, label int, features array<double>")
    head = training.fit_span_classifier(df.filter("k < 200"), df.filter("k >= 200"), "Oab", hidden=8, rate=0.05, epochs=6, steps=2)
    scored = training.predict_types(head, df.filter("k >= 200"))
    assert head.f1 > 0.9 and scored.filter("label = predicted").count() > 90
    assert (head.f1, -min(h[1] for h in head.history if h[2] == head.f1)) == (head.history[head.epoch][2], -head.history[head.epoch][1])


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_cohesion_leaves_hopeless_blocks_out(spark, metric, monkeypatch):
    """Distant tight groups of tokens: the same ratios from a part of the block pairs."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rng = np.random.default_rng(7)
    centres = 20 * rng.normal(size=(12, 3))
    rows = {0: [list(map(float, centres[i // 4] + 0.1 * rng.normal(size=3))) for i in range(48)]}
    rows[1] = [*rows[0][:10], [0.0, 0.0, 0.0], *rows[0][11:]]
    examples = [(sid, sid, s, e) for sid in (0, 1) for s, e in ((0, 3), (5, 22), (0, 47), (46, 46))]
    vec = spark.createDataFrame([(s, i, v) for s, vs in rows.items() for i, v in enumerate(vs)], "sid int, tok_ix int, v array<double>")
    ex = spark.createDataFrame(examples, "batch_id int, sid int, s int, e int")
    got = {r.batch_id: r.loss for r in vectors.cohesion_ratio(ex, vec, metric).collect()}
    for k, x in _cohesion(rows, examples, metric).items():
        assert math.isclose(got[k], x, rel_tol=1e-9)
    work = vectors.cohesion_work(ex, vec, metric).collect()
    assert len(work) == 8 and all(0 < r.computed <= r.pairs == 78 for r in work)
    assert sum(r.computed for r in work if r.sid == 0) < 0.5 * sum(r.pairs for r in work if r.sid == 0)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(6)
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 4, 20), np.array([0.5, 1.0, 0.0, 2.0])
    flat = rng.normal(size=5 * 3 + 5 + 4 * 5 + 4)
    loss = lambda v: training.loss_and_gradient(x, y, training._layers(v, 3, 5, 4), w)
    at = loss(flat)
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert math.isclose((loss(flat + step)[0] - loss(flat - step)[0]) / 2e-6, at[2 + i], rel_tol=1e-4, abs_tol=1e-6)
    hidden, _, logp = training._forward(x, training._layers(flat, 3, 5, 4))
    assert math.isclose(at[0], sum(-w[k] * r[k] for r, k in zip(logp, y))) and at[1] == w[y].sum()


def test_head_learns_what_a_line_cannot(spark):
    """Exclusive or; weights by type; rows without label or with broken features; no rows."""
    rows = [(float(a), float(b), a ^ b) for a in (0, 1) for b in (0, 1)] * 30
    df = spark.createDataFrame([([a, b], y) for a, b, y in rows] + [(None, 1), ([1.0, None], 1), ([0.0, float("nan")], 0), ([1.0, 1.0], None)], "features array<double>, label int")
    head = training.fit_span_classifier(df, df, ["O", "x"], hidden=16, rate=0.05, epochs=40, steps=2)
    assert head.f1 == 1.0
    out = training.predict_types(head, df.filter("label IS NOT NULL AND size(features) = 2 AND NOT exists(features, x -> x IS NULL OR isnan(x))"))
    assert out.filter("label <> predicted").count() == 0
    # the same features with both types: the weights decide
    both = spark.createDataFrame([([1.0], 0)] * 30 + [([1.0], 1)] * 10, "features array<double>, label int")
    pick = lambda weights: training.predict_types(
        training.fit_span_classifier(both, both, ["O", "x"], hidden=4, rate=0.05, epochs=15, patience=15, steps=1, type_weights=weights), both
    ).first()["predicted"]
    assert pick({"O": 1.0, "x": 6.0}) == 1 and pick({"O": 1.0}) == 0
    with pytest.raises(ValueError):
        training.fit_span_classifier(both.limit(0), both, ["O", "x"])
    with pytest.raises(ValueError):
        training.fit_span_classifier(both, both, ["O", "x"], type_weights={"y": 1.0})
