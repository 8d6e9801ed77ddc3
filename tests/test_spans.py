import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import alignment, clusters, sampling, selection

from .plain import greedy, merges, parent

KEY = "doc_id bigint, sent_ix int"
SPAN = f"{KEY}, s int, e int"


def by_sentence(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, r.sent_ix), []).append(tuple(r[c] for c in cols))
    return out


@pytest.mark.parametrize("gaps", [[], [3.0], [1.0] * 6, [1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0]])
def test_cluster_edges(spark, gaps):
    df = spark.createDataFrame([(1, 0, gaps)], f"{KEY}, gaps array<double>")
    got = by_sentence(clusters.cluster_set(df), "s", "e").get((1, 0), [])
    assert sorted(got) == sorted(merges(gaps) + [(i, i) for i in range(len(gaps) + 1)])


def test_clusters_random(spark):
    rng = random.Random(2)
    rows = [(i, 0, [float(rng.randrange(6)) for _ in range(rng.randrange(40))]) for i in range(1500)]
    df = spark.createDataFrame(rows, f"{KEY}, gaps array<double>")
    got = by_sentence(clusters.chain_clusters(df), "s", "e")
    for k, _, gaps in rows:
        assert sorted(got.get((k, 0), [])) == sorted(merges(gaps))


def test_one_long_sentence(spark):
    """A sentence of 200,000 words next to short ones: linear work, nothing dropped."""
    n = 200_000
    long = spark.range(1).select(
        F.lit(1).cast("bigint").alias("doc_id"),
        F.lit(0).alias("sent_ix"),
        F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: (i * 7919 % 1013).cast("double")).alias("gaps"),
    )
    found = clusters.cluster_set(long)
    assert found.count() == 2 * n - 1
    scored = found.withColumns({"label": F.lit(1), "confidence": F.lit(0.5)})
    assert [(r.s, r.e) for r in selection.flat_select(scored).collect()] == [(0, n - 1)]
    assert selection.span_tree(scored).filter("parent_s is null").count() == 1


def test_gap_arrays_and_edges(spark):
    rows = [(1, 0, 1, 5.0), (1, 0, 0, 2.0)]
    df = spark.createDataFrame(rows, f"{KEY}, ix int, d double")
    assert clusters.gap_arrays(df).first()["gaps"] == [2.0, 5.0]
    ids = spark.createDataFrame([(1, 0, [0, 0, 1, 2, 2, -1]), (2, 0, [0, -1])], f"{KEY}, word_ids array<int>")
    got = by_sentence(clusters.chain_edges(ids), "i", "j")
    assert got == {(1, 0): got[(1, 0)]} and sorted(got[(1, 0)]) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def _random_scored(spark, seed, laminar=False):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        spans = set()
        for _ in range(rng.randrange(1, 30)):
            s = rng.randrange(20)
            spans.add((s, s + rng.randrange(10)))
        rows += [(k, 0, s, e, 1 + rng.randrange(3), rng.choice([0.3, 0.5, 0.9])) for s, e in spans]
    return rows, spark.createDataFrame(rows, f"{SPAN}, label int, confidence double")


def test_flat_select_random(spark):
    rows, df = _random_scored(spark, 3)
    got = by_sentence(selection.flat_select(df), "s", "e")
    for k in range(300):
        spans = [(s, e, c) for d, _, s, e, _, c in rows if d == k]
        assert sorted(got[(k, 0)]) == sorted((s, e) for s, e, _ in greedy(spans))


def test_flat_select_crossing(spark):
    rows = [(1, 0, 0, 4, 1, 0.9), (1, 0, 2, 5, 2, 0.8), (1, 0, 2, 3, 2, 0.7), (1, 0, 9, 9, 0, 0.99)]
    df = spark.createDataFrame(rows, f"{SPAN}, label int, confidence double")
    flat = selection.flat_select(df)
    assert sorted((r.s, r.e) for r in flat.collect()) == [(0, 4), (2, 5)]
    every = selection.all_predictions(df)
    assert sorted((r.s, r.e, r.label) for r in every.collect()) == [(0, 4, 1), (2, 5, 2), (9, 9, 0)]
    conf = selection.span_confidence(df.select("doc_id", "sent_ix", "s", "e"), df)
    assert {(r.s, r.confidence) for r in conf.filter("s > 3").collect()} == {(9, 0.0)}


def test_span_tree_random(spark):
    rows, df = _random_scored(spark, 4)
    words = df.groupBy("doc_id", "sent_ix").agg(F.max("e").alias("top")).select(
        "doc_id", "sent_ix", F.explode(F.sequence(F.lit(0), "top")).alias("s")
    ).withColumn("e", F.col("s"))
    for given in (None, words):
        got, labels = {}, {}
        for r in selection.span_tree(df, given).collect():
            assert (r.s, r.e) not in got.setdefault(r.doc_id, {})
            got[r.doc_id][(r.s, r.e)] = None if r.parent_s is None else (r.parent_s, r.parent_e)
            labels[(r.doc_id, r.s, r.e)] = r.label
        for k in range(300):
            spans = {(s, e): t for d, _, s, e, t, _ in rows if d == k}
            top = max(e for _, e in spans)
            if given is not None:
                spans = {**{(i, i): 0 for i in range(top + 1)}, (0, top): 0, **spans}
            assert got[k] == {sp: parent(sp, spans) for sp in spans}
            assert all(labels[(k, *sp)] == t for sp, t in spans.items())


def test_assign_types(spark):
    rows = [(1, 0, 0, 0, [1.0, 1.0, 0.0]), (1, 0, 0, 1, [0.0, 700.0, 0.0])]
    df = spark.createDataFrame(rows, f"{SPAN}, logits array<double>")
    got = {r.e: (r.label, round(r.confidence, 6)) for r in selection.assign_types(df).collect()}
    assert got == {0: (0, round(1 / (2 + 2.718281828459045**-1), 6)), 1: (1, 1.0)}
    probs = selection.softmax_probs(df).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-12 for r in probs)


def test_filters_random(spark):
    rng = random.Random(5)

    def spans(n):
        out = []
        for k in range(200):
            for _ in range(rng.randrange(n)):
                s = rng.randrange(12)
                out.append((k, 0, s, s + rng.randrange(6)))
        return out

    gold, cand = spans(4), sorted(set(spans(15)))
    g, c = spark.createDataFrame(gold, SPAN), spark.createDataFrame(cand, SPAN)
    of = lambda k: [(s, e) for d, _, s, e in gold if d == k]
    flat = {tuple(r) for r in sampling.filter_flat(g, c).collect()}
    chunk = {tuple(r) for r in sampling.filter_chunk(g, c).collect()}
    assert flat == {x for x in cand if not any(a <= x[2] and b >= x[3] for a, b in of(x[0]))}
    assert chunk == {x for x in cand if not any(x[2] <= a and x[3] >= b for a, b in of(x[0]))}
    assert sampling.no_filter(g, c).count() == len(cand)


def test_negatives(spark):
    gold = spark.createDataFrame([(1, 0, 0, 1, 2)], f"{SPAN}, label int")
    cand = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1), (1, 0, 2, 3), (2, 0, 0, 1)], SPAN)
    rows = lambda limit: sorted(tuple(r) for r in sampling.negative_spans(gold, cand, limit).collect())
    assert rows(None) == [(1, 0, 0, 1, 2), (1, 0, 1, 1, 0), (1, 0, 2, 3, 0), (2, 0, 0, 1, 0)]
    assert rows(1) == [(1, 0, 0, 1, 2), (1, 0, 1, 1, 0), (2, 0, 0, 1, 0)]
    assert rows(0) == [(1, 0, 0, 1, 2)]


def _texts(spark, lengths):
    return spark.createDataFrame(
        [(i, 0, ["w"] * n, []) for i, n in enumerate(lengths)],
        f"{KEY}, tokens array<string>, spans array<struct<start:int,end:int,label:int>>",
    )


def test_random_spans_whole_and_distinct(spark):
    lengths = [1, 2, 3, 5, 14, 15, 16, 17, 40, 333]
    got = by_sentence(sampling.random_spans(_texts(spark, lengths)), "s", "e")
    for i, n in enumerate(lengths):
        spans = got[(i, 0)]
        assert len(spans) == len(set(spans)) == min(2 * n + 1, n * (n + 1) // 2)
        assert all(0 <= s <= e < n for s, e in spans)
    again = by_sentence(sampling.random_spans(_texts(spark, lengths)), "s", "e")
    other = by_sentence(sampling.random_spans(_texts(spark, lengths), seed=7), "s", "e")
    assert sorted(again[(9, 0)]) == sorted(got[(9, 0)]) != sorted(other[(9, 0)])


def test_random_spans_are_even(spark):
    """Over many sentences each span of a 20-word sentence comes up about equally often."""
    got = sampling.random_spans(_texts(spark, [20] * 3000)).groupBy("s", "e").count().collect()
    mean = 3000 * 41 / 210
    assert len(got) == 210
    assert all(abs(r["count"] - mean) < 6 * mean**0.5 for r in got)


def test_default_negatives(spark):
    df = _texts(spark, [4, 6]).withColumn(
        "spans", F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit(3).alias("label")))
    )
    got = by_sentence(sampling.default_negatives(df, limit_samples=4), "s", "e", "label")
    for spans in got.values():
        assert (0, 1, 3) in spans and (0, 1, 0) not in spans
        assert sum(x[2] == 0 for x in spans) == 4
    assert sum(map(len, by_sentence(sampling.default_negatives(df, 0), "s").values())) == 2


def test_candidates_by_text(spark):
    """A third of all sentences are copies of one text; the last copy's spans count."""
    rows = [(i, 0, ["same", "text"]) for i in range(100)] + [(i, 0, ["t", str(i)]) for i in range(100, 300)]
    rows += [(300, 0, ["no", "spans"]), (301, 0, ["no", "spans"])]
    sents = spark.createDataFrame(rows, f"{KEY}, tokens array<string>")
    pred = spark.createDataFrame([(i, 0, i, i) for i in range(301)], SPAN)
    got = by_sentence(sampling.candidates_by_text(sents, pred), "s", "e")
    assert all(got[(i, 0)] == [(99, 99)] for i in range(100))
    assert all(got[(i, 0)] == [(i, i)] for i in range(100, 300))
    # the last copy has no spans, so the first has none either
    assert (300, 0) not in got and (301, 0) not in got
    assert sampling.candidates_by_id(sents, pred).count() == 301


def test_undersample(spark):
    df = spark.range(4321).select(F.col("id").alias("doc_id"))
    kept = sampling.undersample(df, 0.25, "doc_id")
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids) == kept.count() == round(0.25 * 4321)
    assert sampling.undersample(df, 0.0, "doc_id").count() == 0
    assert sampling.undersample(df, 1.0, "doc_id").count() == 4321
    about = sampling.undersample_approx(df, 0.25, "doc_id").count()
    assert abs(about - 1080) < 200


@pytest.mark.parametrize("seed", [None, 11])
def test_padded_batches(spark, seed):
    rows = [(i, 0, list(range(1, 1 + i % 4))) for i in range(103)]
    df = spark.createDataFrame(rows, f"{KEY}, types array<int>")
    out = sampling.padded_batches(df, 10, shuffle_seed=seed).collect()
    assert len(out) == 103
    sizes = {}
    for r in out:
        sizes.setdefault(r.batch_id, []).append(r)
    assert sorted(sizes) == list(range(11)) and len(sizes[10]) == 3
    for batch in sizes.values():
        width = max(r.doc_id % 4 for r in batch)
        for r in batch:
            own = list(range(1, 1 + r.doc_id % 4))
            assert r.types == own + [-100] * (width - len(own))
    if seed is None:
        assert all(r.batch_id == r.doc_id // 10 for r in out)


def test_masks_markers_words(spark):
    df = spark.createDataFrame(
        [(1, 0, [0, 0, 1, 2, -1], 1, 2), (2, 0, [0, 1, -1, -1, -1], 5, 6)], f"{KEY}, word_ids array<int>, s int, e int"
    )
    masked = alignment.span_token_mask(df)
    assert [r["mask"] for r in masked.orderBy("doc_id").collect()] == [[0, 0, 1, 1, 0], [0] * 5]
    got = alignment.mask_to_span(masked).collect()
    assert [(r.doc_id, r.tok_s, r.tok_e) for r in got] == [(1, 2, 3)]
    ext = alignment.word_extents(df).filter("doc_id = 1").collect()
    assert sorted((r.word_id, r["first"], r["last"]) for r in ext) == [(0, 0, 1), (1, 2, 2), (2, 3, 3)]
    text = spark.createDataFrame([(["a", "b", "c"], 1, 2)], "tokens array<string>, s int, e int")
    assert alignment.insert_markers(text).first()["marked"] == ["a", "[E_START]", "b", "c", "[E_END]"]


def test_token_spans(spark):
    sents = spark.createDataFrame([(1, 0, [0, 0, 1, 2, 2, -1])], f"{KEY}, word_ids array<int>")
    words = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 2, 2), (1, 0, 0, 2)], SPAN)
    tok = clusters.clusters_to_tokens(words, alignment.word_extents(sents))
    assert {(r.s, r.e, r.tok_s, r.tok_e) for r in tok.collect()} == {(0, 1, 0, 2), (2, 2, 3, 4), (0, 2, 0, 4)}
    back = selection.word_assignments(tok.drop("s", "e"), sents)
    assert {(r.s, r.e) for r in back.collect()} == {(0, 1), (2, 2), (0, 2)}
    cuts = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 1, 2), (1, 0, 2, 3), (1, 0, 3, 4), (1, 0, 5, 5)], f"{KEY}, tok_s int, tok_e int")
    assert {(r.tok_s, r.tok_e) for r in clusters.whole_word_clusters(cuts, sents).collect()} == {(0, 2), (3, 4)}


def test_phrases(spark):
    sents = spark.createDataFrame(
        [(1, 0, ["a", "b", "a", "b", "c"]), (2, 0, ["b", "c"]), (3, 0, ["c"])], f"{KEY}, tokens array<string>"
    )
    phrases = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c", "a"]), (4, ["b", "c"])], "phrase_id int, phrase array<string>")
    got = {(r.phrase_id, r.doc_id) for r in alignment.phrase_hits(sents, phrases).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (4, 1), (4, 2)}


def test_phrases_against_plain_search(spark):
    """Overlapping, nested and repeated phrases, several blocks, null and empty entries."""
    rng = random.Random(12)
    word = lambda: rng.choice("abc")
    sents = [(d, i, [word() for _ in range(rng.choice([0, 1, 2, 5, 30]))]) for d in range(20) for i in range(3)]
    sents += [(50, 0, None), (51, 0, ["a", None, "b", "a"])]
    phrases = [(k, [word() for _ in range(rng.choice([0, 1, 2, 2, 3, 4, 6]))]) for k in range(60)]
    phrases += [(100, None), (101, ["a", None]), (102, ["zz"]), (None, ["a", "b"])]
    s_df = spark.createDataFrame(sents, f"{KEY}, tokens array<string>")
    p_df = spark.createDataFrame(phrases, "phrase_id int, phrase array<string>")
    inside = lambda p, t: any(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
    expected = {(k, d, i) for k, p in phrases for d, i, t in sents if p and None not in p and t and inside(p, t)}
    for block in (1, 10, alignment.BLOCK_WORDS):
        got = alignment.phrase_hits(s_df, p_df, block_words=block).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert alignment.phrase_hits(s_df, p_df.limit(0)).count() == 0
