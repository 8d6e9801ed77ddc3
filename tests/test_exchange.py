"""Span tables are exchanged as compressed parts of many sentences; rows, types and nulls stay."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.functions import packs
from spanloom.operators import alignment, clusters, metrics, sampling, selection
from spanloom.operators.tables import placed_by, placed_rows
from spanloom.sources import spantables, tasks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_rows(n=400):
    rng = random.Random(7)
    pick = lambda *x: rng.choice([None, *x])
    return [
        (pick(1, -5, 1 << 40), pick("a", "b"), pick(0, 3, -300, 70000), pick(0.5, 2.0), pick("x", "yy"), pick([1, None, 500], [])) for _ in range(n)
    ]


SHAPE = "doc_id bigint, name string, s int, x double, t string, ids array<int>"


def test_rows_come_back_as_they_were(spark):
    df = spark.createDataFrame(some_rows(), SHAPE).repartition(5)
    out = placed_rows(df, ("doc_id", "name"))
    assert rows(out) == rows(df) and out.dtypes == df.dtypes
    assert placed_rows(df.limit(0), ("doc_id", "name")).count() == 0
    # a key is in one task, its rows side by side
    at = out.withColumn("task", F.spark_partition_id()).groupBy("doc_id", "name").agg(F.countDistinct("task").alias("n"))
    assert at.filter("n > 1").count() == 0


def test_a_large_part_is_read_in_turns(monkeypatch):
    rng = random.Random(3)
    table = pa.table({"h": pa.array([0] * 3000, pa.int32()), "k": sorted(rng.randrange(200) for _ in range(3000)), "s": pa.array(range(3000), pa.int32())})
    hashed = [hash((k, "x")) % (1 << 31) for k in table["k"].to_pylist()]
    table = table.set_column(0, "h", pa.array(hashed, pa.int32()))
    frozen = list(packs.freeze_batches(iter(table.to_batches(max_chunksize=70)), 1, packs.part_ids(1)))
    monkeypatch.setattr(packs, "SPANS", 100)
    found, seen = [], set()
    for heads, group, cols in packs.opened(iter(frozen), 1):
        keys = heads.column(0).to_pylist()
        assert not seen & set(keys) and len(keys) == len(set(keys))
        seen |= set(keys)
        found += [(keys[g], s) for g, s in zip(group.tolist(), cols[0].to_pylist())]
        assert len(group) <= 100 + 60
    assert sorted(found) == sorted(zip(table["k"].to_pylist(), table["s"].to_pylist()))


def test_parts_fill_the_partitions(spark):
    for n in (1, 7, 24, 200):
        ids = packs.part_ids(n)
        at = spark.createDataFrame([(i,) for i in ids], "p int").select(F.expr(f"pmod(hash(p), {n})").alias("at"))
        assert [r["at"] for r in at.collect()] == list(range(n))


def test_spans_travel_at_a_few_bytes():
    n = 200_000
    rng = np.random.default_rng(1)
    doc = np.sort(rng.integers(0, 9000, n))
    table = pa.table({"h": pa.array(doc % 8, pa.int32()), "doc_id": doc, "sent_ix": pa.array(doc * 0, pa.int32()), "s": pa.array(rng.integers(0, 20, n), pa.int32()), "e": pa.array(rng.integers(0, 20, n), pa.int32())})
    frozen = pa.concat_batches(list(packs.freeze_batches(iter(table.to_batches(max_chunksize=10000)), 2, packs.part_ids(8))))
    assert sum(map(len, frozen.column(2).to_pylist())) < 3 * n


def _words(spark):
    sents = spark.createDataFrame(
        [(1, 0, [0, 0, 1, 2, 2, -1]), (2, 0, [0, 1, 1]), (2, 0, [0, 1, 1]), (3, 0, None), (None, 0, [0])], "doc_id int, sent_ix int, word_ids array<int>"
    )
    data = [(1, 0, 0, 1, "x"), (1, 0, 0, 2, "y"), (2, 0, 0, 2, "z"), (3, 0, 0, 0, "n"), (None, 0, 0, 0, "no"), (9, 0, 0, 0, "no"), (1, 0, None, 2, "half")]
    return spark.createDataFrame(data, "doc_id int, sent_ix int, tok_s int, tok_e int, label string"), sents


def test_whole_words_without_join(spark):
    """the word ids came by a join that exchanged span rows' packs one by one."""
    spans, sents = _words(spark)
    found = clusters.whole_word_clusters(spans, sents)
    assert "Join" not in plan(found) and plan(found).count("RepartitionByExpression") == 1
    assert rows(found) == [(1, 0, 0, 1, "x"), (1, 0, 0, 2, "y"), (2, 0, 0, 2, "z"), (2, 0, 0, 2, "z")]


def test_word_extents_are_exchanged_compressed(spark):
    sents = _words(spark)[1]
    found = alignment.word_extents(sents)
    assert "__part" in plan(found)
    assert rows(found) == [(1, 0, 0, 0, 1), (1, 0, 1, 2, 2), (1, 0, 2, 3, 4), (2, 0, 0, 0, 0), (2, 0, 1, 1, 2), (None, 0, 0, 0, 0)]


def test_word_assignments_without_join(spark):
    """spans met the word ids of their sentence by a join."""
    spans, sents = _words(spark)
    found = selection.word_assignments(spans, sents)
    assert "Join" not in plan(found) and plan(found).count("RepartitionByExpression") == 1
    want = [(1, 0, 0, 1, "x", 0, 0), (1, 0, 0, 2, "y", 0, 1), (1, 0, None, 2, "half", None, 1), (2, 0, 0, 2, "z", 0, 1), (2, 0, 0, 2, "z", 0, 1), (3, 0, 0, 0, "n", None, None)]
    assert rows(found) == sorted(want, key=str)


def test_stored_tables_are_exchanged_compressed(spark, monkeypatch, tmp_path):
    """packs were exchanged one by one.  A bucket is still one file, and tables still meet in theirs."""
    seen, plain = [], spantables.placed_rows
    monkeypatch.setattr(spantables, "placed_rows", lambda *a: seen.append(plain(*a)) or seen[-1])
    keys = ("doc_id", "name")
    df = spark.createDataFrame(some_rows(), SHAPE).repartition(3)
    back = spantables.store_spans(df, "odd", keys=keys, path=str(tmp_path / "odd"))
    assert rows(back) == rows(df) and "__part" in plan(seen[0])
    assert placed_by(back, keys) and not placed_by(df, keys)
    files = [f.name.split("_")[-1].split(".")[0] for f in (tmp_path / "odd").glob("part-*.parquet")]
    assert len(files) == len(set(files)) and len(files) <= 4
    more = spantables.store_spans(df, "odd", buckets=9, keys=keys)
    assert rows(more) == rows(df)


def test_cached_spans_are_looked_up_in_one_exchange(spark):
    """hex digests and packs went through one exchange per join; the lists met their sentences twice."""
    rng = random.Random(9)
    texts = [["a"], ["a", "b"], ["a b"], [], None, ["c"], [None, "c"]]
    key = lambda: (rng.choice([None, 1, 2, 3, 4]), rng.choice([0, 1, None]))
    sents = [(*key(), rng.choice(texts)) for _ in range(14)] + [(7, 0, ["once"]), (8, 0, ["twice"]), (9, 0, ["twice"]), (7, 1, ["none"])]
    spans = [(*key(), s, s + rng.randrange(3)) for s in range(40)] + [(7, 0, 1, 1), (8, 0, 2, 2), (9, 0, 3, 3), (9, 0, 3, 3)]
    s, p = spark.createDataFrame(sents, "doc_id int, sent_ix int, tokens array<string>"), spark.createDataFrame(spans, "doc_id int, sent_ix int, s int, e int")
    out = sampling.candidates_by_text(s, p, group_rows=2)
    assert "LeftSemi" not in plan(out)
    told = lambda t: " ".join(w for w in t or [] if w is not None)
    at = lambda k: [x[2:] for x in spans if None not in k and x[:2] == k]
    order = lambda k: tuple((x is not None, x or 0) for x in k)
    want, single = [], set()
    for t in {told(x[2]) for x in sents}:
        copies = [x[:2] for x in sents if told(x[2]) == t]
        if len(copies) == 1:
            single |= set(copies)
        else:
            want += [(*k, *x) for k in copies for x in at(max(copies, key=order))]
    want += [(*k, *x) for k in single for x in at(k)]
    assert rows(out) == sorted(want, key=str)


def test_flat_and_full_reports_share_their_exchange(spark):
    """the flat and the full report of the same clusters made and sent them once each."""
    rng = random.Random(12)
    key = lambda: (rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1]))
    span = lambda: (s := rng.randrange(6), s + rng.randrange(4))
    pred = [(*key(), *span(), rng.choice([None, 0, 1, 2, 3]), rng.choice([0.25, 0.5, 0.75])) for _ in range(300)]
    refs = [(*key(), *span(), rng.choice([None, 0, 1, 2, 3]), n) for n in range(150)]
    scored = spark.createDataFrame(pred, "doc_id int, sent_ix int, s int, e int, label int, confidence double").repartition(5)
    gold = spark.createDataFrame(refs, "doc_id int, sent_ix int, s int, e int, label int, ord int").repartition(3)
    full, flat = tasks.evaluate_task("nested", scored, gold), tasks.evaluate_task("ner", scored, gold)
    want = metrics.scored_report(scored, gold, F.col("label") != 0)
    assert rows(full) == rows(want)
    assert rows(tasks.evaluate_task("nested", scored.drop("confidence"), gold)) == rows(want)
    both = full.unionByName(flat)
    assert rows(both) == sorted(rows(full) + rows(flat), key=str)
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()
