import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import brackets
from spanloom.functions.tags import iob_spans
from spanloom.operators import adapters, trees
from spanloom.sources import tasks

from .plain import iob, tree_spans

KEY = "doc_id bigint, sent_ix int"


def spans_of(rows):
    return [tuple(x) for x in rows]


@pytest.mark.parametrize(
    "tags, expected",
    [
        (["I-X", "I-X"], [(0, 2, "X")]),
        (["B-X", "I-Y", "O"], [(0, 2, "X")]),
        (["B-X", "B-X"], [(0, 1, "X"), (1, 2, "X")]),
        (["O", "B-Y", "I-Y"], [(1, 3, "Y")]),
        (["O", "O"], []),
        ([], []),
        (["B-X", "?", "I-Y"], [(0, 1, "X"), (2, 3, "Y")]),
    ],
)
def test_iob_edges(spark, tags, expected):
    df = spark.createDataFrame([(tags,)], "tags array<string>")
    assert spans_of(adapters.iob_to_spans(df).first()["spans"]) == expected


def test_iob_random(spark):
    rng = random.Random(1)
    rows = [
        (i, [rng.choice(["O", "B-X", "B-Y", "I-X", "I-Y", "junk"]) for _ in range(rng.randrange(25))])
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "k int, tags array<string>")
    got = {r["k"]: spans_of(r["spans"]) for r in adapters.iob_to_spans(df).collect()}
    assert got == {k: iob(t) for k, t in rows}


def test_vocab_codes_and_rejects(spark):
    df = spark.createDataFrame(
        [(1, 0, ["B-P", "I-P", "O", "I-Q"]), (1, 1, ["B-A"])], f"{KEY}, tags array<string>"
    )
    vocab = adapters.iob_vocab(df)
    assert {(r.label, r.name) for r in vocab.collect()} == {(0, "O"), (1, "A"), (2, "P")}
    got = adapters.iob_to_spans(df, vocab=vocab).orderBy("sent_ix").collect()
    assert [spans_of(r["spans"]) for r in got] == [[(0, 2, 2)], [(0, 1, 1)]]
    assert [(r.start, r.label) for r in adapters.iob_rejects(df, vocab).collect()] == [(3, "Q")]
    declared = adapters.iob_vocab(df, tag_names=["O", "B-Z", "I-Z", "B-A", "I-A"])
    assert [r.name for r in declared.orderBy("label").collect()] == ["O", "Z", "A"]


def test_integer_tags(spark):
    df = spark.createDataFrame([([1, 2, 0],)], "tags array<int>")
    named = adapters.tag_strings(df, "tags", ["O", "B-X", "I-X"])
    assert spans_of(adapters.iob_to_spans(named, vocab=["O", "X"]).first()["spans"]) == [(0, 2, 1)]


def _entities(spark, extra=()):
    rows = [
        ("train", 1, 0, ["a", "b"], [(0, 1, "G"), (0, 2, "A")]),
        ("train", 2, 0, ["c"], [(0, 1, "A")]),
        ("test", 0, 0, ["d"], [(0, 1, "G")]),
        ("validation", 7, 0, [], []),
        *extra,
    ]
    return spark.createDataFrame(
        rows,
        f"split string, {KEY}, tokens array<string>, "
        "entities array<struct<start:int,end:int,type:string>>",
    )


def test_entities(spark):
    source = _entities(spark)
    vocab = adapters.entity_vocab(source)
    assert [r.name for r in vocab.orderBy("label").collect()] == ["O", "G", "A"]
    out = {r["id"]: spans_of(r["spans"]) for r in adapters.adapt_entities(source).collect()}
    # ids run over train, validation, test; the empty sentence holds id 2 and is dropped
    assert out == {"0": [(0, 1, 1), (0, 2, 2)], "1": [(0, 1, 2)], "3": [(0, 1, 1)]}


def test_unknown_entity(spark):
    source = _entities(spark, [("test", 9, 0, ["x"], [(0, 1, "NEW"), (0, 1, "A")])])
    with pytest.raises(Exception, match="not in the train vocabulary"):
        adapters.encode_entities(source, ["O", "G", "A"]).collect()
    kept = adapters.encode_entities(source, ["O", "G", "A"], on_unknown="reject")
    assert spans_of(kept.filter("doc_id = 9").first()["spans"]) == [(0, 1, 2)]


def test_global_ids_are_dense(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"),
        F.lit(0).alias("sent_ix"),
        F.when(F.col("id") % 3 == 0, "test").when(F.col("id") % 3 == 1, "train").otherwise("validation").alias("split"),
    )
    got = adapters.global_ids(rows).collect()
    order = sorted(got, key=lambda r: (adapters.SPLIT_RANK[r.split], r.doc_id))
    assert [int(r["id"]) for r in order] == list(range(5000))


def test_documents(spark):
    df = spark.createDataFrame(
        [("d", [(["A", "b"], ["B-X", "I-X"], ""), ([], [], "")])],
        "document_id string, sentences array<struct<words:array<string>,"
        "named_entities:array<string>,parse_tree:string>>",
    )
    assert [r.id for r in adapters.docs_to_sentences(df).collect()] == ["d-0", "d-1"]
    out = adapters.adapt_doc_ner(df, ["O", "X"]).collect()
    assert [(r.id, spans_of(r.spans)) for r in out] == [("d-0", [(0, 2, 1)])]


def test_type_names(spark):
    names = ["O", "B-X", "I-X", "I-Y", "X", "C-Z"]
    df = spark.createDataFrame(list(enumerate(names)), "ord int, tag string")
    got = {r.tag: (r.type, r.type_ix) for r in adapters.type_names(df).collect()}
    assert got["I-X"] == ("X", 1) and got["I-Y"] == ("Y", 2) and got["O"] == ("O", 0)
    assert got["C-Z"] == ("C-Z", 4)  # an unmatched X was listed again before it


def test_schema_check(spark):
    rows = [("a", ["x", "y"], [(0, 2, 1), (1, 1, 1), (0, 3, 0)], "train"), ("b", ["x"], [(0, 1, 9)], "test")]
    schema = "id string, tokens array<string>, spans array<struct<start:int,end:int,label:int>>, split string"
    df = spark.createDataFrame(rows, schema)
    got = {(r.split, r.reason): r.n for r in adapters.schema_check(df, ["O", "X"]).collect()}
    assert got == {("train", "offsets"): 2, ("test", "label"): 1}
    with pytest.raises(ValueError, match="tokens"):
        adapters.schema_check(df.drop("tokens"), ["O"])
    named = df.withColumn("spans", F.transform("spans", lambda x: F.struct(x["start"].alias("start"))))
    with pytest.raises(ValueError, match="end"):
        adapters.schema_check(named, ["O"])


def test_fix_brackets_and_tasks(spark):
    df = spark.createDataFrame([(["-LRB-", "a-RRB-b"],)], "tokens array<string>")
    assert adapters.fix_brackets(df).first()["tokens"] == ["(", "a)b"]
    with pytest.raises(ValueError, match="not found"):
        tasks.run_task(tasks.Task("x", "no_such", "flat"), df)
    with pytest.raises(ValueError, match="neither"):
        tasks.run_task(tasks.Task("x", "news_ner", "half"), df)


TREES = {
    1: "(TOP (S (NP (NN a)) (VP (VB b) (NP (DT c) (NN d)))))",
    2: "(TOP (NP (NN a)))",
    3: "(TOP (S (NN a))",
    4: "(TOP (NN a)) (TOP (NN b))",
    5: "( (S (NP (NN a) (NN b)) (FOO (VP (VB c)))))",
    6: "",
    7: "word (S (NN a))",
    8: "(S (NN a)))",
    9: None,
}


def _trees(spark):
    return spark.createDataFrame([(k, 0, t) for k, t in TREES.items()], f"{KEY}, tree string")


def test_trees_against_loop(spark):
    got = {}
    for r in trees.tree_nodes(_trees(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.label, r.s, r.e))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {
        k: tree_spans(TREES[k]) for k in (1, 2, 5)
    }


def test_tree_rejects(spark):
    got = {r.doc_id: r.reason for r in trees.tree_rejects(_trees(spark)).collect()}
    assert got == {
        3: "unbalanced", 4: "not_one_tree", 6: "empty", 7: "not_one_tree", 8: "unbalanced", 9: "empty"
    }


def test_unary_collapse(spark):
    rows = trees.tree_unary_collapse(_trees(spark)).collect()
    assert {(r.s, r.e, r.label) for r in rows if r.doc_id == 2} == {(0, 1, "TOP+NP+NN")}
    # FOO is not listed: it takes no part in the chain
    five = {(r.s, r.e, r.label) for r in rows if r.doc_id == 5}
    assert (2, 3, "VP+VB") in five and (0, 3, "S") in five
    only = trees.tree_unary_collapse(_trees(spark), chains=["VP+VB"])
    assert {r.label for r in only.filter("doc_id = 2").collect()} == set()
    ignored = trees.ignored_labels(_trees(spark), trees.TREEBANK_LABELS, collapse=True, chains=["VP+VB"])
    assert {r.label for r in ignored.collect()} == {"", "FOO", "TOP+S", "NP+NN", "TOP+NP+NN"}


def test_tree_adapter(spark):
    df = trees.tree_tokens(_trees(spark).filter("tree is not null"))
    assert df.filter("doc_id = 5").first()["tokens"] == ["a", "b", "c"]
    out = {r.doc_id: r for r in trees.tree_adapter(df, trees.PHRASE_LABELS, False).collect()}
    assert set(out) == {1, 2, 5}
    code = trees.PHRASE_LABELS.index
    assert spans_of(out[2]["spans"]) == [(0, 1, code("TOP")), (0, 1, code("NP"))]
    assert trees.leaf_mismatches(df).count() == 0


def test_adapters_on_a_stream(spark, tmp_path):
    """Row-wise adapters take an unbounded input as they are."""
    rows = [("1", ["a", "b"], ["B-X", "I-X"]), ("2", [], [])]
    spark.createDataFrame(rows, "id string, tokens array<string>, ner_tags array<string>").write.json(
        str(tmp_path / "in")
    )
    stream = spark.readStream.schema(
        "id string, tokens array<string>, ner_tags array<string>"
    ).json(str(tmp_path / "in"))
    query = (
        adapters.adapt_ner(stream, ["O", "X"])
        .writeStream.format("memory")
        .queryName("adapted")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .start()
    )
    query.processAllAvailable()
    query.stop()
    assert [(r.id, spans_of(r.spans)) for r in spark.table("adapted").collect()] == [("1", [(0, 2, 1)])]


def test_tree_pass_is_one_pass(spark):
    """The three outputs of one read equal the three operators; the observation counts them."""
    rows = [
        (1, 0, "(TOP (S (NP (NN a)) (VP (VB b) (XX c))))"), (2, 0, "(S (NP a)"), (3, 0, "(S a) (S b)"), (4, 0, ""),
        (5, 0, None), (6, 0, "  "), (7, 0, "word"), (8, 0, "(S a))"), (9, 0, "(NP (NP (NP a)))"), (10, 0, "( (S a))"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, sent_ix int, tree string")
    out = trees.tree_pass(df)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(out.spans, trees.tree_to_spans(df)) and same(out.ignored, trees.ignored_labels(df))
    assert same(out.rejects, trees.tree_rejects(df))
    ignored = sum(r.n for r in out.ignored.collect())
    assert out.counts == {"span": out.spans.count(), "ignored": ignored, "reject": out.rejects.count()}
    assert trees.tree_pass(df.limit(0)).counts == {"span": 0, "ignored": 0, "reject": 0}


def test_observed_spans(spark):
    spans = "array<struct<start:int,end:int,label:int>>"
    rows = [
        ("a", ["x", "y"], [(0, 1, 1), (1, 3, 1), (0, 2, 9), (2, 1, -1), (None, 1, 0)], "train"),
        ("b", [], [], "train"), ("c", ["x"], None, "test"), ("d", None, [(0, 1, None)], "validation"),
    ]
    df = spark.createDataFrame(rows, f"id string, tokens array<string>, spans {spans}, split string")
    kept, seen = adapters.observed_spans(df, ["O", "A"])
    assert {r.id: r.spans and [tuple(x) for x in r.spans] for r in kept.collect()} == {"a": [(0, 1, 1)], "b": [], "c": None, "d": []}
    counts = seen.get
    assert counts["train_rows"] == 2 and counts["train_spans"] == 1 and counts["train_offsets"] == 3 and counts["train_label"] == 2
    assert counts["validation_offsets"] == counts["validation_label"] == 1 and counts["test_rows"] == 1
    listed = {(r.split, r.reason): r.n for r in adapters.schema_check(df, ["O", "A"]).collect()}
    assert all(counts[f"{s}_{r}"] == n for (s, r), n in listed.items())


def test_trees_are_read_in_their_row(spark):
    """Only trees are exchanged: no row per bracket, no window; a key that repeats is no tree."""
    rows = [(1, 0, "(TOP (S (NP (NN a)) (VP (VP b))))"), (2, 0, "(NP a)"), (2, 0, "(NP a)"), (None, 0, "(X\n(\tNP a))")]
    df = spark.createDataFrame(rows, "doc_id int, sent_ix int, tree string")
    for out in (trees.tree_to_spans(df), trees.tree_rejects(df), trees.ignored_labels(df), trees.tree_unary_collapse(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan
    assert {(r.doc_id, r.pos, r.s, r.e, r.label) for r in trees.tree_to_spans(df).collect()} == {
        (1, 0, 0, 2, "TOP"), (1, 1, 0, 2, "S"), (1, 2, 0, 1, "NP"), (1, 7, 1, 2, "VP"), (1, 8, 1, 2, "VP"), (None, 0, 0, 1, "X")
    }
    assert [tuple(r) for r in trees.tree_rejects(df).collect()] == [(2, 0, "unbalanced")]
    assert {(r.label, r.n) for r in trees.ignored_labels(df).collect()} == {("NN", 1), ("\tNP", 1)}
    assert {(r.s, r.e, r.label) for r in trees.tree_unary_collapse(df).collect() if r.doc_id} == {
        (0, 2, "TOP+S"), (0, 1, "NP+NN"), (1, 2, "VP+VP")
    }
    rows = trees.tree_adapter(trees.tree_tokens(df), trees.TREEBANK_LABELS, True, [])
    got = {r.doc_id: spans_of(r.spans) for r in rows.collect()}
    assert got == {1: [], None: []}


def test_tags_are_read_without_lambdas(spark):
    rng = random.Random(11)
    tags = [[rng.choice(["B-A", "I-A", "B-é", "I-", "B-", "O", "x", None]) for _ in range(rng.randrange(9))] for _ in range(200)]
    df = spark.createDataFrame([*enumerate(tags), (200, None), (201, [])], "k int, tags array<string>")
    found = adapters.iob_to_spans(df)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = df.select("k", iob_spans(F.col("tags")).alias("spans"))
    assert sorted(found.select("k", "spans").collect()) == sorted(expected.collect())


def test_trees_of_one_key_are_read_in_numpy(monkeypatch):
    """Against the loop over brackets, which only keys of several trees take."""
    rng = random.Random(5)

    def tree(depth=0):
        label = rng.choice(["", "", "", " ", "\n "]) + rng.choice(["S", "NP", "X", "é", ""])
        inner = [tree(depth + 1) for _ in range(rng.choice([1, 1, 2, 3]))] if depth < 4 and rng.random() < 0.7 else [rng.choice(["w", "a b", ""])]
        return f"({label} {rng.choice(['', ' ']).join(inner)})"

    texts = [tree() for _ in range(300)]
    texts += [t[:i] + rng.choice(["(", ")", "w", " "]) + t[i:] for t in texts[:100] for i in [rng.randrange(len(t))]]
    texts += [None, "", "  ", "\t", "w", "(", ")", "()", "(S a) b", "(S (NP (X a)))(S b)"]
    keep, find = frozenset(["S", "NP", "é", ""]), re.compile(brackets.TREE_TOKEN, re.ASCII).findall
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], names=["k", "tree"])
    for collapse in (None, "+"):
        expected = []
        for k, text in enumerate(texts):
            if not text or not text.strip(" "):
                continue
            fault, nodes = brackets.read_tree([find(text)]) if find(text) else (0, [])
            name = brackets.Labels(keep).__getitem__
            if not fault:
                one = [(s, e, [name(tok)]) for _, s, e, tok in nodes if name(tok) is not None]
                several = [x[1:] for x in brackets.joined(nodes, name)]
                expected.append((k, [(s, e, "+".join(x)) for s, e, x in (one if collapse is None else several)]))
        with monkeypatch.context() as patch:
            patch.setattr(brackets, "read_tree", None)
            cut = [batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)]
            found = [r for b in brackets.span_lists(iter(cut), 1, keep, collapse, None) for r in b.to_pylist()]
        assert [(r["k"], [tuple(x.values()) for x in r["spans"]]) for r in found] == expected


def test_entity_vocab_tells_each_type_once(spark):
    sp = "array<struct<start: int, end: int, type: string>>"
    data = [("train", 2, 0, [(0, 1, "A")] * 50), ("train", 1, 0, [(0, 1, "C"), (0, 1, None), (0, 1, "B"), (1, 2, "C")]), ("test", 0, 0, [(0, 1, "D")])]
    df = spark.createDataFrame([*data, ("train", 0, 0, [])], f"split string, doc_id int, sent_ix int, entities {sp}")
    vocab = adapters.entity_vocab(df)
    assert [tuple(r) for r in vocab.orderBy("label").collect()] == [(0, "O"), (1, "C"), (2, "B"), (3, "A")]
    assert "array_distinct" in vocab._jdf.queryExecution().optimizedPlan().toString()
