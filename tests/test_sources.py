from pyspark.sql import functions as F

from spanloom.sources import datasets

KEY = "doc_id bigint, sent_ix int"


def test_splits_and_datasets(spark, tmp_path):
    for name in ("train", "validation"):
        spark.createDataFrame([(name[0], ["x"])], "id string, tokens array<string>").write.parquet(str(tmp_path / name))
    files = {n: str(tmp_path / n) for n in ("train", "validation")}
    df = datasets.load_splits(spark, files)
    assert {(r.id, r.split) for r in df.collect()} == {("t", "train"), ("v", "validation")}
    datasets.write_dataset(df, str(tmp_path), "news", "small")
    back = datasets.load_dataset(spark, str(tmp_path), "news", "small").filter("split = 'train'")
    assert [r.id for r in back.collect()] == ["t"]
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().toString()


def test_predictions_round_trip(spark, tmp_path):
    sents = spark.createDataFrame([(1, 0, "a", ["x", "y"]), (1, 1, "b", ["z"])], f"{KEY}, id string, tokens array<string>")
    spans = spark.createDataFrame([(1, 0, 1, 1, 2), (1, 0, 0, 1, 1)], f"{KEY}, s int, e int, label int")
    rows = datasets.prediction_rows(sents, spans, ["O", "P", "Q"])
    path = datasets.write_predictions(rows, str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines[0] == (
        '{"id":"a","tokens":["x","y"],"spans":[{"start":0,"end":2,"type":"P"},{"start":1,"end":2,"type":"Q"}]}'
    )
    back = datasets.read_predictions(spark, path)
    assert {r.id: len(r.spans) for r in back.collect()} == {"a": 2, "b": 0}
    assert back.select(F.sum(F.size("tokens"))).first()[0] == 3


def test_predictions_travel_packed(spark, tmp_path):
    """Spans reach their sentence as packs, words as one text; files are compressed."""
    words = ['a"b', "", "\\", "x\ny", None, "ß\u2028"]
    sents = spark.createDataFrame([(1, 0, "i", words), (1, 0, "j", []), (2, 0, "k", None), (None, 0, "l", ["w"])], "doc_id int, sent_ix int, id string, tokens array<string>")
    found = [(1, 0, 3, 5, 1), (1, 0, 0, 0, 2), (1, 0, 0, 0, 2), (1, 0, 1, 1, None), (None, 0, 0, 0, 1)]
    spans = spark.createDataFrame(found, "doc_id int, sent_ix int, s int, e int, label int").repartition(3)
    rows = datasets.prediction_rows(sents, spans, ["O", "P", "Q"])
    want = [(0, 1, "Q"), (0, 1, "Q"), (1, 2, None), (3, 6, "P")]
    got = {r.id: (r.tokens, [tuple(x) for x in r.spans]) for r in rows.collect()}
    assert got == {"i": (words, want), "j": ([], want), "k": (None, []), "l": (["w"], [])}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "from_json" in plan
    path = datasets.write_predictions(rows, str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("*.json.gz")) and not list((tmp_path / "out").glob("*.json"))
    assert {r.id for r in datasets.read_predictions(spark, path).collect()} == set(got)
