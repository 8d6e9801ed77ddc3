"""Named datasets with splits, and prediction files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import KEYS
from ..operators.tables import join_large, packed
from ..schema import PREDICTION, vocab_names

SPLITS = ("train", "validation", "test")


def load_splits(
    spark: SparkSession, files: dict[str, str], fmt="parquet", columns: dict | None = None, schema=None
) -> DataFrame:
    """Split files (split -> path; test may be absent) as one table with a ``split``
    column.  ``columns`` maps a split to its select list where files differ."""
    unknown = set(files) - set(SPLITS)
    if unknown:
        raise ValueError(f"unknown splits: {sorted(unknown)}")

    def read(split: str) -> DataFrame:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.format(fmt).load(files[split])
        wanted = (columns or {}).get(split)
        return (df.select(*wanted) if wanted else df).withColumn("split", F.lit(split))

    return reduce(DataFrame.unionByName, [read(s) for s in SPLITS if s in files])


def load_dataset(spark: SparkSession, root: str, name: str, sub: str | None = None, fmt="parquet") -> DataFrame:
    """Dataset ``root/name[/sub]`` written with ``split`` as partition column: a filter on
    the split prunes the other files."""
    path = "/".join([root.rstrip("/"), name, *([sub] if sub else [])])
    return spark.read.format(fmt).load(path)


def write_dataset(df: DataFrame, root: str, name: str, sub: str | None = None, fmt="parquet") -> str:
    path = "/".join([root.rstrip("/"), name, *([sub] if sub else [])])
    df.write.partitionBy("split").format(fmt).save(path)
    return path


def prediction_rows(sentences: DataFrame, word_spans: DataFrame, vocab, keys=KEYS) -> DataFrame:
    """id, tokens, spans[start, end exclusive, type]; a sentence without spans stays with
    an empty list.  ``sentences``: keys, id, tokens.  ``word_spans``: keys, s, e, label."""
    lists = (
        packed(word_spans.select(*keys, "s", "e", "label"), keys)
        .groupBy(*keys)
        .agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("s", "e", "label")])
        .select(*keys, F.arrays_zip("s", "e", "label").alias("__spans"))
    )
    # words travel as one text: an array of short strings takes several times their bytes
    words = sentences.schema["tokens"].dataType.simpleString()
    text = words == "array<string>"
    rows = sentences.select(*keys, "id", F.to_json("tokens").alias("tokens") if text else "tokens")
    met = join_large(rows, lists, keys, "left").withColumn("__names", vocab_names(vocab))
    named = F.transform(
        "__spans",
        lambda x: F.struct(x["s"].alias("start"), (x["e"] + 1).alias("end"), F.get("__names", x["label"]).alias("type")),
    )
    none = F.array().cast(PREDICTION["spans"].dataType)
    return met.select(
        "id",
        (F.from_json("tokens", words) if text else F.col("tokens")).alias("tokens"),
        F.coalesce(F.array_sort(named), none).alias("spans"),
    )


def write_predictions(rows: DataFrame, path: str, compression="gzip") -> str:
    """One JSON object per line, one file per partition; compressed by default, as field names
    repeat with every span."""
    rows.select("id", "tokens", "spans").write.json(path, compression=compression)
    return path


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)
