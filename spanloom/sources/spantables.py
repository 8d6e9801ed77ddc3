"""Span tables stored in buckets by sentence.

Gold spans, candidates and scores of a corpus are made once and read by many queries.  Stored
by the hash of the sentence key and sorted by it, two such tables meet in joins on the
sentence or on (sentence, span), and each is grouped by them, without an exchange."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import KEYS
from ..operators.tables import packed, placed_rows
from ..session import shared_path

#: What lets equal keys of a wider grouping or join stay where the sentence put them.
SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.requireAllClusterKeysForDistribution": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


def store_spans(df: DataFrame, what: str, buckets: int | None = None, keys=KEYS, path: str | None = None) -> DataFrame:
    """The table, stored in ``buckets`` (default: the session's shuffle partitions) under
    ``path`` or a fresh folder of the shared one, registered under a name of its own, and read
    back.  One exchange puts each bucket into one task and one file.

    The key is the sentence, so a source with a third of the rows still fills all buckets.
    Tables meet without exchange if their numbers of buckets agree.  An empty table is fine;
    null keys share a bucket."""
    spark: SparkSession = df.sparkSession
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{what}_{os.urandom(6).hex()}"
    # packs are exchanged, compressed, not span rows; the writer itself sorts each bucket by the key
    others = [c for c in df.columns if c not in keys]
    packs = placed_rows(packed(df, keys), keys, n) if others else df
    rows = packs.select(*keys, F.inline(F.arrays_zip(*others))).select(*df.columns) if others else df.repartition(n, *keys)
    rows.write.option("compression", "zstd").option("path", path or shared_path(spark, what)).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)

