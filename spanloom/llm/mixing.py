"""Mixing sources to target weights: fixed-length blocks, per-shard source counts, and
pseudorandom index permutations that map output slots to blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_base, text_of, word_array, word_count, written

BLOCK = 64  # words
SHARD_SLOTS = 4096  # blocks of an output shard
MAX_EPOCHS = 3  # a source is taken this often at most
ROUNDS = 24
BUCKETS = 512  # of a source, for running sums


def permuted(index: Column, size: Column, salt: Column, seed: int) -> Column:
    """The image of ``index`` under a pseudorandom permutation of [0, size).

    Swap-or-not: every round pairs x with K - x (mod size) and a hash of the pair decides
    whether x moves to its partner.  Exact for any size, without walking."""

    def step(x: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(F.lit(seed), r, salt), size)
        other = F.pmod(key - x, size)
        move = F.xxhash64(F.lit(seed + 1), r, salt, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(move, other).otherwise(x)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), index.cast("long"), step)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), cap: float = MAX_EPOCHS) -> DataFrame:
    """Per source (``source``, ``source_size``): its ``target`` words.

    Sources in code point order, null last, weigh ``weights`` in turn and share the whole
    size; a target stops at ``cap`` times the source's size and the rest is shared again by
    weight.  With the sources by ascending cap per weight, the capped ones are a prefix, and
    the first that is not capped gives the level of all others.  The windows see one row per
    source."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("__r", (F.row_number().over(order) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("__r") + 1))
    rows = ranked.withColumn("__cap", cap * F.col("source_size")).withColumn("__c", F.col("__cap") / F.col("weight"))
    before = everything.orderBy("__c", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("__level", left / share)
    level = F.min(F.when(F.col("__c") > F.col("__level"), F.struct("__c", "__level"))).over(everything)["__level"]
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("weight"), F.col("__cap")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def placed_documents(rows: DataFrame) -> DataFrame:
    """Rows with ``size`` get ``__a``, the words before them in their source, and ``__s``,
    the source as a key that is never null.  Order: hash bucket, document, text hash; equal
    rows are interchangeable."""
    rows = rows.withColumn("__s", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("doc_id", "__h"), F.lit(BUCKETS)))
    inside = Window.partitionBy("__s", "__b").orderBy("doc_id", "__h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = rows.groupBy("__s", "__b").agg(F.sum("size").alias("__n"))
    base = running_base(totals, "__b", "__n", by=("__s",))
    return rows.join(base, ["__s", "__b"]).withColumn("__a", F.col("__in") + F.col("base")).drop("__in", "base", "__b")


def mix_plan(rows: DataFrame, weights=(1.0, 2.0, 3.0), block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7):
    """The mix of ``rows`` (``__id``, ``doc_id``, ``source``, ``size``, ``__h``).

    Returns ``documents``, one row per input row with ``source_size`` and ``target``;
    ``cover``, the (row, block) overlaps in words; ``slots``, one row per output slot:
    ``__s`` and ``block`` that fill it, ``epoch``, output ``slot`` and ``shard``.

    A source of n blocks gets K = round(n * target / size) slots, at most three per block.
    A keyed permutation of all slots deals them to the shards, so a shard's counts per
    source are a multinomial draw without replacement whose totals meet the targets.  The
    k-th slot of a source takes block permute(k mod n), with a permutation per epoch."""
    placed = placed_documents(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights)
    sources = sources.withColumn("__s", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))
    n = F.ceil(F.col("source_size") / block).cast("long")
    sources = sources.withColumn("__n", n).withColumn(
        "__k", F.when(F.col("source_size") > 0, F.round(F.col("__n") * F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    one = Window.partitionBy(F.lit(0))
    sources = sources.withColumn(
        "__from", F.coalesce(F.sum("__k").over(one.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("__all", F.sum("__k").over(one))
    documents = placed.join(sources.select("__s", "source_size", "target"), "__s")

    first, last = F.floor(F.col("__a") / block), F.floor((F.col("__a") + F.col("size") - 1) / block)
    cover = placed.filter(F.col("size") > 0).select(
        "__id", "__s", "__a", "size", F.explode(F.sequence(first, last)).alias("block")
    )
    lo = F.greatest(F.col("block") * block, F.col("__a"))
    hi = F.least((F.col("block") + 1) * block, F.col("__a") + F.col("size"))
    cover = cover.select("__id", "__s", "block", (lo - F.col("__a")).alias("lo"), (hi - F.col("__a")).alias("hi"), (lo == F.col("block") * block).alias("__first"))

    # each block stands for one index of its source in every epoch: no table of slots is
    # made in one place
    turns = cover.filter("__first").select("__s", F.col("block").alias("__ix")).join(
        sources.select("__s", "__n", "__k", "__from", "__all"), "__s"
    )
    turns = turns.withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("long") for e in range(MAX_EPOCHS)))))
    turns = turns.withColumn("__turn", F.col("epoch") * F.col("__n") + F.col("__ix")).filter("__turn < __k")
    turns = turns.withColumn("__salt", F.xxhash64("__s", "epoch"))
    slot = permuted(F.col("__from") + F.col("__turn"), F.col("__all"), F.lit(0), seed + 2)
    turns = turns.withColumn("block", permuted(F.col("__ix"), F.col("__n"), F.col("__salt"), seed))
    turns = turns.withColumn("slot", slot)
    shard = F.floor(F.col("slot") / shard_slots).cast("long")
    slots = turns.select("__s", "block", "epoch", "slot", shard.alias("shard"))
    return documents, cover, slots


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``source``, ``text``): ``size``, ``source_size``,
    ``target``, ``taken`` (words the mix takes, repeats counted) and ``first_shard``, the
    first output shard that holds a part of it (null: none).

    Reruns agree.  A text without words or a null one has size 0 and is never taken; a null
    source is a source of its own; repeated rows count each; an empty table gives an empty
    one.  All keys of exchanges hold the block or a bucket, so a source may have any
    share of the rows."""
    rows = docs.select(
        "doc_id", "source", word_count(text_of("text")).alias("size"), F.xxhash64("text").alias("__h")
    ).withColumn("__id", F.monotonically_increasing_id())
    rows = written(rows, "sizes")  # read several times, so that the texts are not
    documents, cover, slots = mix_plan(rows, **options)
    chosen = slots.groupBy("__s", "block").agg(F.count("*").alias("__times"), F.min("shard").alias("__shard"))
    parts = cover.join(chosen, ["__s", "block"]).groupBy("__id").agg(
        F.sum((F.col("hi") - F.col("lo")) * F.col("__times")).alias("taken"), F.min("__shard").alias("first_shard")
    )
    return documents.join(parts, "__id", "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per document and epoch that takes
    a part of it; ``text`` is the whole text if the epoch takes all its words, else the taken
    words joined by spaces, in order; ``n_chars`` follows it.

    Documents without words are not in the mix.  The input is written once with a row
    number, since its texts meet their taken parts by that number."""
    pinned = written(docs.withColumn("__id", F.monotonically_increasing_id()), "mixing")
    rows = pinned.select(
        "__id", "doc_id", "source", word_count(text_of("text")).alias("size"), F.xxhash64("text").alias("__h")
    )
    _, cover, slots = mix_plan(written(rows, "sizes"), **options)
    parts = cover.join(slots.select("__s", "block", "epoch"), ["__s", "block"])
    parts = parts.groupBy("__id", "epoch").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("__got"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__cut")
    ).drop("epoch")
    out = pinned.join(parts, "__id").withColumn("__w", word_array(text_of("text")))
    cuts: Column = F.flatten(
        F.transform("__cut", lambda c: F.slice(F.col("__w"), (c["lo"] + 1).cast("int"), (c["hi"] - c["lo"]).cast("int")))
    )
    text = F.when(F.col("__got") == F.size("__w"), F.col("text")).otherwise(F.array_join(cuts, " "))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
