"""Span rows for training: positives, negatives, candidates, samples and batches."""

from __future__ import annotations

from fractions import Fraction
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import KEYS
from ..functions.align import PAD_LABEL
from ..functions.columns import hash60, indices, joined_text, let
from ..functions.packs import first_batches, frontier_packs, missing_packs, own_packs, winner_packs
from .clusters import cluster_indices
from .numbering import with_hash_rank, with_row_index
from .tables import fields_of, join_large, packed, placed_by, placed_packs, unfold


#: Modulus of the hashes of random spans: products of two residues fit in a long.
PRIME = (1 << 31) - 1


def positive_spans(df: DataFrame, keys=KEYS, spans="spans") -> DataFrame:
    """One row per gold span, end inclusive, ``ord`` = place in the span list."""
    rows = unfold(df, keys, spans, "sp")
    return rows.select(
        *keys,
        F.col("sp.start").alias("s"),
        (F.col("sp.end") - 1).alias("e"),
        F.col("sp.label").alias("label"),
        "ord",
    )


def not_gold(gold: DataFrame, candidates: DataFrame, keys=KEYS) -> DataFrame:
    """The candidates whose span is not gold.  Both meet as packs in their sentence, or where they
    lie if both are stored by sentence."""
    span = [*keys, "s", "e"]
    if placed_by(gold, keys) and placed_by(candidates, keys):
        return join_large(candidates, gold.select(*span), span, "left_anti")
    others = [c for c in candidates.columns if c not in span]
    refs = gold.select(*span, F.lit(True).alias("__g"), *[F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in others])
    both = candidates.select(*span, F.lit(False).alias("__g"), *others).unionByName(refs)
    scan = partial(missing_packs, key_count=len(keys), names=["s", "e", *others])
    shape = fields_of(candidates, *keys, "s", "e", *others)
    return placed_packs(both, keys).mapInArrow(scan, shape).select(*candidates.columns)


def limit_negatives(
    negatives: DataFrame, limit_samples: int | None, order=("s", "e"), keys=KEYS
) -> DataFrame:
    """At most ``limit_samples`` negatives per sentence in candidate order; 0 gives none,
    None all.  A rank filter, so each map task already drops what cannot qualify."""
    if limit_samples is None:
        return negatives
    kinds = {negatives.schema[c].dataType.typeName() for c in order}
    if kinds <= {"integer", "long"} and limit_samples > 0:
        # the rows of a sentence that lie together are cut before any sort
        cols = [*keys, *[c for c in negatives.columns if c not in keys]]
        scan = partial(first_batches, key_count=len(keys), order=list(order), limit=limit_samples)
        negatives = negatives.select(*cols).mapInArrow(scan, fields_of(negatives, *cols)).select(*negatives.columns)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return negatives.withColumn("__r", rank).filter(F.col("__r") <= limit_samples).drop("__r")


def negative_spans(
    gold: DataFrame, candidates: DataFrame, limit_samples=None, order=("s", "e"), keys=KEYS
) -> DataFrame:
    """Gold span rows, and the candidates that are not gold with label 0."""
    cols = [*keys, "s", "e"]
    fresh = limit_negatives(not_gold(gold, candidates, keys), limit_samples, order, keys)
    return gold.select(*cols, "label").unionByName(
        fresh.select(*cols, F.lit(0).alias("label"))
    )


def undersample(df: DataFrame, rate: float, *key: str) -> DataFrame:
    """Exactly ``round(rate * n)`` rows (half to even), chosen by hash order of the key.

    The rows are counted in 65,536 buckets of the digest; whole buckets below the border are
    kept by a filter and only the border bucket is ranked."""
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    keyed = df.withColumn("__h", digest).withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    counts = sorted((r["__b"], r["count"]) for r in keyed.groupBy("__b").count().collect())  # 65,536 at most
    wanted = round(Fraction(str(rate)) * sum(n for _, n in counts))
    border, room = 1 << 16, 0
    for bucket, n in counts:
        if wanted < n:
            border, room = bucket, wanted
            break
        wanted -= n
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *key))
    last = keyed.filter(F.col("__b") == border).withColumn("__r", inside).filter(F.col("__r") <= room).drop("__r")
    return keyed.filter(F.col("__b") < border).unionByName(last).drop("__h", "__b")


def undersample_approx(df: DataFrame, rate: float, *key: str) -> DataFrame:
    """The cheap mode: keep a key by its own hash.  A filter on the scan, no exchange; the
    size is right on average only."""
    scale = 1 << 30
    return df.filter(hash60(*[F.col(k) for k in key]) % scale < int(rate * scale))


def span_index(s: Column, e: Column) -> Column:
    """Place of a span when spans are listed by end, then start."""
    return F.shiftright(e.cast("bigint") * (e + 1), 1) + s


def at_index(df: DataFrame, index: str) -> DataFrame:
    """Replace a place by its span ``s, e``.  Two steps, so that the end is computed once."""
    end = F.floor((F.sqrt(8 * F.col(index) + 1) - 1) / 2).cast("int")
    return (
        df.withColumn("e", end)
        .withColumn("s", (F.col(index) - span_index(F.lit(0), F.col("e"))).cast("int"))
        .drop(index)
    )


def random_span_indices(n: Column, *seed: Column) -> Column:
    """Places of ``min(2n+1, n(n+1)/2)`` distinct spans of an n-word sentence, in draw order.

    One rule for every length: the places are cut into as many equal strata as spans are
    drawn, one is picked in each, and all are shifted by one offset around the circle of
    places.  Picks are distinct by construction, the offset gives every span the same
    chance, and where all spans are drawn each stratum is one of them.  A digest of the
    sentence's key gives the offset and four numbers; pick and order of a place are
    quadratic hashes with those, so that no digest is made per pick.  Linear in n (n log n
    for the order), all in the row."""

    def scattered(i: Column, a: Column, b: Column, c: Column) -> Column:
        return let((a * (i % PRIME) + b) % PRIME, lambda x: (x * x + c) % PRIME)

    def body(total: Column, k: Column, shift: Column, x: Column) -> Column:
        def pick(j: Column) -> Column:
            lo = F.floor(j * total / k).cast("bigint")
            hi = F.floor((j + 1) * total / k).cast("bigint")
            at = (lo + scattered(j, x["a"], x["b"], x["c"]) % (hi - lo) + shift) % total
            return let(at, lambda i: F.struct(scattered(i, x["c"], x["d"], x["a"]).alias("h"), i.alias("i")))

        picks = F.transform(F.transform(indices(k.cast("int")), lambda i: i.cast("bigint")), pick)
        return F.transform(F.array_sort(picks), lambda x: x["i"])

    total = F.floor(n.cast("bigint") * (n + 1) / 2).cast("bigint")
    digest = F.md5(joined_text(*seed))
    number = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("bigint")
    bound = F.array(
        F.struct(
            total.alias("total"),
            F.least(2 * n.cast("bigint") + 1, total).alias("k"),
            hash60(*seed, F.lit("o")).alias("o"),
            (number(1) + 1).alias("a"), number(8).alias("b"), (number(15) + 1).alias("c"), number(22).alias("d"),
        )
    )
    return F.transform(bound, lambda x: let(x["o"] % x["total"], lambda o: body(x["total"], x["k"], o, x)))[0]


def random_spans(df: DataFrame, seed=42, tokens="tokens", keys=KEYS) -> DataFrame:
    drawn = random_span_indices(F.size(tokens), F.lit(seed), *[F.col(k) for k in keys])
    return at_index(unfold(df, keys, drawn, "__ix"), "__ix").select(*keys, "ord", "s", "e")


def default_negatives(
    df: DataFrame, limit_samples: int | None = None, seed=42, tokens="tokens", keys=KEYS
) -> DataFrame:
    """Gold spans, and random spans that are not gold as negatives, the first ones drawn.

    Gold and draws belong to one sentence row, and a span is one number there: the set
    difference and the limit are array work, without join, window or exchange, in one scan."""
    drawn = random_span_indices(F.size(tokens), F.lit(seed), *[F.col(k) for k in keys])
    return _gold_and_others(df, drawn, limit_samples, keys)


def negative_spans_in_row(
    df: DataFrame, limit_samples: int | None = None, gaps="gaps", spans="spans", keys=KEYS
) -> DataFrame:
    """``negative_spans`` for candidates that are the clusters of the row's own ``gaps``: gold
    and clusters of a sentence meet in its row, without join or exchange.  Limited, the first
    by end and start count."""
    found = cluster_indices(F.coalesce(F.col(gaps), F.array().cast("array<double>")))
    return _gold_and_others(df.withColumn("__found", found), F.col("__found"), limit_samples, keys, spans)


def _gold_and_others(df: DataFrame, places: Column, limit_samples, keys, spans="spans") -> DataFrame:
    """Gold spans with their labels and the places that are not gold with 0, in one scan."""

    def body(x: Column) -> Column:
        gold = F.transform(x["spans"], lambda sp: F.struct(span_index(sp["start"], sp["end"] - 1).alias("ix"), sp["label"].alias("label")))
        fresh = F.array_except(x["places"], F.transform(x["spans"], lambda sp: span_index(sp["start"], sp["end"] - 1)))
        if limit_samples is not None:
            fresh = F.slice(fresh, 1, limit_samples)
        return F.concat(gold, F.transform(fresh, lambda i: F.struct(i.alias("ix"), F.lit(0).alias("label"))))

    # bound together: spans and places are computed arrays, each read more than once
    labelled = let(F.struct(F.col(spans).alias("spans"), places.alias("places")), body)
    rows = unfold(df, keys, labelled, "__x").select(*keys, F.col("__x.ix").alias("__ix"), F.col("__x.label").alias("label"))
    return at_index(rows, "__ix").select(*keys, "s", "e", "label")


def candidates_by_id(sentences: DataFrame, predicted: DataFrame, keys=KEYS) -> DataFrame:
    """Cached predictions looked up by the sentence's own key."""
    return join_large(predicted, sentences.select(*keys), keys, "left_semi").select(*keys, "s", "e")


def candidates_by_text(
    sentences: DataFrame, predicted: DataFrame, tokens="tokens", keys=KEYS, group_rows=4096
) -> DataFrame:
    """Cached predictions looked up by the sentence text; for equal texts those of the
    last sentence count.

    Copies of one text may be a large share of the table.  They are counted with a
    combining aggregate; a text that occurs once keeps its own spans (a join on the
    fine sentence key).  For repeated texts the few winners are packed to one row each,
    repeated once per ``group_rows`` copies, and the copies spread over (text, salt), so a
    group does not grow with the table.  A winner without spans leaves its copies without
    spans too.

    A text stands as 16 bytes of its digest.  The key is never null, so no join adds a filter
    of its own and both halves of the lookup read one exchange."""
    key = F.coalesce(F.substring(F.unhex(F.sha2(F.concat_ws(" ", tokens), 256)), 1, 16), F.lit(b""))
    keyed = sentences.select(*keys, key.alias("text_key"))
    repeated = (
        keyed.groupBy("text_key")
        .agg(F.max(F.struct(*keys)).alias("winner"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("text_key", F.ceil(F.col("n") / group_rows).alias("salts"), *[F.col(f"winner.{k}").alias(k) for k in keys])
    )
    # how many salts a text has comes from a join that AQE can split, since its right side
    # has one row per repeated text; without a partner a sentence keeps its own spans
    counts = repeated.select("text_key", "salts")
    marked = join_large(keyed, counts, ["text_key"], "left")
    # winners and single sentences meet the predicted spans by sentence, in one exchange
    no = {**{c: predicted.schema[c].dataType for c in ("s", "e")}, "text_key": "binary", "salts": "bigint"}
    row = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in no.items()])
    single = marked.filter("salts IS NULL").select(*keys)
    met = placed_packs(row(predicted.select(*keys, "s", "e"), 0).unionByName(row(single, 1)).unionByName(row(repeated, 2)), keys)
    own = met.mapInArrow(partial(own_packs, key_count=len(keys)), fields_of(predicted, *keys, "s", "e"))
    lists = ", ".join(f"{c} array<{predicted.schema[c].dataType.simpleString()}>" for c in ("s", "e"))
    winners = met.mapInArrow(partial(winner_packs, key_count=len(keys)), f"text_key binary, salts bigint, {lists}")
    every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")
    chosen = winners.select("text_key", F.arrays_zip("s", "e").alias("spans"), every_salt)
    salted = marked.filter("salts IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64(*keys), F.col("salts")))
    copies = join_large(salted.drop("salts"), chosen, ["text_key", "salt"]).select(*keys, F.inline("spans"))
    return own.unionByName(copies)


def filter_flat(gold: DataFrame, candidates: DataFrame, keys=KEYS, packs=False) -> DataFrame:
    """Keep candidates that lie in no gold span.

    A candidate lies in one iff, of the gold spans that start no later, the largest end
    reaches its end: a running maximum over starts, not a join of pairs.  With ``packs`` both
    tables have arrays ``s, e`` in a row, a sentence in one or several; the result has span rows."""
    return _frontier(gold, candidates, keys, packs, contained=True)


def filter_chunk(gold: DataFrame, candidates: DataFrame, keys=KEYS, packs=False) -> DataFrame:
    """Keep candidates that contain no gold span: of the gold spans that start no earlier,
    the smallest end must lie beyond the candidate's.  ``packs`` as above."""
    return _frontier(gold, candidates, keys, packs, contained=False)


def _frontier(gold, candidates, keys, packs: bool, contained: bool) -> DataFrame:
    """Both meet as packs in their sentence; the running ends are taken there."""
    lists = [t.select(*keys, "s", "e") if packs else packed(t.select(*keys, "s", "e"), keys) for t in (candidates, gold)]
    both = lists[0].withColumn("is_gold", F.lit(False)).unionByName(lists[1].withColumn("is_gold", F.lit(True)))
    spans = ", ".join(f"{c} {both.schema[c].dataType.elementType.simpleString()}" for c in ("s", "e"))
    placed = both.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(partial(frontier_packs, key_count=len(keys), contained=contained), f"{fields_of(both, *keys)}, {spans}")


def no_filter(gold: DataFrame, candidates: DataFrame, keys=KEYS) -> DataFrame:
    return candidates.select(*keys, "s", "e")


def padded_batches(
    df: DataFrame, batch_size: int, labels="types", keys=KEYS, shuffle_seed: int | None = None
) -> DataFrame:
    """Rows in batches of ``batch_size``, label arrays padded with -100 to the widest of
    the batch.  Row order, or hash order of the key when a seed is given.  The window has
    ``batch_size`` rows at most."""
    if shuffle_seed is None:
        numbered = with_row_index(df, *keys, name="__ix")
    else:
        digest = F.md5(F.concat_ws(":", F.lit(shuffle_seed), *[F.col(k).cast("string") for k in keys]))
        numbered = with_hash_rank(df, digest, *keys, name="__ix")
    batched = numbered.withColumn("batch_id", F.floor(F.col("__ix") / batch_size))
    width = F.max(F.size(labels)).over(Window.partitionBy("batch_id"))
    return (
        batched.withColumn("__w", width)
        .withColumn(
            labels,
            F.concat(F.col(labels), F.array_repeat(F.lit(PAD_LABEL), F.col("__w") - F.size(labels))),
        )
        .drop("__ix", "__w")
    )
