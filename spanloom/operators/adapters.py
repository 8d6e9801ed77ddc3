"""Corpus adapters: source rows -> normalised sentences (id, tokens, spans)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import KEYS
from ..functions import align
from ..functions.columns import encode, hash_bucket, let
from ..functions.tags import BEGIN, TYPE_TAG, iob_span_lists, type_name
from ..schema import SPAN, vocab_names
from .numbering import with_row_index
from .tables import unfold

SPLIT_RANK = {"train": 0, "validation": 1, "test": 2}


def _list_vocab(names: DataFrame, first: str = "O") -> DataFrame:
    """One row holding an ordered name array -> (label, name) rows, ``O`` in front."""
    return names.select(
        F.posexplode(F.array_prepend("names", F.lit(first))).alias("label", "name")
    )


def drop_empty(df: DataFrame, tokens="tokens") -> DataFrame:
    return df.filter(F.size(tokens) > 0)


def tag_strings(df: DataFrame, tags: str, tag_names: list[str]) -> DataFrame:
    """Integer tag codes -> tag names."""
    names = F.array(*[F.lit(n) for n in tag_names])
    return df.withColumn(
        tags, let(names, lambda n: F.transform(F.col(tags), lambda x: F.get(n, x)))
    )


def iob_vocab(df: DataFrame, tags="tags", tag_names: list[str] | None = None) -> DataFrame:
    """``O`` and the names of all ``B-`` tags, in tag order: the order of ``tag_names`` if
    the source declares its tags, else the order of the tag strings met."""
    if tag_names is not None:
        names = ["O"] + [t[len(BEGIN):] for t in tag_names if t.startswith(BEGIN)]
        return df.sparkSession.createDataFrame(list(enumerate(names)), "label int, name string")
    seen = df.select(F.explode(F.array_distinct(tags)).alias("tag"))
    begins = seen.filter(F.col("tag").startswith(BEGIN)).select(F.substr(F.col("tag"), F.lit(3)).alias("name"))
    return _list_vocab(begins.agg(F.array_sort(F.collect_set("name")).alias("names")))


def _encoded(spans: Column, names: Column) -> Column:
    """Span labels as codes; spans whose name has no code are left out."""
    coded = F.transform(
        spans,
        lambda x: F.struct(
            x["start"].cast("int").alias("start"),
            x["end"].cast("int").alias("end"),
            encode(names, x["label"]).alias("label"),
        ),
    )
    return F.filter(coded, lambda x: x["label"].isNotNull())


def _with_names(df: DataFrame, vocab, spans: Callable[[Column], Column]) -> DataFrame:
    """Set ``spans`` by a function of the name array.  The array is a column of its own
    first: a subquery may not stand inside a higher-order function."""
    return (
        df.withColumn("__names", vocab_names(vocab))
        .withColumn("spans", spans(F.col("__names")))
        .drop("__names")
    )


def iob_to_spans(df: DataFrame, tags="tags", vocab=None) -> DataFrame:
    """Add ``spans``; with a vocabulary the labels are its codes, else names."""
    named = df.withColumn("spans", iob_span_lists(F.col(tags)))
    if vocab is None:
        return named
    return _with_names(named, vocab, lambda names: _encoded(F.col("spans"), names))


def iob_rejects(df: DataFrame, vocab, tags="tags", keys=KEYS) -> DataFrame:
    """Spans opened by an ``I-`` tag whose name the vocabulary does not have."""
    names = vocab_names(vocab)
    return df.select(*keys, F.inline(iob_span_lists(F.col(tags)))).filter(
        encode(names, F.col("label")).isNull()
    )


def adapt_iob(df: DataFrame, tags: str, vocab, extra=()) -> DataFrame:
    """Tagged sentences -> normalised rows without empty sentences."""
    return drop_empty(iob_to_spans(df, tags, vocab)).select("id", "tokens", "spans", *extra)


def adapt_ner(df: DataFrame, vocab, extra=()) -> DataFrame:
    return adapt_iob(df, "ner_tags", vocab, extra)


def adapt_chunk(df: DataFrame, vocab, extra=()) -> DataFrame:
    return adapt_iob(df, "chunk_tags", vocab, extra)


def split_train_val(df: DataFrame, *key: str, percent=20) -> DataFrame:
    """Move ``percent`` of train to validation by a hash of the key; other splits stay.
    Stable under reordering and growth, and no sort or count of the table."""
    moved = (F.col("split") == "train") & (hash_bucket(*[F.col(k) for k in key]) < percent)
    return df.withColumn("split", F.when(moved, "validation").otherwise(F.col("split")))


def entity_vocab(df: DataFrame, order=KEYS, entities="entities") -> DataFrame:
    """Entity types of train in first-seen order, after ``O``.  A sentence tells each of its types
    once, then one combining aggregate; the ordered list has one entry per type."""

    def first_places(types: Column) -> Column:
        place = lambda x: F.struct(x.alias("type"), F.array_position(types, x).alias("pos"))
        return F.transform(F.array_distinct(types), place)

    places = let(F.transform(entities, lambda x: x["type"]), first_places)
    seen = unfold(df.filter(F.col("split") == "train"), order, places, "entity", "ix")
    first = seen.groupBy(F.col("entity.type").alias("name")).agg(
        F.min(F.struct(*order, "entity.pos")).alias("at")
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "name")))
    names = F.filter(F.transform(ordered, lambda x: x["name"]), lambda x: x != "O")
    return _list_vocab(first.agg(names.alias("names")))


def global_ids(df: DataFrame, order=KEYS) -> DataFrame:
    """Running ids (strings, from 0) over train, then validation, then test."""
    rank = F.create_map(*[F.lit(x) for kv in SPLIT_RANK.items() for x in kv])
    ranked = df.withColumn("__split", rank[F.col("split")])
    return (
        with_row_index(ranked, "__split", *order, name="__ix")
        .withColumn("id", F.col("__ix").cast("string"))
        .drop("__ix", "__split")
    )


def encode_entities(df: DataFrame, vocab, entities="entities", on_unknown="error") -> DataFrame:
    """Entity lists -> ``spans`` with label codes.  A type that is not in the vocabulary
    stops the job (``error``) or leaves its span out (``reject``)."""

    def coded(names: Column) -> Column:
        if on_unknown == "reject":
            renamed = F.transform(
                entities,
                lambda x: F.struct(
                    x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("label")
                ),
            )
            return _encoded(renamed, names)
        unknown = F.raise_error(F.lit("entity type not in the train vocabulary")).cast("int")
        return F.transform(
            entities,
            lambda x: F.struct(
                x["start"].cast("int").alias("start"),
                x["end"].cast("int").alias("end"),
                F.coalesce(encode(names, x["type"]), unknown).alias("label"),
            ),
        )

    return _with_names(df, vocab, coded)


def adapt_entities(df: DataFrame, order=KEYS, extra=()) -> DataFrame:
    """Entity source with splits -> normalised rows: ids, vocabulary and codes."""
    vocab = entity_vocab(df, order)
    out = encode_entities(global_ids(df, order), vocab)
    return drop_empty(out).select("id", "tokens", "spans", *extra)


def docs_to_sentences(df: DataFrame, extra=()) -> DataFrame:
    """Documents -> one row per sentence, id ``{document_id}-{i}``; ``extra`` names document
    columns to keep, such as the split."""
    rows = unfold(df, ["document_id", *extra], "sentences", "sentence", "sentence_ix")
    return rows.select(
        F.concat_ws("-", "document_id", F.col("sentence_ix").cast("string")).alias("id"),
        "document_id",
        "sentence_ix",
        "sentence",
        *extra,
    )


def adapt_doc_ner(df: DataFrame, vocab, extra=()) -> DataFrame:
    rows = docs_to_sentences(df, extra).select(
        "id",
        *extra,
        F.col("sentence.words").alias("tokens"),
        F.col("sentence.named_entities").alias("ner_tags"),
    )
    return adapt_ner(rows, vocab, extra)


def type_names(tags: DataFrame, order="ord") -> DataFrame:
    """Tag table (tag, order) -> (tag, type, type_ix): ``B-X``/``I-X`` become ``X``, other
    tags keep their name, types numbered as first seen.  A tag set is small; the input
    may still be a table of all tags met, it is grouped first."""
    per_tag = tags.groupBy("tag").agg(F.min(order).alias("first"))
    named = per_tag.withColumns(
        {"type": type_name(F.col("tag")), "matched": F.col("tag").rlike(TYPE_TAG)}
    )
    groups = named.groupBy("type", "matched").agg(
        F.min("first").alias("first"), F.collect_list("tag").alias("tags")
    )
    # one row with an entry per type: the list of names, then back to the tags
    listed = groups.agg(
        F.array_sort(F.collect_list(F.struct("first", "type", "matched", "tags"))).alias("g")
    )

    def is_new(x: Column) -> Column:
        """A matched name is listed once; one that stood before as it is counts as seen."""
        earlier = F.exists(
            "g", lambda y: ~y["matched"] & (y["type"] == x["type"]) & (y["first"] < x["first"])
        )
        return ~x["matched"] | ~earlier

    names = F.transform(F.filter("g", is_new), lambda x: x["type"])
    rows = listed.withColumn("names", names).select("names", F.explode("g").alias("x"))
    return rows.select(
        F.explode("x.tags").alias("tag"),
        F.col("x.type").alias("type"),
        (F.array_position("names", F.col("x.type")) - 1).cast("int").alias("type_ix"),
    )


def decode_labels(df: DataFrame, vocab, label="label", name="name") -> DataFrame:
    return df.withColumn(name, F.get(vocab_names(vocab), F.col(label)))


def encode_labels(df: DataFrame, vocab, name="name", label="label") -> DataFrame:
    return df.withColumn(label, encode(vocab_names(vocab), F.col(name)))


def fix_brackets(df: DataFrame, tokens="tokens") -> DataFrame:
    return df.withColumn(tokens, align.fix_brackets(F.col(tokens)))


def schema_check(df: DataFrame, vocab) -> DataFrame:
    """Fail on missing columns or span fields; list (split, reason, n) of broken spans."""
    missing = {"id", "tokens", "spans"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    absent = set(SPAN.fieldNames()) - set(df.schema["spans"].dataType.elementType.fieldNames())
    if absent:
        raise ValueError(f"missing span fields: {sorted(absent)}")
    size = F.size(vocab_names(vocab))
    sized = unfold(df, ["split", F.size("tokens").alias("n_tokens")], "spans", "sp")
    spans = sized.select("split", "n_tokens", "sp.start", "sp.end", "sp.label")
    offsets = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_tokens"))
    known = (F.col("label") >= 0) & (F.col("label") < size)
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(offsets, F.lit(False)), F.lit("offsets")),
            F.when(~F.coalesce(known, F.lit(False)), F.lit("label")),
        )
    )
    return (
        spans.select("split", F.explode(reasons).alias("reason"))
        .groupBy("split", "reason")
        .agg(F.count("*").alias("n"))
    )


def observed_spans(df: DataFrame, vocab, splits=tuple(SPLIT_RANK)) -> tuple[DataFrame, Observation]:
    """The rows with their sound spans only, and what was wrong, counted as the rows pass.

    The observation has, per split, ``{split}_rows``, ``{split}_spans`` (sound ones),
    ``{split}_offsets`` and ``{split}_label`` (faults as ``schema_check`` has them; a span may
    have both).  It is filled by the first action on the rows: one scan gives rows and counts."""
    size, n = F.size(vocab_names(vocab)), F.size("tokens")
    placed = lambda x: F.coalesce((x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= n), F.lit(False))
    known = lambda x: F.coalesce((x["label"] >= 0) & (x["label"] < size), F.lit(False))
    faults = F.struct(
        F.size(F.filter("spans", lambda x: ~placed(x))).alias("offsets"),
        F.size(F.filter("spans", lambda x: ~known(x))).alias("label"),
        F.filter("spans", lambda x: placed(x) & known(x)).alias("sound"),
    )
    rows = df.withColumn("__f", faults)
    here = lambda split, value: F.coalesce(F.sum(F.when(F.col("split") == split, value)), F.lit(0)).cast("bigint")
    counts = {"rows": F.lit(1), "spans": F.size("__f.sound"), "offsets": F.col("__f.offsets"), "label": F.col("__f.label")}
    seen = Observation()
    metrics = [here(s, value).alias(f"{s}_{name}") for s in splits for name, value in counts.items()]
    rows = rows.observe(seen, *metrics)
    return rows.withColumn("spans", F.col("__f.sound")).drop("__f"), seen
