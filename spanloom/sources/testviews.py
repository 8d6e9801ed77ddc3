"""Input views derived from the test tables (tags, spans, trees, vectors).

The tables hold plain text and embeddings only, so deterministic rules stand in for
annotation.  Every view covers the whole table and the whole text.  All text views
are narrow: they go from the documents scan to sentence rows without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.tags import iob_span_lists
from ..operators.clusters import cluster_set
from ..operators.sampling import positive_spans

# Fixed values of the derived label set.
LABELS = ["O", "T0", "T1", "T2"]


#: Session setting: spread each scan over so many partitions.  Unset, scans stay as they are;
#: for tables of one row group, which are one task, the caller sets it.
SPREAD = "spark.spanloom.spreadScans"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, spread if the session asks for it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None)
    return df.repartition(int(spread)) if spread else df


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LABELS)), "label int, name string")


def pieces(text: Column) -> Column:
    return F.split(F.replace(text, F.lit(". "), F.lit(".\n")), "\n")


def words_of(piece: Column) -> Column:
    return F.array_remove(F.split(piece, " "), "")


def upper_start(w: Column) -> Column:
    return (w >= "A") & (w < "[")  # "[" follows "Z"


def _named(n: Column, *names: str) -> Column:
    """One of the names by place: the array is a constant, so no text is built per word."""
    return F.get(F.array(*[F.lit(x) for x in names]), n)


def tag_of(w: Column) -> Column:
    return (
        F.when(upper_start(w), _named(F.length(w) % 3, "B-T0", "B-T1", "B-T2"))
        .when(F.length(w) <= 3, F.lit("O"))
        .otherwise(_named(F.length(w) % 3, "I-T0", "I-T1", "I-T2"))
    )


def chunk_tag_of(w: Column) -> Column:
    return (
        F.when(upper_start(w) | (F.length(w) % 4 == 0), _named(F.length(w) % 2, "B-NP", "B-VP"))
        .when(F.length(w) <= 2, F.lit("O"))
        .otherwise(_named(F.length(w) % 2, "I-NP", "I-VP"))
    )


def split_of(doc_id: Column) -> Column:
    return (
        F.when(doc_id % 10 < 8, F.lit("train"))
        .when(doc_id % 10 == 8, F.lit("validation"))
        .otherwise(F.lit("test"))
    )


def sentence_id() -> Column:
    return F.concat_ws("-", F.col("doc_id").cast("string"), F.col("sent_ix").cast("string"))


def sentences(spark: SparkSession, sf_dir: str, keep_empty=False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("sent_ix", "piece"))
    if not keep_empty:
        # some word is left; cheaper than to split the piece for the filter too
        rows = rows.filter(F.replace("piece", F.lit(" "), F.lit("")) != "")
    out = rows.select("doc_id", "sent_ix", words_of(F.col("piece")).alias("tokens"))
    return out


def tagged(spark: SparkSession, sf_dir: str, keep_empty=False) -> DataFrame:
    return sentences(spark, sf_dir, keep_empty).withColumn("tags", F.transform("tokens", tag_of))


def chunk_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir, True).withColumn(
        "chunk_tags", F.transform("tokens", chunk_tag_of)
    )


def gold_spans(tags: Column, n: Column) -> Column:
    """Spans of the tags plus, from two words on, the whole sentence as the last span."""
    names = F.array(*[F.lit(x) for x in LABELS])
    flat = F.transform(
        iob_span_lists(tags),
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            (F.array_position(names, x["label"]) - 1).cast("int").alias("label"),
        ),
    )
    whole = F.struct(
        F.lit(0).alias("start"), n.alias("end"), (1 + n % 3).cast("int").alias("label")
    )
    return F.when(n >= 2, F.array_append(flat, whole)).otherwise(flat)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised sentences: keys, tokens, spans[start, end exclusive, label]."""
    return tagged(spark, sf_dir).withColumn("spans", gold_spans(F.col("tags"), F.size("tokens")))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold span rows, end inclusive, ``ord`` = position in the span list."""
    return positive_spans(annotated(spark, sf_dir))


def gold_flat(spark: SparkSession, sf_dir: str, packs=False) -> DataFrame:
    """Only the spans of the tags, end inclusive; with ``packs`` as arrays in their sentence."""
    spans = tagged(spark, sf_dir).select("doc_id", "sent_ix", iob_span_lists(F.col("tags")).alias("spans"))
    if packs:
        return spans.select("doc_id", "sent_ix", F.col("spans.start").alias("s"), F.transform("spans.end", lambda e: e - 1).alias("e"))
    spans = spans.select("doc_id", "sent_ix", F.inline("spans"))
    return spans.select("doc_id", "sent_ix", F.col("start").alias("s"), (F.col("end") - 1).alias("e"))


def gaps_of(tokens: Column) -> Column:
    return let(
        F.transform(tokens, F.length),
        lambda n: F.zip_with(
            F.slice(n, F.lit(1), F.size(n) - 1),
            F.slice(n, F.lit(2), F.size(n) - 1),
            lambda a, b: F.abs(a - b).cast("double"),
        ),
    )


def gap_rows(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """``where`` picks sentences by their key, before their clusters are made."""
    rows = sentences(spark, sf_dir)
    return (rows if where is None else rows.filter(where)).select("doc_id", "sent_ix", gaps_of(F.col("tokens")).alias("gaps"))


def clusters(spark: SparkSession, sf_dir: str, where: Column | None = None, packs=False) -> DataFrame:
    return cluster_set(gap_rows(spark, sf_dir, where), packs=packs)


def logits(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    return with_logits(clusters(spark, sf_dir, where))


def with_logits(spans: DataFrame) -> DataFrame:
    base = F.col("s") * 7 + F.col("e") * 13 + F.col("doc_id") * 3 + F.col("sent_ix") * 5
    return spans.withColumn(
        "logits", F.array(*[((base + 11 * k) % 17).cast("double") / 4.0 for k in range(len(LABELS))])
    )


def word_ids_of(tokens: Column) -> Column:
    """``ceil(length / 4)`` subwords per word, padded with -1 to a multiple of 8."""
    ids = F.flatten(
        F.transform(
            tokens, lambda w, i: F.array_repeat(i, F.ceil(F.length(w) / 4.0).cast("int"))
        )
    )
    return let(
        ids,
        lambda x: F.concat(x, F.array_repeat(F.lit(-1), F.pmod(-F.size(x), F.lit(8)))),
    )


def subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).withColumn("word_ids", word_ids_of(F.col("tokens")))


def escape(w: Column) -> Column:
    return F.replace(F.replace(w, F.lit("("), F.lit("-LRB-")), F.lit(")"), F.lit("-RRB-"))


def tree_of(tokens: Column, broken: Column) -> Column:
    """``(TOP (S (NP first half) (VP rest)))``; the last bracket is missing if ``broken``."""

    def leaves(words: Column) -> Column:
        """Words hold no blank, so the brackets are put around all of them at once."""
        text = F.replace(escape(F.array_join(words, " ")), F.lit(" "), F.lit(") (NN "))
        return F.when(F.size(words) == 0, "").otherwise(F.concat(F.lit("(NN "), text, F.lit(")")))

    def body(w: Column) -> Column:
        half = F.floor(F.size(w) / 2).cast("int")
        return F.when(
            F.size(w) == 1, F.concat(F.lit("(TOP (NP "), leaves(w), F.lit(")"))
        ).otherwise(
            F.concat(
                F.lit("(TOP (S (NP "),
                leaves(F.slice(w, F.lit(1), half)),
                F.lit(") (VP "),
                leaves(F.slice(w, half + 1, F.size(w))),
                F.lit("))"),
            )
        )

    return F.concat(let(tokens, body), F.when(broken, F.lit("")).otherwise(F.lit(")")))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = (F.col("doc_id") + F.col("sent_ix")) % 50 == 0
    return sentences(spark, sf_dir).withColumn("tree", tree_of(F.col("tokens"), broken))


def entity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity source rows: split, keys (their order is the row order), tokens, entities."""
    names = F.array(*[F.lit(x) for x in LABELS])
    return annotated(spark, sf_dir).select(
        split_of(F.col("doc_id")).alias("split"),
        "doc_id",
        "sent_ix",
        "tokens",
        F.transform(
            "spans",
            lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), names[x["label"]].alias("type")
            ),
        ).alias("entities"),
    )


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: document_id, sentences[words, named_entities, parse_tree]."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def sentence(piece: Column, i: Column) -> Column:
        broken = (F.col("doc_id") + i) % 50 == 0
        return let(
            words_of(piece),
            lambda w: F.struct(
                w.alias("words"),
                F.transform(w, tag_of).alias("named_entities"),
                F.when(F.size(w) > 0, tree_of(w, broken)).otherwise("").alias("parse_tree"),
            ),
        )

    return docs.select(
        F.col("doc_id").cast("string").alias("document_id"),
        split_of(F.col("doc_id")).alias("split"),
        F.transform(pieces(F.col("text")), sentence).alias("sentences"),
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tokens: sentences of 16 tokens, two tokens a word, four sentences a batch."""
    vec = table(spark, sf_dir, "embeddings")
    sid = F.floor(F.col("vec_id") / 16)
    tok = (F.col("vec_id") % 16).cast("int")
    return vec.select(
        sid.alias("sid"),
        tok.alias("tok_ix"),
        F.floor(tok / 2).cast("int").alias("word_ix"),
        F.floor(sid / 4).alias("batch_id"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("int").alias("label"),
    )


def layer_vectors(spark: SparkSession, sf_dir: str, layers=4, width=16) -> DataFrame:
    tv = token_vectors(spark, sf_dir)
    parts = F.array(
        *[F.struct(F.lit(k).alias("layer"), F.slice("v", k * width + 1, width).alias("v")) for k in range(layers)]
    )
    return tv.select("sid", "tok_ix", "word_ix", "batch_id", F.inline(parts))


def span_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marked span per vector sentence: batch_id, sid, s, e (token, inclusive), label."""
    sids = (
        token_vectors(spark, sf_dir)
        .groupBy("sid")
        .agg(F.max("batch_id").alias("batch_id"), F.max("tok_ix").alias("top"))
    )
    s = F.least(F.col("sid") % 4, F.col("top").cast("bigint")).cast("int")
    return sids.select(
        "batch_id",
        "sid",
        s.alias("s"),
        F.least(s + (F.col("sid") % 17).cast("int"), F.col("top")).alias("e"),
        (F.col("sid") % 3).cast("int").alias("label"),
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the benchmark texts, whole, by item."""
    bench = table(spark, sf_dir, "benchmark")
    rows = bench.select(F.col("item_id").alias("phrase_id"), F.explode(pieces(F.col("text"))).alias("piece"))
    rows = rows.filter(F.replace("piece", F.lit(" "), F.lit("")) != "")
    return rows.select("phrase_id", words_of(F.col("piece")).alias("phrase"))


def treebank_labels(spark: SparkSession) -> DataFrame:
    """A vocabulary of single and joined labels (label, name); joined labels over a lone word
    are not in it."""
    names = ["O", "S", "NP", "VP", "TOP", "NN", "TOP+S", "NP+NN", "VP+NN"]
    return spark.createDataFrame(list(enumerate(names)), "label int, name string")


def weight_rows(spark: SparkSession, layer: int, rows: int, cols: int) -> DataFrame:
    """A weight matrix by rule; column ``cols`` holds the bias."""
    r, c = F.floor(F.col("id") / (cols + 1)), F.col("id") % (cols + 1)
    return spark.range(rows * (cols + 1)).select(
        F.lit(layer).alias("layer"),
        r.cast("int").alias("r"),
        c.cast("int").alias("c"),
        (((r * 31 + c * 17 + layer * 5) % 13 - 6) / 8.0).cast("double").alias("x"),
    )
