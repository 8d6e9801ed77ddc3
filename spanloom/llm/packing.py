"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import appended, running_base, text_of, written

WINDOW = 2048
END = 1  # id that closes a document
LEAST_PIECE = 16  # tokens: a source waits until its deficit allows so many
BLOCK_ROUNDS = 32
TEXTS_AT_ONCE = 1024
CACHED_CHUNKS = 1 << 18  # some 60 MB, held by an idle worker too
CACHED_LENGTH = 48
#: Punctuation after a word's last letter or digit (of those that stay one character when
#: lowered): a word of its own for the tokenizer, too.
TAIL = re.compile(r"(?<=[a-z0-9À-ÖØ-öø-ÿ])([.,!?;:#*$%&|]+)(?=[ \n\t\r]|\Z)")

LETTERS = re.compile("[a-z]+")

_known: dict[str, Chunks] = {}  # per tokenizer file, in a worker: the tokenizer and its chunks


def chunks_of(text: str) -> list[str]:
    """Parts of a text whose ids, one after the other, are the text's.

    White space parts words; letters A-Z are lowered and end punctuation split off first, as
    the tokenizer does itself, so that fewer chunks differ.  A text that may hold special
    tokens is only parted."""
    if "<|" not in text:
        text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        text = TAIL.sub(r" \1", text)
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Chunks:
    """Ids of chunks; frequent ones are kept, up to a fixed number."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = sorted((t.content, i) for i, t in self.tok.get_added_tokens_decoder().items() if t.special)
        self.mark = special[0] if special else None
        self.kept: dict[str, bytes] = {"": b""}
        # words of a-z go straight to the model if normalizer and pre-tokenizer leave them whole
        probe = "abcdefghijklmnopqrstuvwxyz"
        first, second = self.tok.normalizer, self.tok.pre_tokenizer
        self.direct = (first is None or first.normalize_str(probe) == probe) and (
            second is not None and [x for x, _ in second.pre_tokenize_str(probe)] == [probe]
        )

    def fresh(self, chunks: list[str]) -> dict[str, bytes]:
        import numpy as np

        out: dict[str, bytes] = {}
        if self.direct:
            model = self.tok.model
            for c in chunks:
                if LETTERS.fullmatch(c):
                    out[c] = b"".join(t.id.to_bytes(4, "little") for t in model.tokenize(c))
        plain = [c for c in chunks if "<|" not in c and c not in out] if self.mark else []
        for i in range(0, len(plain), 4096):  # many chunks in one call, parted by a special token
            some = plain[i : i + 4096]
            ids = np.asarray(self.tok.encode(self.mark[0].join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[1])
            starts = np.concatenate(([0], cuts + 1)).tolist()
            raw = ids.tobytes()
            out.update((c, raw[4 * a : 4 * z]) for c, a, z in zip(some, starts, [*cuts.tolist(), len(ids)]))
        rest = [c for c in chunks if c not in out]
        for c, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            out[c] = np.asarray(e.ids, "<u4").tobytes()
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        parted = [chunks_of(t) for t in texts]
        wanted = set().union(*parted)
        missing = [c for c in wanted if c not in self.kept]
        known = self.kept
        if missing:
            new = self.fresh(missing)
            room = CACHED_CHUNKS - len(known)
            known.update((c, v) for c, v in list(new.items())[:room] if len(c) <= CACHED_LENGTH)
            if any(c not in known for c in missing):
                known = {**{c: known[c] for c in wanted if c in known}, **new}
        return [b"".join(map(known.__getitem__, p)) for p in parted]


def chunks_for(path: str) -> Chunks:
    """The worker's chunks of a tokenizer, made once."""
    if path not in _known:
        _known[path] = Chunks(path)
    return _known[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``ids`` (little-endian unsigned 32-bit ids, then the
    closing id) and ``n``, their number; ``__part`` and ``__at``: the task, and the tokens of
    the same source before the document in it.

    White space parts the tokenizer's words, so the ids of a text are those of its chunks in
    turn; a task keeps the ids of frequent chunks, in a table of bounded size."""
    kept = [c for c in docs.columns if c != text]
    path = path or tokenizer_path()

    def start():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        chunks, part, at = chunks_for(path), TaskContext.get().partitionId(), {}
        closing = END.to_bytes(4, "little")

        def make(texts: list[str], sources: list[str]) -> tuple:
            ids: list[bytes] = []
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                ids += [x + closing for x in chunks.ids(texts[i : i + TEXTS_AT_ONCE])]
            before = []
            for source, x in zip(sources, ids):
                before.append(at.get(source, 0))
                at[source] = before[-1] + len(x) // 4
            return sources, ids, [len(x) // 4 for x in ids], [part] * len(ids), before

        return make

    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    rows = docs.select(*kept, key.alias("__key"), text_of(text).alias("__t"))
    long = ("long", pa.int64())
    fields = {"__s": ("string", pa.string()), "ids": ("binary", pa.binary()), "n": long, "__part": long, "__at": long}
    return appended(rows, kept, ["__t", "__key"], fields, start)


def quanta(tokens: DataFrame, weights: Mapping[str | None, float] | None, window: int) -> DataFrame:
    """Per source (``__s``): ``__q`` tokens per round, ``__m`` tokens per turn, ``__phase``.

    A round is one window; a source's share of it is its weight's, by default its share of
    all tokens, which is the only mixture that every window can have to the last.  One row
    per source."""
    sums = tokens.groupBy("__s").agg(F.sum("n").alias("__sum"))
    weight = F.col("__sum").cast("double")
    if weights is not None:
        weight = F.lit(None).cast("double")
        for source, w in weights.items():
            weight = F.when(F.col("__s") == ("-" if source is None else f"+{source}"), F.lit(float(w))).otherwise(weight)
        weight = F.coalesce(weight, F.lit(1.0))
    rows = sums.withColumn("__w", weight)
    q = F.lit(window) * F.col("__w") / F.sum("__w").over(Window.partitionBy(F.lit(0)))
    phase = F.pmod(F.xxhash64("__s"), F.lit(1024)) / 1024
    rows = rows.withColumn("__q", q).withColumn("__m", F.greatest("__q", F.lit(float(LEAST_PIECE))))
    return rows.select("__s", "__q", "__m", F.when(F.col("__m") > F.col("__q"), phase).otherwise(0.0).alias("__phase"))


def pack(
    docs: DataFrame, window: int = WINDOW, weights: Mapping[str | None, float] | None = None, path: str | None = None
) -> DataFrame:
    """Packs whole documents into windows of ``window`` tokens, one row per piece.

    All columns of ``docs`` but the text, plus ``start`` and ``length`` (tokens of the
    document before the piece, and in it), ``ids`` (the piece's ids), ``doc_tokens``,
    ``sequence_id`` and ``offset``.  Only the last window can be short.

    Deficit round-robin: each round adds a source's quantum to its deficit, and the source
    sends as many tokens of its queue as the deficit holds, at least ``LEAST_PIECE`` at a
    turn; the rest is carried to the next round.  The deficits have a closed form: turn p of a
    source holds its tokens [floor(p m), floor((p + 1) m)) and falls into round
    floor((p + phase) m / q).  So each document is cut on its own, wherever it lies, and
    deficits carry over windows and partitions.  A source that runs dry leaves its share to
    the others.  The place of a piece in the stream of all rounds is a running sum: within
    blocks of rounds, plus the sums of blocks before.

    A null or empty text is one closing id; a null source is a queue of its own; repeated
    rows are packed each; a text of any length is tokenized whole; an empty table gives an
    empty one; columns of ``docs`` with the names of new ones give way to them.  The tokens are
    written once to the shared folder and exchanged once."""
    made = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    names = [c for c in docs.columns if c != "text" and c not in made]
    carried = [F.col(c).alias(f"__c{i}") for i, c in enumerate(names)]
    tokens = written(tokenized(docs.select(*carried, "source", "text"), path).drop("source"), "tokens")
    totals = tokens.groupBy("__s", "__part").agg(F.sum("n").alias("__n"))
    base = running_base(totals, "__part", "__n", by=("__s",))
    # written, so that Spark knows its size and the tokens need no exchange to meet it
    plan = written(base.join(quanta(tokens, weights, window), "__s"), "plan")
    kept = [f"__c{i}" for i in range(len(names))]

    rows = tokens.join(plan, ["__s", "__part"]).withColumn("__a", F.col("base") + F.col("__at"))
    m, a, n = F.col("__m"), F.col("__a"), F.col("n")
    turns = F.sequence(F.greatest(F.floor(a / m) - 1, F.lit(0)), F.floor((a + n) / m) + 1)
    rows = rows.withColumn("__p", F.explode(turns))
    lo = F.greatest(F.floor(F.col("__p") * m), a)
    hi = F.least(F.floor((F.col("__p") + 1) * m), a + n)
    rows = rows.withColumns({"__lo": lo, "__len": hi - lo}).filter("__len > 0")
    cut = lambda ids, start, length: F.substring(ids, (start * 4 + 1).cast("int"), (length * 4).cast("int"))
    rows = rows.select(
        *kept, "__s", n.alias("doc_tokens"), "__lo", (F.col("__lo") - a).alias("start"), F.col("__len").alias("length"),
        cut(F.col("ids"), F.col("__lo") - a, F.col("__len")).alias("ids"),
        F.floor((F.col("__p") + F.col("__phase")) * m / F.col("__q")).alias("__round"),
    )
    rows = rows.withColumn("__block", F.floor(F.col("__round") / BLOCK_ROUNDS).cast("long"))

    sums = rows.groupBy("__block").agg(F.sum("length").alias("__n"))
    inside = Window.partitionBy("__block").orderBy("__round", "__s", "__lo")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("length").over(before), F.lit(0)))
    rows = rows.join(running_base(sums, "__block", "__n"), "__block").withColumn("__g", F.col("__in") + F.col("base"))

    g, length = F.col("__g"), F.col("length")
    span = F.sequence(F.floor(g / window), F.floor((g + length - 1) / window))
    rows = rows.withColumn("sequence_id", F.explode(span))
    lo = F.greatest(g, F.col("sequence_id") * window)
    rows = rows.withColumns({"__lo": lo, "__len": F.least(g + length, (F.col("sequence_id") + 1) * window) - lo})
    skip = F.col("__lo") - g
    return rows.select(
        *(F.col(k).alias(c) for k, c in zip(kept, names)), (F.col("start") + skip).alias("start"), F.col("__len").alias("length"),
        cut(F.col("ids"), skip, F.col("__len")).alias("ids"), "doc_tokens", "sequence_id",
        (F.col("__lo") % window).alias("offset"),
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    rows = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return rows.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )
