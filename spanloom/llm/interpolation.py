"""Deleted interpolation: n-gram estimates mixed by context-frequency buckets.

Texts become segments of word numbers; what is counted and looked up travels as sorted arrays
of 64-bit n-gram hashes, one array per segment and hash range, already summed.  So a
frequent word costs one number per segment, and no task sees more than one range."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

ORDER = 2
SEGMENT_TOKENS = 2_000_000
RANGE_TOKENS = 500_000
ITERATIONS = 12
BUCKETS = 64
MAIN, DEV, TEST = 0, 1, 2
DEV_PARTS = 10  # one in so many training documents is held out for the weights
#: Fixed word numbers of a segment: the end of a text, and what stands before it.
END, START = 0, 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


SPECIAL = [word_hash(b"\n"), word_hash(b"\t")]  # no word holds white space


def segments(docs: DataFrame, role: Column, id_col: str, text: str = "text") -> DataFrame:
    """Rows of about ``SEGMENT_TOKENS`` tokens of documents with one role: ``ids`` (32-bit word
    numbers, an ``END`` after each text), ``vocab`` (the hash of each number), ``doc`` and
    ``lens`` (tokens per document)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        blank = lambda: {"words": {b"\n": END, b"\t": START}, "ids": [], "doc": [], "lens": [], "n": 0}
        open_ = {}

        def closed(role: int, s: dict) -> pd.DataFrame:
            nonlocal made
            made += 1
            vocab = np.array(SPECIAL + [word_hash(w) for w in s["words"]][2:], "<u8")
            row = {
                "seg": (part << 24) | made, "role": role, "n": s["n"], "doc": s["doc"], "lens": s["lens"],
                "ids": np.concatenate(s["ids"]).tobytes(), "vocab": vocab.tobytes(),
            }
            return pd.DataFrame([row])

        for b in batches:
            for doc, role, t in zip(b["doc"].tolist(), b["role"].tolist(), b["t"]):
                s = open_.setdefault(role, blank())
                words = s["words"]
                found = [words.setdefault(w, len(words)) for w in t.encode("utf-8", "surrogatepass").lower().split()]
                found.append(END)
                s["ids"].append(np.array(found, "<u4"))
                s["doc"].append(doc)
                s["lens"].append(len(found))
                s["n"] += len(found)
                if s["n"] >= SEGMENT_TOKENS:
                    yield closed(role, open_.pop(role))
        for role, s in open_.items():
            yield closed(role, s)

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc"), role.cast("int").alias("role"), text_of(text).alias("t"))
    return rows.mapInPandas(
        run, "seg long, role int, n long, doc array<string>, lens array<int>, ids binary, vocab binary"
    )


def grams(ids: bytes, lens: np.ndarray, vocab: bytes, order: int) -> list[np.ndarray]:
    """Per order the hash of the n-gram that ends at each token; 0 where a text has no such
    history (its first token has one token before it, the start)."""
    x = np.frombuffer(ids, "<u4").astype(np.int64)
    h = np.frombuffer(vocab, "<u8").astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
    place = np.arange(len(x)) - np.repeat(starts, lens)  # of a token in its text
    before = h[np.concatenate(([START], x[:-1]))] if len(x) else h[:0]
    before[place == 0] = h[START]
    out = [h[x]]
    for n in range(2, order + 1):
        # the previous token's shorter gram, or just the start
        last = before if n == 2 else np.concatenate((np.zeros(1, np.uint64), out[-1][:-1]))
        if n > 2:
            last[place < n - 2] = 0
        mixed = (last * np.uint64(0x9E3779B97F4A7C15)) ^ (h[x] + np.uint64(n))
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed[last == 0] = 0
        out.append(mixed)
    return out


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _asked(order: int, bits: int):
    """Segment -> its distinct n-grams and their counts, one row per order and hash range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b.itertuples():
                rows = []
                for n, g in enumerate(grams(s.ids, np.asarray(s.lens), s.vocab, order), 1):
                    keys, counts = np.unique(g, return_counts=True)
                    at = _ranges(keys, bits)
                    names, cuts = np.unique(at, return_index=True)
                    for r, i, j in zip(names.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                        rows.append((n, r, s.seg, s.role, keys[i:j].astype("<u8").tobytes(), counts[i:j].astype("<u4").tobytes()))
                yield pd.DataFrame(rows, columns=["n", "rng", "seg", "role", "keys", "counts"])

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """All segments' n-grams of one order and hash range -> to each segment, in the order
    that it asked, their counts in the main part and in all training text.  The first row also
    gets the number of types and tokens of the range."""
    keys = [np.frombuffer(k, "<u8") for k in group["keys"]]
    counts = [np.frombuffer(c, "<u4").astype(np.int64) for c in group["counts"]]
    role = np.repeat(group["role"].to_numpy(), [len(k) for k in keys])
    names, place = np.unique(np.concatenate(keys), return_inverse=True)
    amount = np.concatenate(counts)
    total = lambda r: np.bincount(place, np.where(role == r, amount, 0), len(names)).astype("<i8")
    main, dev = total(MAIN), total(DEV)
    both = main + dev
    cuts = np.cumsum([0, *map(len, keys)])
    part = lambda a: [a[place[i:j]].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
    first = [1] + [0] * (len(group) - 1)
    return pd.DataFrame(
        {
            "n": group["n"], "rng": group["rng"], "seg": group["seg"], "role": group["role"],
            "main": part(main), "train": part(both),
            "types": [int((both > 0).sum()) * f for f in first], "tokens": [int(both.sum()) * f for f in first],
            "main_types": [int((main > 0).sum()) * f for f in first], "main_tokens": [int(main.sum()) * f for f in first],
        }
    )


def _looked_up(s: pd.Series, found: pd.DataFrame, column: str, order: int, docs: float) -> tuple[list, list]:
    """Per order the counts of each token's n-gram and of its context."""
    gs = grams(s.ids, np.asarray(s.lens), s.vocab, order)
    counts = []
    for n, g in enumerate(gs, 1):
        rows = found[found["n"] == n].sort_values("rng")
        table = np.concatenate([np.frombuffer(c, "<i8") for c in rows[column]])
        _, place = np.unique(g, return_inverse=True)
        counts.append(np.where(g == 0, 0, table[place]) if n > 1 else table[place])
    lens = np.asarray(s.lens)
    first = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
    contexts = [None]
    for n in range(2, order + 1):
        c = np.concatenate(([0], counts[n - 2][:-1]))
        c[first] = docs if n == 2 else 0  # the start is seen once a text
        contexts.append(c)
    return counts, contexts


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Contexts by frequency: 0, 1, 2-3, 4-7, ..."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _events(order: int, docs: float):
    """Held-out tokens as distinct tuples of counts."""
    names = ["c1"] + [x for n in range(2, order + 1) for x in (f"h{n}", f"c{n}")]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s in left.itertuples():
            counts, contexts = _looked_up(s, right, "main", order, docs)
            cols = [counts[0]] + [x for n in range(2, order + 1) for x in (contexts[n - 1], counts[n - 1])]
            tuples, many = np.unique(np.stack(cols, axis=1), axis=0, return_counts=True)
            rows.append(pd.DataFrame(tuples, columns=names).assign(many=many))
        return pd.concat(rows)

    return run, names


def learn_weights(events: DataFrame, order: int, types: int, tokens: int, iterations: int = ITERATIONS) -> dict:
    """Weights by order and context bucket, by expectation-maximisation on held-out counts.

    P_n = w_n(bucket of the context) f_n + (1 - w_n) P_(n-1), down to the uniform
    1 / (types + 1).  An iteration is one aggregation of the distinct events: of each order's
    share of the probability that is left to it.  A bucket without events has the weight of
    the next smaller one that has some (0 for a context that was never seen)."""
    f = {0: F.lit(1.0 / (types + 1)), 1: F.col("c1") / max(tokens, 1)}
    bucket = {1: F.lit(0)}
    for n in range(2, order + 1):
        h = F.col(f"h{n}")
        f[n] = F.when(h > 0, F.col(f"c{n}") / h).otherwise(0.0)
        bucket[n] = F.when(h > 0, F.floor(F.log2(h)).cast("int") + 1).otherwise(0)
    weights = {n: np.where(np.arange(BUCKETS) > 0, 0.5, 0.5 if n == 1 else 0.0) for n in range(1, order + 1)}
    for _ in range(iterations):
        # probability mass that stays with orders up to n
        upto = {0: f[0]}
        lam = {n: F.element_at(F.array(*(F.lit(float(w)) for w in weights[n])), bucket[n] + 1) for n in weights}
        for n in range(1, order + 1):
            upto[n] = lam[n] * f[n] + (1 - lam[n]) * upto[n - 1]
        reach, stats = F.lit(1.0), []
        for n in range(order, 0, -1):
            got, left = reach * lam[n] * f[n] / upto[order], reach * upto[n] / upto[order]
            stats.append(F.struct(F.lit(n).alias("n"), bucket[n].alias("b"), got.alias("got"), left.alias("left")))
            reach = reach * (1 - lam[n])
        rows = events.select(F.explode(F.array(*stats)).alias("s"), "many").groupBy("s.n", "s.b")
        sums = rows.agg(F.sum(F.col("s.got") * F.col("many")).alias("g"), F.sum(F.col("s.left") * F.col("many")).alias("l"))
        new = {n: np.full(BUCKETS, np.nan) for n in weights}
        for r in sums.collect():  # one row per order and bucket
            if r["l"]:
                new[r["n"]][r["b"]] = r["g"] / r["l"]
        for n in weights:
            last = weights[n][0]
            for b in range(BUCKETS):
                last = new[n][b] = last if math.isnan(new[n][b]) else new[n][b]
            weights[n] = np.clip(new[n], 0.0, 1 - 1e-6)
    return weights


def _scores(order: int, docs: float, types: int, tokens: int, weights: dict):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in left.itertuples():
            counts, contexts = _looked_up(s, right, "train", order, docs)
            p = np.full(len(counts[0]), 1.0 / (types + 1))
            for n in range(1, order + 1):
                h = np.full(len(p), tokens) if n == 1 else contexts[n - 1]
                w = weights[n][0 if n == 1 else np.minimum(bucket_of(h), BUCKETS - 1)]
                p = w * np.where(h > 0, counts[n - 1] / np.maximum(h, 1), 0.0) + (1 - w) * p
            lens = np.asarray(s.lens, np.int64)
            cuts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            per = lambda x: np.add.reduceat(x, cuts)
            base = np.log10((counts[0] + 1) / (tokens + types + 1))
            out.append(pd.DataFrame({
                "doc": list(s.doc), "held_out": s.role == TEST,
                "n_tokens": lens, "n_known": per((counts[0] > 0).astype(np.int64)), "train_tokens": tokens,
                "base_score": per(base), "score": per(np.log10(p)),
            }))
        return pd.concat(out)

    return run


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """log10 probability of every whole text under a model of the texts not ``held_out``.

    Per document: the id (as a long), ``held_out``, ``n_tokens`` (words and one end),
    ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score`` (add-one unigrams)
    and ``score``.  The weights are learned on one in ten training documents, chosen by a hash
    of id and text, against counts of the others; scores then use the counts of both.

    A null or blank text is one end; null ids and repeated rows are scored each; a null
    ``held_out`` counts as false; with no training text every token is unknown.  Words are
    told apart by 64-bit hashes.  Segments, counts and events are written to the shared
    folder; an empty table gives an empty one."""
    test = F.coalesce(held_out, F.lit(False))
    dev = F.pmod(F.xxhash64(id_col, text, F.lit("held-out counts")), F.lit(DEV_PARTS)) == 0
    role = F.when(test, TEST).when(dev, DEV).otherwise(MAIN)
    segs = written(segments(docs, role, id_col, text), "segments")
    size = segs.agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / RANGE_TOKENS))))
    asked = segs.select("seg", "role", "lens", "ids", "vocab").mapInPandas(
        _asked(order, bits), "n int, rng long, seg long, role int, keys binary, counts binary"
    )
    counted = written(
        asked.groupBy("n", "rng").applyInPandas(
            _summed,
            "n int, rng long, seg long, role int, main binary, train binary, types long, tokens long, "
            "main_types long, main_tokens long",
        ),
        "counts",
    )
    sums = counted.filter("n = 1").agg(*(F.sum(c).alias(c) for c in ("types", "tokens", "main_types", "main_tokens"))).first()
    types, tokens, main_types, main_tokens = (sums[c] or 0 for c in ("types", "tokens", "main_types", "main_tokens"))
    texts = segs.groupBy("role").agg(F.sum(F.size("doc")).alias("d")).collect()  # three rows
    n_docs = {r["role"]: r["d"] for r in texts}

    run, names = _events(order, n_docs.get(MAIN, 0))
    pair = lambda a, b: a.groupBy("seg").cogroup(b.groupBy("seg"))
    columns = ["seg", "role", "lens", "ids", "vocab", "doc"]
    dev_rows = pair(segs.filter(F.col("role") == DEV).select(columns), counted.filter(F.col("role") == DEV).select("seg", "n", "rng", "main"))
    events = dev_rows.applyInPandas(run, ", ".join(f"{c} long" for c in [*names, "many"]))
    events = written(events.groupBy(*names).agg(F.sum("many").alias("many")), "events")
    weights = learn_weights(events, order, main_types, main_tokens, iterations)

    final = _scores(order, n_docs.get(MAIN, 0) + n_docs.get(DEV, 0), types, tokens, weights)
    rows = pair(segs.select(columns), counted.select("seg", "n", "rng", "train")).applyInPandas(
        final,
        "doc string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return rows.withColumn("doc", F.col("doc").cast("long")).withColumnRenamed("doc", id_col)


def op2_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
