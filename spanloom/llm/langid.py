"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, text_of

#: Bound of the labelled sample that the classifier is fitted on (rows), its smallest hashes.
SAMPLE_ROWS = 6000
#: Of a longer text the sample holds so many characters, which bounds its size on the driver.
SAMPLE_CHARS = 20_000
#: The most frequent languages that are learned.
MAX_LANGUAGES = 1000
BUCKETS = 1 << 16
DIM = 16
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 20  # characters whose subwords are summed at once
UNKNOWN = "und"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def letters(text: str) -> np.ndarray:
    """Code points in lower case; all that is not a letter is one blank between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return points
    kinds, place = np.unique(points, return_inverse=True)
    alpha = np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))[place]
    points = np.where(alpha, points, 32)
    keep = np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))
    return points[keep]


def subwords(points: np.ndarray) -> np.ndarray:
    """Buckets of all character n-grams of the orders that span no more than one blank at
    either end (so a word's borders are part of it)."""
    x = np.concatenate(([32], points, [32])).astype(np.uint64)
    blank = x == 32
    out = []
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        inner = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ x[k : k + m]) * np.uint64(MULTIPLIERS[k])
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1 or n == 1:
                inner |= blank[k : k + m]
        h = (h + np.uint64(n)) * np.uint64(MULTIPLIERS[0])
        out.append((h >> np.uint64(64 - 16))[~inner].astype(np.int64) % BUCKETS)
    return np.concatenate(out) if out else np.empty(0, np.int64)


@dataclass
class Model:
    """``table``: bucket -> logits, the product of embeddings and output weights, since the
    mean of embeddings times weights is the mean of the products.  ``bias``, the classes,
    the ``temperature`` of calibration and the ``threshold`` of rejection."""

    table: np.ndarray
    bias: np.ndarray
    classes: list[str]
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        """None if the text has no letter."""
        points = letters(text)
        if not (points != 32).any():
            return None
        total, count = np.zeros(len(self.classes)), 0
        for i in range(0, len(points), PIECE):
            b = subwords(points[max(0, i - max(ORDERS) + 1) : i + PIECE] if i else points[:PIECE])
            counts = np.bincount(b, minlength=0)
            used = np.flatnonzero(counts)
            total += counts[used] @ self.table[used]
            count += len(b)
        return total / max(count, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is accepted."""
        z = self.logits(text) if text else None
        if z is None:
            return UNKNOWN, 0.0, False
        if len(self.classes) == 1:
            return self.classes[0], 1.0, True
        p = softmax(z / self.temperature)
        return self.classes[int(p.argmax())], float(p.max()), bool(p.max() >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 1, accept: float = 0.99) -> Model:
    """Stochastic gradient descent over shuffled documents.

    A fifth of the documents is kept out of the descent: on it the temperature is chosen (by
    log loss) and the threshold of rejection, the smallest probability from which on a share
    ``accept`` of the answers is right.  Classes in sorted order; ties go to the first."""
    classes = sorted(set(langs))
    if not classes:
        return Model(np.zeros((BUCKETS, 1)), np.zeros(1), [])
    rng = np.random.default_rng(seed)
    docs = []
    for t, lang in zip(texts, langs):
        points = letters(t)
        if (points != 32).any():
            docs.append((*np.unique(subwords(points), return_counts=True), classes.index(lang)))
    order = rng.permutation(len(docs))
    held, train = [docs[i] for i in order[: len(docs) // 5]], [docs[i] for i in order[len(docs) // 5 :]]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, len(classes)))
    bias = np.zeros(len(classes))
    steps, done = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            b, c, y = train[i]
            lr = rate * (1 - done / steps)
            done += 1
            share = c / c.sum()
            hidden = share @ emb[b]
            g = softmax(hidden @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= lr * np.outer(hidden, g)
            bias -= lr * 0.1 * g
            emb[b] -= lr * len(b) ** 0.5 * share[:, None] * back[None, :]
    model = Model(emb @ out, bias, classes)
    if held:
        z = np.array([(c / c.sum()) @ model.table[b] + bias for b, c, _ in held])
        y = np.array([d[2] for d in held])
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min((loss(t), t) for t in np.geomspace(0.05, 20, 60))[1])
        p = softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        rank = np.argsort(-top, kind="stable")
        good = np.flatnonzero(np.cumsum(right[rank]) / np.arange(1, len(y) + 1) >= accept)
        model.threshold = float(top[rank][good[-1]]) if len(good) else 1.0
    return model


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", lang: str = "lang") -> tuple[list, list]:
    """At most ``rows`` labelled texts, distinct in their language and equally many of each
    language if it has them: those with the smallest hashes of their content.

    A first pass counts rows and distinct texts of the languages; the second keeps by hash
    about twice the texts that are wanted and reduces their copies to one (language, hash)
    before anything is exchanged; the third fetches the texts of the chosen hashes."""
    from pyspark.sql import Window

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.substring(text, 1, SAMPLE_CHARS).alias("text"))
    counted = known.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("h", 0.02).alias("texts"))
    counts = {r["lang"]: r["texts"] for r in counted.orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return [], []
    quota = max(1, rows // len(counts))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * quota + 50) / max(n, 1)))))
    place = F.pmod("h", F.lit(1 << 30))
    picked = known.filter(place / (1 << 30) < F.try_element_at(share, F.col("lang"))).groupBy("lang", "h").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    chosen = picked.withColumn("r", rank).filter(F.col("r") <= quota).select("lang", "h")
    found = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    out = found.orderBy("h", "lang").collect()
    return [r["text"] for r in out], [r["lang"] for r in out]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus ``lang_pred``, ``score`` and ``accepted``.

    The answer is a language that was learned, or ``und`` with score 0 if the text is null or
    has no letter (or nothing was learned); ``accepted`` is false where the calibrated
    probability is below the threshold.  Whole texts are read, in pieces; repeated rows get
    equal answers; an empty table gives an empty one."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score", "accepted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x classes numbers

    def start():
        m = shared.value
        return lambda texts: tuple(zip(*(m.predict(t) if m.classes else (UNKNOWN, 0.0, False) for t in texts)))

    rows = docs.select(*kept, text_of(text).alias("__t"))
    fields = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "accepted": ("boolean", pa.bool_())}
    return appended(rows, kept, ["__t"], fields, start)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*labelled_sample(docs.filter(~held_out())))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
