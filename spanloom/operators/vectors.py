"""Token and word vectors: pooling, layers, projection, distances, cohesion."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import DISTANCES
from .tables import join_large

# the batch functions travel with the plan, as those of ``functions.scans``
register_pickle_by_value(sys.modules[__name__])

MAX_WEIGHTS = 1 << 26
BLOCK = 256


def pool_words(tokens: DataFrame, keys=("sid",), word="word_ix", v="v") -> DataFrame:
    """Mean of the subword vectors of each word; pads (-1) are skipped."""
    return (
        tokens.filter(F.col(word) >= 0)
        .groupBy(*keys, word)
        .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(v)))).alias(v))
    )


def concat_layers(layers: DataFrame, keys=("sid", "tok_ix"), layer="layer", v="v") -> DataFrame:
    """The vectors of all layers of a token end to end (as many rows as layers per group)."""
    ordered = F.array_sort(F.collect_list(F.struct(layer, v)))
    return layers.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda x: x[v])).alias(v))


def load_layer(weights: DataFrame, layer: int, max_weights: int = MAX_WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """One linear layer (layer, r, c, x; the last column is the bias) as arrays.  The size
    is a property of the model, not of the data, and is checked before it is fetched: a layer
    of more than ``max_weights`` is refused."""
    rows = weights.filter(F.col("layer") == layer)
    n, top_r, top_c = rows.agg(F.count("*"), F.max("r"), F.max("c")).first()
    if not n:
        raise ValueError(f"no weights for layer {layer}")
    if n > max_weights:
        raise ValueError(f"layer {layer} has {n} weights, more than {max_weights}")
    cells = rows.select("r", "c", "x").toPandas()
    full = np.zeros((top_r + 1, top_c + 1))
    full[cells["r"], cells["c"]] = cells["x"]
    return full[:, :-1], full[:, -1]


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, width)


def _lists(m: np.ndarray) -> pa.Array:
    n, width = m.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).ravel()))


def linear(v: Column, *layers: tuple[np.ndarray, np.ndarray]) -> Column:
    """``Wx + b``, with a ReLU between layers, one matrix product per Arrow batch."""

    @F.arrow_udf("array<double>")
    def apply(col: pa.Array) -> pa.Array:
        x = _matrix(col, layers[0][0].shape[1])
        for i, (w, b) in enumerate(layers):
            if i:
                x = np.maximum(x, 0.0)
            x = x @ w.T + b
        return _lists(x)

    return apply(v)


def project_vectors(df: DataFrame, layer: tuple[np.ndarray, np.ndarray], v="v") -> DataFrame:
    return df.withColumn(v, linear(F.col(v), layer))


def pairwise_distance(
    vectors: DataFrame, pairs: DataFrame, metric="euclidean", keys=("sid",), ix="word_ix", v="v"
) -> DataFrame:
    """Distances of the asked pairs (keys, i, j) of a sentence.

    The pairs come from the caller (the chain's neighbours, the words of a span), so a
    sentence's full square is never laid out as rows.  Where all pairs matter,
    ``cohesion`` reduces them block by block."""
    a = vectors.select(*keys, F.col(ix).alias("i"), F.col(v).alias("x"))
    b = vectors.select(*keys, F.col(ix).alias("j"), F.col(v).alias("y"))
    joined = join_large(join_large(pairs, a, [*keys, "i"]), b, [*keys, "j"])
    return joined.select(*keys, "i", "j", DISTANCES[metric](F.col("x"), F.col("y")).alias("d"))


def _block_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        x = x / np.where(nx > 0, nx, 1.0)[:, None]
        y = y / np.where(ny > 0, ny, 1.0)[:, None]
        return 1.0 - x @ y.T
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        out[i] = np.sqrt(((y - row) ** 2).sum(axis=1))
    return out


def _reduce_blocks(metric: str, lead: int):
    """Rows (lead columns incl. s, e at the end, pos_a, va, pos_b, vb) -> lead columns and
    the largest distance, the largest inside the span, the smallest across its border."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            col = {name: batch.column(name) for name in batch.schema.names}
            far, inner, across = [], [], []
            for r in range(batch.num_rows):
                pa_, pb = (np.asarray(col[k][r].values) for k in ("pos_a", "pos_b"))
                va, vb = (
                    np.asarray(col[k][r].values.flatten()).reshape(len(p), -1)
                    for k, p in (("va", pa_), ("vb", pb))
                )
                d = _block_distances(va, vb, metric)
                s, e = col["s"][r].as_py(), col["e"][r].as_py()
                if s is None or e is None:
                    in_a, in_b = np.zeros(len(pa_), bool), np.zeros(len(pb), bool)
                else:
                    in_a, in_b = (pa_ >= s) & (pa_ <= e), (pb >= s) & (pb <= e)
                both, cross = in_a[:, None] & in_b, in_a[:, None] ^ in_b
                far.append(float(d.max()))
                inner.append(float(d[both].max()) if both.any() else 0.0)
                across.append(float(d[cross].min()) if cross.any() else None)
            cols = list(batch.columns)[:lead] + [
                pa.array(c, pa.float64()) for c in (far, inner, across)
            ]
            names = batch.schema.names[:lead] + ["far", "inner", "across"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _summaries(metric: str, key_count: int):
    """Blocks (keys..., blk, pos, vs) -> (keys..., blk, lo, hi, centre, radius).  For the cosine
    the vectors are scaled to unit length; a block with a zero vector has no radius (null)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for pos, vs in zip(batch.column(key_count + 1), batch.column(key_count + 2)):
                at = np.asarray(pos.values)
                x = np.asarray(vs.values.flatten(), np.float64).reshape(len(at), -1)
                wild = False
                if metric == "cosine":
                    norms = np.linalg.norm(x, axis=1)
                    wild = bool((norms == 0).any())
                    x = x / np.where(norms > 0, norms, 1.0)[:, None]
                centre = x.mean(axis=0)
                radius = None if wild else float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
                rows.append((int(at.min()), int(at.max()), centre.tolist(), radius))
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64())
            arrays = [*batch.columns[: key_count + 1], *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[: key_count + 1], "lo", "hi", "centre", "radius"])

    return run


def candidate_pairs(lo, hi, centres, radii, s, e) -> np.ndarray:
    """Which block pairs (upper triangle of a square of booleans) can hold the largest distance
    of the sentence, the largest inside the span [s, e] or the smallest across its border.

    Distances of two blocks lie between d - r - r' and d + r + r', d that of their centres.
    A centre is the mean, so some pair of points is at least d apart, and in one block at
    least r.  Blocks without radius (NaN) are always candidates.  The bounds are widened by
    rounding's share.  Without a span only the largest distance counts."""
    tame = ~np.isnan(radii)
    r = np.where(tame, radii, np.inf)
    d = np.sqrt(np.maximum(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 0.0))
    slack = 1e-9 * (1.0 + d.max(initial=0.0) + (radii[tame].max() if tame.any() else 0.0))
    far = d + r[:, None] + r + slack
    near = np.where(np.isfinite(far), d - r[:, None] - r - slack, -np.inf)
    sure = np.where(np.eye(len(d), dtype=bool), np.where(tame, radii, 0.0)[:, None], d)
    sure = np.where(tame[:, None] & tame, sure, 0.0)  # some pair is at least so far apart
    out = far >= sure.max(initial=0.0)
    if s is not None and e is not None:
        meets, inside = (hi >= s) & (lo <= e), (lo >= s) & (hi <= e)
        both = inside[:, None] & inside
        out |= (meets[:, None] & meets) & (far >= np.where(both, sure, 0.0).max(initial=0.0))
        crossing = meets[:, None] & ~inside | ~inside[:, None] & meets
        certain = inside[:, None] & ~meets | ~meets[:, None] & inside
        out |= crossing & (near <= np.where(certain, far, np.inf).min(initial=np.inf))
    return np.triu(out)


def _chosen_pairs(lead: int):
    """Rows (lead columns incl. s, e, blocks) -> lead columns, ba, bb, pairs (of all)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            take, first, second, of = [], [], [], []
            s_at, e_at = batch.schema.get_field_index("s"), batch.schema.get_field_index("e")
            for i, blocks in enumerate(batch.column(lead).to_pylist()):
                get = lambda c: np.array([np.nan if b[c] is None else b[c] for b in blocks], np.float64)
                centres = np.array([b["centre"] for b in blocks])
                s, e = batch.column(s_at)[i].as_py(), batch.column(e_at)[i].as_py()
                a, b = np.nonzero(candidate_pairs(get("lo"), get("hi"), centres, get("radius"), s, e))
                take += [i] * len(a)
                first += [blocks[k]["blk"] for k in a]
                second += [blocks[k]["blk"] for k in b]
                of += [len(blocks) * (len(blocks) + 1) // 2] * len(a)
            rows = batch.take(pa.array(take, pa.int64()))
            arrays = [*rows.columns[:lead], *(pa.array(c, pa.int64()) for c in (first, second, of))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:lead], "ba", "bb", "pairs"])

    return run


def _fields(df: DataFrame, names) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _token_blocks(vectors: DataFrame, keys, ix, v) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(ix, v)))
    return (
        vectors.groupBy(*keys, F.floor(F.col(ix) / BLOCK).alias("blk"))
        .agg(packed.alias("p"))
        .select(*keys, "blk", F.col(f"p.{ix}").alias("pos"), F.col(f"p.{v}").alias("vs"))
    )


def _pairs_of(examples: DataFrame, blocks: DataFrame, metric: str, keys) -> DataFrame:
    """Per example the block pairs worth computing, and of how many."""
    shape = f"{_fields(blocks, [*keys, 'blk'])}, lo bigint, hi bigint, centre array<double>, radius double"
    cast = blocks.withColumns({"pos": F.col("pos").cast("array<bigint>"), "vs": F.col("vs").cast("array<array<double>>")})
    summary = cast.mapInArrow(_summaries(metric, len(keys)), shape)
    listed = summary.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("blk", "lo", "hi", "centre", "radius"))).alias("__blocks"))
    lead = ["batch_id", *keys, "s", "e"]
    counted = examples.groupBy(*lead).agg(F.count("*").alias("copies"))
    lead.append("copies")
    rows = join_large(counted, listed, keys).select(*lead, "__blocks")
    return rows.mapInArrow(_chosen_pairs(len(lead)), f"{_fields(counted, lead)}, ba bigint, bb bigint, pairs bigint")


def cohesion_work(
    examples: DataFrame, vectors: DataFrame, metric="euclidean", keys=("sid",), ix="tok_ix", v="v"
) -> DataFrame:
    """How much of a sentence's square of blocks ``cohesion_ratio`` computes: batch_id, keys,
    s, e, computed, pairs."""
    pairs = _pairs_of(examples, _token_blocks(vectors, keys, ix, v), metric, keys)
    return pairs.groupBy("batch_id", *keys, "s", "e").agg(F.count("*").alias("computed"), F.max("pairs").alias("pairs"))


def cohesion_ratio(
    examples: DataFrame, vectors: DataFrame, metric="euclidean", keys=("sid",), ix="tok_ix", v="v"
) -> DataFrame:
    """Per batch the mean over its examples of (largest inner distance + 1) / (smallest
    distance from inside to outside + 1); with nothing outside the batch's largest
    distance stands in.  Null for a batch without any marked span.

    ``examples``: batch_id, keys, s, e (inclusive, null = nothing marked).  A sentence's
    tokens are packed in blocks of 256, each with centre and radius.  Of the pairs of blocks
    only those are computed that the triangle inequality leaves a chance
    (``candidate_pairs``), each on its own row, and combined by max and min."""
    blocks = _token_blocks(vectors, keys, ix, v)
    chosen = _pairs_of(examples, blocks, metric, keys)
    a = blocks.select(*keys, F.col("blk").alias("ba"), F.col("pos").alias("pos_a"), F.col("vs").alias("va"))
    b = blocks.select(*keys, F.col("blk").alias("bb"), F.col("pos").alias("pos_b"), F.col("vs").alias("vb"))
    lead = ["batch_id", *keys, "s", "e", "copies"]
    work = join_large(join_large(chosen, a, [*keys, "ba"]), b, [*keys, "bb"])
    work = work.select(*lead, "pos_a", "va", "pos_b", "vb")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields[: len(lead)])
    parts = work.mapInArrow(
        _reduce_blocks(metric, len(lead)), f"{types}, far double, inner double, across double"
    )
    per_example = parts.groupBy(*lead).agg(
        F.max("far").alias("far"), F.max("inner").alias("inner"), F.min("across").alias("across")
    )
    # a batch has as many examples as its size says
    batch_far = F.max("far").over(Window.partitionBy("batch_id"))
    ratio = (F.col("inner") + 1) / (F.coalesce("across", batch_far) + 1)
    return (
        per_example.withColumn("ratio", ratio)
        .withColumn("ratio", F.when(~F.isnan("ratio"), F.col("ratio")))
        .groupBy("batch_id")
        .agg(
            F.when(
                F.count("s") > 0,
                F.sum(F.col("ratio") * F.col("copies"))
                / F.sum(F.when(F.col("ratio").isNotNull(), F.col("copies"))),
            ).alias("loss")
        )
    )


def cohesion_entities_only(
    examples: DataFrame, vectors: DataFrame, metric="euclidean", keys=("sid",), ix="tok_ix", v="v"
) -> DataFrame:
    """The same over examples whose label is not O; null for a batch with none."""
    batches = examples.select("batch_id").distinct()
    losses = cohesion_ratio(examples.filter(F.col("label") != 0), vectors, metric, keys, ix, v)
    return batches.join(losses, "batch_id", "left")


def span_features(
    spans: DataFrame, vectors: DataFrame, keys=("sid",), ix="tok_ix", v="v"
) -> DataFrame:
    """Vectors of each span's first and last token, end to end, from vectors of the plain
    text.  Every span has both, also one that ends its sentence."""
    at_start = vectors.select(*keys, F.col(ix).alias("s"), F.col(v).alias("v_start"))
    at_end = vectors.select(*keys, F.col(ix).alias("e"), F.col(v).alias("v_end"))
    return (
        join_large(join_large(spans, at_start, [*keys, "s"]), at_end, [*keys, "e"])
        .withColumn("features", F.concat("v_start", "v_end"))
        .drop("v_start", "v_end")
    )


def marked_span_features(
    spans: DataFrame, vectors: DataFrame, keys=("sid",), ix="tok_ix", v="v"
) -> DataFrame:
    """The same from vectors of the marked text, one text per span (keys, s, e, position):
    the start marker sits at position s, the end marker at e + 2, both always there."""
    span = [*keys, "s", "e"]
    at = F.when(F.col(ix) == F.col("s"), 0).when(F.col(ix) == F.col("e") + 2, 1)
    ends = vectors.withColumn("__at", at).filter("__at IS NOT NULL")
    both = ends.groupBy(*span).agg(F.array_sort(F.collect_list(F.struct("__at", v))).alias("__b"))
    features = both.select(*span, F.flatten(F.transform("__b", lambda x: x[v])).alias("features"))
    return join_large(spans, features, span)


def score_spans(features: DataFrame, hidden, out, column="features") -> DataFrame:
    """Logits of the two-layer head: linear, ReLU, linear."""
    return features.withColumn("logits", linear(F.col(column), hidden, out))
