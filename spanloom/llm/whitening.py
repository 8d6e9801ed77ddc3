"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Y has the centred rows.  From a unit vector v_1 the recurrence

    a_j u_j = Y v_j - b_(j-1) u_(j-1)        b_j v_(j+1) = Y' u_j - a_j v_j

gives orthonormal u and v with Y V = U B, B bidiagonal.  The right singular vectors of B,
turned by V, are the components; its singular values give their deviations.  A step is one
distributed scan: a row's entries of Y v, of all earlier u and its share of Y'u are made
together and only sums of a few hundred numbers leave a task.  The long u vectors are never
stored: u_j = Y h_j with a short h_j, so a lost executor costs a task of the current scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Rows of a packed block.
BLOCK_ROWS = 2048
#: So many tasks send their sums of a scan to the driver directly.
DIRECT_PARTS = 256
#: A singular triplet has converged when its residual is below this share of the largest
#: singular value; a recurrence coefficient below BREAKDOWN of it is a zero.
CONVERGED, BREAKDOWN = 1e-13, 1e-12


def whole_numbers(v: Column) -> Column:
    """x = floor(1024 c) + 100000 per entry; null if the vector is null or empty or has a null
    or non-finite entry."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long") + SHIFT)
    return F.when(F.coalesce(fine & (F.size(v) > 0), F.lit(False)), whole)


@dataclass
class Model:
    """n vectors with per-dimension sums S; ``components`` has unit rows by falling eigenvalue,
    ``values`` the eigenvalues of the covariance (divisor n), ``trace`` their whole sum."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    steps: int = 0
    identity_error: float = 0.0

    @property
    def mean_parts(self) -> tuple[np.ndarray, np.ndarray]:
        """S // n and (S mod n) / n: centring on integers keeps the digits after the point."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return whole, part


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of at most BLOCK_ROWS vectors as bytes, so that a scan reads them as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), width)
            blocks = [x[i : i + BLOCK_ROWS].astype("<i8").tobytes() for i in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["x"])

    return rows.mapInArrow(run, "x binary")


def _summed(packed: DataFrame, width: int, size: int, part) -> np.ndarray:
    """The sum of ``part(rows)``, an array of ``size`` numbers, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                total += part(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["p"])

    rows = packed.mapInArrow(run, "p array<double>")  # one row a task
    if packed.rdd.getNumPartitions() > DIRECT_PARTS:  # summed by Spark first
        sums = rows.select(F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        rows = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("p"))
    return np.sum([np.zeros(size), *(r["p"] for r in rows.collect())], axis=0)


def _fresh(rng: np.random.Generator, basis: list[np.ndarray], width: int) -> np.ndarray:
    """A random unit vector at right angles to the basis."""
    return _orthogonal(rng.standard_normal(width), basis, unit=True)[0]


def _orthogonal(v: np.ndarray, basis: list[np.ndarray], unit=False) -> tuple[np.ndarray, float]:
    """``v`` without its parts in the basis, taken off twice, and its length."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    length = float(np.linalg.norm(v))
    return (v / length if unit and length > 0 else v), length


def _bidiagonalised(packed: DataFrame, width: int, model: Model, k: int, seed: int) -> None:
    """Fill in components, values and trace."""
    whole, frac = model.mean_parts
    rng = np.random.default_rng(seed)

    def scan(g: np.ndarray, hs: list[np.ndarray], trace=False):
        """|Y g|^2, U'Y g for U = Y hs, Y'Y g, and the sum of all squares."""
        m = len(hs)
        maps = np.array([g, *hs]).T

        def part(x: np.ndarray) -> np.ndarray:
            y = (x - whole) - frac
            p = y @ maps
            q = p[:, 0]
            return np.concatenate([[q @ q], p[:, 1:].T @ q, y.T @ q, [np.einsum("ij,ij->", y, y) if trace else 0.0]])

        s = _summed(packed, width, width + m + 2, part)
        return s[0], s[1 : 1 + m], s[1 + m : -1], s[-1]

    vs, hs, zs, alphas, betas = [_fresh(rng, [], width)], [], [], [], []
    at: list[int] = []  # the step of each h
    top = 0.0
    while True:
        j = len(alphas)
        g = vs[j] - (betas[j - 1] * hs[-1] if j and betas[j - 1] and at[-1] == j - 1 else 0.0)
        square, c, z, total = scan(g, hs, trace=j == 0)
        if j == 0:
            model.trace = total / model.n
            top = np.sqrt(total) * 1e-3
        for _ in range(2):  # orthogonal to all earlier u; once more if much was taken off
            rest = square - c @ c
            heavy = c @ c > 1e-4 * max(square, 1e-300)
            for x, h, zi in zip(c, hs, zs):
                g, z = g - x * h, z - x * zi
            square = max(rest, 0.0)
            if not heavy:
                break
            square, c, z, _ = scan(g, hs)
        alpha = float(np.sqrt(max(square, 0.0)))
        top = max(top, alpha, *(betas[-1:] or [0.0]))
        if alpha > BREAKDOWN * top:
            hs.append(g / alpha), zs.append(z / alpha), at.append(j)
            alphas.append(alpha)
            v, beta = _orthogonal(zs[-1] - alpha * vs[j], vs)
        else:
            alphas.append(0.0)
            v, beta = vs[j], 0.0
        b = np.diag(alphas) + np.diag(betas, 1)
        left, sigma, right = np.linalg.svd(b)
        exhausted = len(alphas) >= width
        # how far the first k triplets are from being exact
        settled = len(alphas) >= k and bool((beta * np.abs(left[-1, :k]) <= CONVERGED * sigma[0]).all())
        ended = beta <= BREAKDOWN * top
        if exhausted or (settled and not ended):
            break
        if ended:  # an invariant space: go on beside it, for values that occur more than once
            v, beta = _fresh(rng, vs, width), 0.0
        else:
            v = v / beta
        vs.append(v), betas.append(beta)
    model.steps = len(alphas)
    values = sigma**2 / model.n
    keep = values[:k] > max(width * 1e-15 * values[0], 0.0)
    turned = right[:k][keep] @ np.array(vs)
    for i in range(len(turned)):  # exactly unit, at right angles
        turned[i] = _orthogonal(turned[i], list(turned[:i]), unit=True)[0]
    model.components, model.values = turned, values[:k][keep]


def _usual_width(rows: DataFrame) -> int:
    """The most frequent number of entries, of equally frequent ones the largest."""
    top = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return top["w"] if top else 0


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, seed: int = 7) -> Model | None:
    """The whitening model of all vectors, None if there are none.

    Vectors that are null, empty, or hold null or non-finite entries take no part; of vectors
    of different lengths those of the most frequent one (ties: the longest) do.  Components
    whose eigenvalue is zero to rounding are left out, so equal vectors have none."""
    rows = df.select(whole_numbers(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    width = _usual_width(rows)
    if not width:
        return None
    rows = rows.filter(F.size("x") == width)
    sums = rows.select(F.posexplode("x").alias("i", "e")).groupBy("i")
    exact = {r["i"]: (r["n"], int(r["s"])) for r in sums.agg(F.count("*").alias("n"), F.sum(F.col("e").cast("decimal(20,0)")).alias("s")).collect()}
    model = Model(exact[0][0], [exact[i][1] for i in range(width)], np.zeros((0, width)), np.zeros(0), 0.0)
    packed = written(_packed(rows, width), "vectors")
    _bidiagonalised(packed, width, model, min(components, width), seed)
    if len(model.values):
        whole, frac = model.mean_parts
        turn = (model.components / np.sqrt(model.values)[:, None]).T
        k = turn.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            w = ((x - whole) - frac) @ turn
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        s = _summed(packed, width, k + k * k, part)
        mean, gram = s[:k] / model.n, s[k:].reshape(k, k) / model.n
        model.identity_error = float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(df: DataFrame, model: Model | None, vector: str = "embedding") -> DataFrame:
    """The rows that took part in ``fit`` with ``deviation`` (the sum of (n x - S)^2, exact; an
    error if it passes a long) and ``whitened``, one number a component.  Columns with those
    names are replaced.  Without a model there are no rows."""
    kept = [c for c in df.columns if c not in ("deviation", "whitened")]
    width = len(model.sums) if model else 0
    x = whole_numbers(F.col(vector))
    # unfolded before the filter, which would otherwise build every vector twice
    rows = df.select(*kept, F.inline_outer(F.array(F.struct(x.alias("__x"))))).filter(F.size("__x") == (width or -2))
    if model is None:
        return rows.select(*kept, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    n, (whole, frac) = model.n, model.mean_parts
    sums = np.array(model.sums, object)
    turn = (model.components / np.sqrt(model.values)[:, None]).T

    def start():
        def run(vectors: list[list[int]]) -> tuple[list, list]:
            x = np.array(vectors, np.int64).reshape(-1, width)
            if not len(x):
                return [], []
            white = ((x - whole) - frac) @ turn
            far = n * (np.abs(x - whole).max() + 1.0)
            if far < 2.0**62 and far * far * width < 2.0**63:
                off = n * (x - whole) - np.array([s % n for s in model.sums], np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:  # exact at any size; what does not fit in a long is an error
                deviation = ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
            return deviation, white.tolist()

        return run

    fields = {"deviation": ("bigint", pa.int64()), "whitened": ("array<double>", pa.list_(pa.float64()))}
    return appended(rows, kept, ["__x"], fields, start)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(rows)
    white = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    shares = (model.values / model.trace).tolist() if model and model.trace else []
    share = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("i"))
    return white.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
