"""Training objective over labelled spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import neg_log_softmax


def cross_entropy(
    df: DataFrame,
    label="label",
    logits="logits",
    by: tuple[str, ...] = (),
    type_weights: dict[str, float] | None = None,
    types: list[str] | None = None,
) -> DataFrame:
    """Sum over spans of -log softmax at the gold label as ``loss``, per group of ``by``.
    Weights are given by type name and aligned with ``types``, a type without one weighs
    0; they add the sum ``weighted``."""
    rows = df.withColumn("__loss", neg_log_softmax(F.col(logits), F.col(label)))
    sums = [F.sum("__loss").alias("loss")]
    if type_weights is not None:
        unknown = set(type_weights) - set(types or [])
        if unknown:
            raise ValueError(f"weights for unknown types: {sorted(unknown)}")
        aligned = F.array(*[F.lit(float(type_weights.get(t, 0.0))) for t in types])
        sums.append(F.sum(F.col("__loss") * F.get(aligned, F.col(label))).alias("weighted"))
    return rows.groupBy(*by).agg(*sums)
