"""Closed-form layer arithmetic: norms, activations and position tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    """Each value over the root of the mean square."""
    scale = F.sqrt(_squares(x) / F.size(x) + eps)
    return F.transform(x, lambda v: v.cast("double") / scale)


def centered_rms_norm(x: Column, eps: float = 1e-6) -> Column:
    """`rms_norm` of the distances from the mean."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(x)
    return rms_norm(F.transform(x, lambda v: v.cast("double") - mean), eps)


def flash_norm(x: Column, eps: float = 1e-6) -> Column:
    """`rms_norm` whose scale has moved to the next layer: the same without weights."""
    return rms_norm(x, eps)


def dynamic_tanh(x: Column, alpha: float = 0.5) -> Column:
    return F.transform(x, lambda v: F.tanh(v.cast("double") * alpha))


def relu_squared(x: Column) -> Column:
    return F.transform(x, lambda v: F.pow(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(2.0)))


def gelu(x: Column) -> Column:
    """The hyperbolic-tangent form of the Gaussian error unit."""
    return F.transform(x, lambda v: 0.5 * v.cast("double") * (1.0 + F.tanh((v.cast("double") + 0.044715 * v.cast("double") * v * v) * math.sqrt(2 / math.pi))))


def swiglu(gate: Column, up: Column) -> Column:
    """The gate times its sigmoid, times the other half."""
    return F.zip_with(gate, up, lambda g, u: g.cast("double") / (1.0 + F.exp(-g.cast("double"))) * u.cast("double"))


def xielu(x: Column, alpha_pos: float = 0.8, alpha_neg: float = 0.8, beta: float = 0.5) -> Column:
    """Quadratic for positive values, an exponential with a linear part for the others."""
    return F.transform(
        x,
        lambda v: F.when(v > 0, v.cast("double") * v * alpha_pos + v.cast("double") * beta).otherwise(
            (F.exp(F.least(v.cast("double"), F.lit(0.0))) - 1.0 - v.cast("double")) * alpha_neg + v.cast("double") * beta
        ),
    )


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x).cast("double")
    return F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))) + top


def smoothed_cross_entropy(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    """(1 - e) times the negative log-probability of the target plus e times the mean over the vocabulary."""
    norm = log_sum_exp(logits)
    nll = norm - F.element_at(logits, target + 1).cast("double")
    mean = norm - F.aggregate(logits, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(logits)
    return nll * (1.0 - smoothing) + mean * smoothing


def rope(x: Column, position: Column, base: float = 10_000.0) -> Column:
    """`x` (of an even size) turned by its position: value i and value i + half by position / base^(2 i / size)."""
    half = (F.size(x) / 2).cast("int")

    def turned(v: Column, i: Column) -> Column:
        angle = position / F.pow(F.lit(base), 2.0 * (i % half) / F.size(x))
        other = F.when(i < half, -F.element_at(x, (i + half + 1).cast("int"))).otherwise(F.element_at(x, (i - half + 1).cast("int")))
        return v.cast("double") * F.cos(angle) + other.cast("double") * F.sin(angle)

    return F.transform(x, turned)


def _grid(spark: SparkSession, length: int) -> DataFrame:
    """All places `i`, `j` below a length, made by the executors."""
    return spark.range(length * length).select(F.floor(F.col("id") / length).alias("i"), (F.col("id") % length).alias("j"))


def alibi_bias(spark: SparkSession, heads: int, length: int) -> DataFrame:
    """`head`, `i`, `j`, `bias`: the distance by which j is ahead of i, times -2^(-8 (head + 1) / heads)."""
    slopes = F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head")
    ahead = F.greatest(F.lit(0), F.col("j") - F.col("i"))
    return _grid(spark, length).select("i", "j", slopes).select("head", "i", "j", (F.lit(0.0) - F.pow(F.lit(2.0), -8.0 * (F.col("head") + 1) / heads) * ahead).alias("bias"))


def relative_buckets(spark: SparkSession, length: int, buckets: int) -> DataFrame:
    """`i`, `j`, `bucket`: how far j lies behind i, 0 for later places, at most `buckets` - 1."""
    return _grid(spark, length).select("i", "j", F.least(F.greatest(F.col("i") - F.col("j"), F.lit(0)), F.lit(buckets - 1)).cast("int").alias("bucket"))
