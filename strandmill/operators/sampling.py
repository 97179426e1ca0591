"""Filters on next-token logits, one row per (vector, token)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ordinal import md5_key


def logits(vectors: DataFrame, key: str, values: str) -> DataFrame:
    """`key`, `token`, `logit` of arrays of logits."""
    return vectors.select(key, F.posexplode(values).alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))


def penalize(rows: DataFrame, contexts: DataFrame, key: str, penalty: float, window: int = 64) -> DataFrame:
    """Logits of tokens among the last `window` of the context (`key`, `context`) are divided by the penalty, whatever their sign."""
    if penalty <= 1.0:
        return rows
    recent = contexts.select(F.col(key).alias("_k"), F.explode(F.array_distinct(F.slice("context", F.greatest(F.lit(1), F.size("context") - window + 1), window))).alias("_t"))
    joined = rows.join(recent, (F.col(key) == F.col("_k")) & (F.col("token") == F.col("_t")), "left")
    return joined.withColumn("logit", F.when(F.col("_t").isNotNull(), F.col("logit") / penalty).otherwise(F.col("logit"))).drop("_k", "_t")


def greedy(rows: DataFrame, key: str) -> DataFrame:
    """The token of the largest logit, the first of equals."""
    return rows.groupBy(key).agg(F.max_by("token", F.struct("logit", -F.col("token"))).alias("token"))


def temper(rows: DataFrame, temperature: float) -> DataFrame:
    if temperature <= 0:
        raise ValueError("a temperature of 0 or less means greedy")
    return rows.withColumn("logit", F.col("logit") / temperature)


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Tokens not below the k-th largest logit: equals of the k-th stay. 0: all."""
    if k <= 0:
        return rows
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("logit")))).where(F.col("_r") <= k).drop("_r")


def probabilities(rows: DataFrame, key: str) -> DataFrame:
    every = Window.partitionBy(key)
    e = F.exp(F.col("logit") - F.max("logit").over(every))
    return rows.withColumn("_e", e).withColumn("probability", F.col("_e") / F.sum("_e").over(every)).drop("_e")


def top_p(rows: DataFrame, key: str, p: float) -> DataFrame:
    """Tokens up to the first at which the probability before it exceeds p; the first stays. Outside 0..1: all."""
    if not 0 < p < 1:
        return rows
    before = Window.partitionBy(key).orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, -1)
    return probabilities(rows, key).withColumn("_b", F.coalesce(F.sum("probability").over(before), F.lit(0.0))).where(F.col("_b") <= p).drop("_b", "probability")


def draw(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A token by its probability, seeded: the largest logit plus Gumbel noise from a hash of (seed, key, token)."""
    u = (F.conv(F.substring(md5_key(seed, F.col(key), F.col("token")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noisy = rows.withColumn("_g", F.col("logit") - F.log(-F.log(u)))
    return noisy.groupBy(key).agg(F.max_by("token", F.struct("_g", -F.col("token"))).alias("token"))
