"""Linting of text lines and metrics of tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def lines(documents: DataFrame, order: str = "doc_ord") -> DataFrame:
    """`order`, `line_no` (from 1), `line` of each line of `text`."""
    return documents.select(order, F.posexplode(F.split("text", "\n")).alias("_i", "line")).select(order, (F.col("_i") + 1).alias("line_no"), "line")


def issues(rows: DataFrame, order: str = "doc_ord", context: int = 50) -> DataFrame:
    """A row per issue: `order`, `line_no`, `kind`, `sample` (the first characters of the line); blank lines have none."""
    kinds = F.array(*[F.when(F.col("line").rlike("(?U)" + p), F.lit(k)) for k, p in tx.LINT.items()])
    found = rows.where(~tx.is_blank(F.col("line"))).withColumn("kind", F.explode(F.array_compact(kinds)))
    return found.select(order, "line_no", "kind", F.substring("line", 1, context).alias("sample"))


def issue_samples(found: DataFrame, order: str = "doc_ord", samples: int = 3) -> DataFrame:
    """The first `samples` issues of each kind: `kind`, `sample_no` (from 1), `order`, `line_no`, `sample`.

    Ranks are limited before rows are exchanged, so that a task has no more than `samples` rows of a kind of each other.
    """
    ranked = found.withColumn("sample_no", F.row_number().over(Window.partitionBy("kind").orderBy(order, "line_no")))
    return ranked.where(F.col("sample_no") <= samples).select("kind", "sample_no", order, "line_no", "sample")


def issue_summary(found: DataFrame, order: str = "doc_ord", samples: int = 3) -> DataFrame:
    """Per kind: how many (`n`), the first issue (`first_doc`, `first_line`, `first_sample`) and the first `samples` as an array."""
    totals = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    row = F.struct("sample_no", F.col(order).alias("doc"), F.col("line_no").alias("line"), "sample")
    best = issue_samples(found, order, samples).groupBy("kind").agg(F.array_sort(F.collect_list(row)).alias("samples"))
    first = F.col("samples")[0]
    return totals.join(best, "kind").select("kind", "n", first["doc"].alias("first_doc"), first["line"].alias("first_line"), first["sample"].alias("first_sample"), "samples")


def size_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Characters and line feeds of two versions of a corpus and the share by which it shrank."""
    measure = lambda df, p: df.agg(F.sum(F.char_length("text")).alias(f"{p}_chars"), F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))).alias(f"{p}_newlines"))
    both = measure(before, "before").join(measure(after, "after"))
    return both.withColumn("reduction", 1.0 - F.col("after_chars") / F.col("before_chars"))


def tokenizer_metrics(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Characters, tokens, characters per token, different tokens and their share; no tokens raise."""
    counted = tokens.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("num_tokens"), F.count(F.lit(1)).alias("unique_tokens"))
    chars = texts.agg(F.sum(F.char_length("text")).alias("num_chars"))
    n = F.when(F.coalesce("num_tokens", F.lit(0)) == 0, F.raise_error("no tokens").cast("bigint")).otherwise(F.col("num_tokens"))
    return counted.join(chars).select("num_chars", n.alias("num_tokens"), "unique_tokens", (F.col("num_chars") / F.col("num_tokens")).alias("chars_per_token"), (F.col("unique_tokens") / F.col("num_tokens")).alias("unique_ratio"))
