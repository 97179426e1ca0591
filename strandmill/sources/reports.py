"""Readers of what runs leave behind: metric curves, status documents, statistics, caches."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of a metric curve, all numbers, blank where nothing was measured.
CURVE = ("step", "loss", "perplexity", "lr", "grad_norm", "tokens_per_sec", "gpu_memory_mb", "val_loss", "test_loss")
STATUS = "step bigint, max_steps bigint, done boolean, val_loss double, checkpoint string, updated_at string"
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def read_curves(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Metric curves (CSV) with the file they come from; values that are no numbers are null."""
    kinds = ", ".join(f"{c} {'bigint' if c == 'step' else 'double'}" for c in CURVE)
    return spark.read.schema(kinds).csv(paths, header=True, mode="PERMISSIVE").withColumn("run", F.col("_metadata.file_path"))


def latest_metrics(curves: DataFrame) -> DataFrame:
    """The last row of each run by step."""
    return curves.where("step is not null").groupBy("run").agg(F.max_by(F.struct(*CURVE), "step").alias("m")).select("run", "m.*")


def read_status(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Status documents (one JSON object per file) with their file and when it was written, newest first; broken ones are left out."""
    rows = spark.read.schema(STATUS + ", _broken string").json(paths, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    rows = rows.withColumns({"run": F.col("_metadata.file_path"), "written_at": F.col("_metadata.file_modification_time")})
    return rows.where("_broken is null").drop("_broken").orderBy(F.desc("written_at"), "run")


def size_text(n: Column) -> Column:
    """A number of bytes as text; each unit is an integer division by 1024, as in listings."""
    out, value = F.lit(None).cast("string"), n.cast("bigint")
    steps = []
    for unit in UNITS[:-1]:
        steps.append((value < 1024, F.concat(F.format_string("%.1f", value.cast("double")), F.lit(f" {unit}"))))
        value = F.floor(value / 1024)
    out = F.concat(F.format_string("%.1f", value.cast("double")), F.lit(f" {UNITS[-1]}"))
    for condition, text in reversed(steps):
        out = F.when(condition, text).otherwise(out)
    return out


def cache_report(spark: SparkSession, folder: str) -> DataFrame:
    """Stage caches of a folder: `source`, `n_bytes`, `size`, `complete` (Spark's mark of a finished write is there)."""
    rows = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        path = os.path.join(folder, name)
        if os.path.isdir(path):
            parts = [os.path.join(path, f) for f in os.listdir(path)]
            rows.append((name, sum(map(os.path.getsize, parts)), os.path.exists(os.path.join(path, "_SUCCESS"))))
    df = spark.createDataFrame(rows, "source string, n_bytes bigint, complete boolean")
    return df.withColumn("size", size_text(F.col("n_bytes")))


def status_report(caches: DataFrame, totals: DataFrame, curves: DataFrame, status: DataFrame) -> DataFrame:
    """All that is known of a workspace as rows `section`, `place`, `name`, `detail`: caches by name, sets with their tokens
    in millions, the last metrics of each curve, and runs, the one that wrote last first.

    The inputs are those of `cache_report`, `token_totals`, `latest_metrics` and `read_status`.
    """
    done = F.when(F.col("complete"), "complete").otherwise("incomplete")
    share = F.when(F.col("max_steps") > 0, F.round(100.0 * F.col("step") / F.col("max_steps"), 1))
    parts = [
        ("caches", caches, F.col("source"), F.concat_ws(", ", done, "size"), [F.col("source")]),
        ("sets", totals, F.col("source"), F.concat(F.format_string("%.1f", F.col("tokens") / 1e6), F.lit(" M tokens, "), F.col("docs"), F.lit(" documents")), [F.col("source")]),
        ("curves", curves, F.col("run"), F.to_json(F.struct(*CURVE)), [F.col("run")]),
        ("runs", status, F.col("run"), F.to_json(F.struct("step", "max_steps", share.alias("percent"), "done", "val_loss", "checkpoint", "updated_at")), [F.desc("written_at"), F.col("run")]),
    ]
    out = None
    for section, rows, name, detail, order in parts:
        # Sections are listings of folders: a few rows each.
        place = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order))
        found = rows.select(F.lit(section).alias("section"), place.alias("place"), name.alias("name"), detail.alias("detail"))
        out = found if out is None else out.unionByName(found)
    return out


def token_totals(documents: DataFrame) -> DataFrame:
    """Documents and tokens of each cached source."""
    return documents.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


def parse_bytes(text: str) -> int:
    """A size in bytes: K, M, G are powers of 1024; with a final T they are powers of 1000 of tokens at 4 bytes."""
    import re

    text = text.strip().upper()
    if text.endswith("T"):
        m = re.fullmatch(r"(\d+(?:\.\d+)?)([KMG]?)T", text)
        if m is None:
            raise ValueError(f"not a size: {text!r}")
        return int(float(m[1]) * 1000.0 ** " KMG".index(m[2] or " ") * 4)
    if text[-1:] in ("K", "M", "G"):
        return int(float(text[:-1]) * 1024 ** " KMG".index(text[-1]))
    return int(text)


def parse_tokens(text: str) -> int:
    """A number of tokens: K, M, G are powers of 1000; a final T may follow a plain number only."""
    text = text.strip().upper()
    if text.endswith("T"):
        return int(float(text[:-1]))
    if text[-1:] in ("K", "M", "G"):
        return int(float(text[:-1]) * 1000 ** " KMG".index(text[-1]))
    return int(text)
