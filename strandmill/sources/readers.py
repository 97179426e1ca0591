"""Readers of raw sources: each gives `doc_ord` (read order) and `text`, or `tokens`."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.documents import segment
from ..ordinal import scan
from . import npy, paths


def _numbered(rows: DataFrame, columns: list[str], within: list[str]) -> DataFrame:
    """`doc_ord` from 0 by file, place of the file's part, place in the part."""
    out = scan(rows, [], F.struct("_file", "_part"), within, "doc_ord")
    return out.select((F.col("doc_ord") - 1).alias("doc_ord"), *columns)


def read_text(spark: SparkSession, path: str, delimiter: str = "\n\n") -> DataFrame:
    """Delimited text of a file or the .txt files of a folder by name.

    Files are cut at the delimiter by the scan itself, so a huge file is read in parallel; files whose head has line ends
    of two characters are cut at the delimiter written with these. Line ends are unified afterwards, and pieces cut
    again, stripped and dropped if blank. Undecodable bytes are dropped.
    """
    files: dict[str, list[str]] = {}
    for f in paths.listing(spark, path, ".txt"):
        wide = "\n" in delimiter and b"\r\n" in paths.head(spark, f)
        files.setdefault(delimiter.replace("\n", "\r\n") if wide else delimiter, []).append(f)
    out = None
    for end, some in (files or {delimiter: [path]}).items():
        raw = spark.read.option("lineSep", end).text(some)
        raw = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_id"))
        out = raw if out is None else out.unionByName(raw)
    out = out.withColumn("text", F.replace(F.make_valid_utf8("text"), F.lit("\ufffd"), F.lit("")))
    return _numbered(segment(out, delimiter, "_id"), ["text"], ["_id", "piece"])


def read_jsonl(spark: SparkSession, path: str, text_field: str = "text") -> DataFrame:
    """One object per line; objects without the field or with an empty one are skipped, a malformed line raises."""
    raw = spark.read.text(paths.listing(spark, path, ".jsonl"))
    raw = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_id"))
    text = F.from_json("value", f"`{text_field}` string", {"mode": "FAILFAST"})[text_field]
    rows = raw.where(~tx.is_blank(F.col("value"))).withColumn("text", text).where("text is not null and text != ''")
    return _numbered(rows, ["text"], ["_id"])


def read_parquet(spark: SparkSession, path: str, text_field: str = "text", resolve: Callable[[dict], str] | None = None) -> DataFrame:
    """The text column of a file or of the .parquet files of a folder by name; only that column is read.

    A remote URI goes through `resolve`, which gives the local path of the parsed parts: there is no network here.
    """
    if path.startswith("hf://"):
        if resolve is None:
            raise ValueError("a remote path needs a resolver to local files")
        path = resolve(parse_remote(path))
    raw = spark.read.parquet(*paths.listing(spark, path, ".parquet")).select(F.col(text_field).alias("text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_id"))
    rows = raw.where("text is not null and text != ''").withColumn("_part", F.floor(F.col("_id") / 65_536))
    return _numbered(rows, ["text"], ["_id"])


def parse_remote(uri: str) -> dict[str, str | None]:
    """The parts of hf://namespace/dataset[/config][/split]; the split is train if none is named."""
    if not uri.startswith("hf://"):
        raise ValueError(f"not a remote path: {uri!r}")
    parts = uri.removeprefix("hf://").split("/")
    if len(parts) < 2 or not all(parts[:2]):
        raise ValueError(f"a remote path names a namespace and a dataset: {uri!r}")
    return {"dataset": "/".join(parts[:2]), "config": parts[2] if len(parts) > 2 else None, "split": parts[3] if len(parts) > 3 else "train"}


def read_npy_documents(spark: SparkSession, path: str, chunk_size: int = 1024, min_length: int = 0) -> DataFrame:
    """Token arrays cut to documents of `chunk_size` tokens, then without id 0, then at least `min_length` long.

    A chunk size of 0 makes one document of each file, without the length check. Negative ids raise.
    """
    if chunk_size > 0:
        rows = npy.read_npy(spark, path, chunk_size).withColumn("tokens", F.array_remove("tokens", 0)).where(F.size("tokens") >= max(1, min_length))
    else:
        parts = npy.read_npy(spark, path).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "tokens"))).alias("p"))
        rows = parts.select("file", F.lit(0).cast("bigint").alias("start"), F.array_remove(F.flatten(F.transform("p", lambda s: s["tokens"])), 0).alias("tokens"))
    rows = rows.select(F.col("file").alias("_file"), F.floor(F.col("start") / 16_777_216).alias("_part"), F.col("start").alias("_id"), "tokens")
    return _numbered(rows, ["tokens"], ["_id"])


def read_byte_text(spark: SparkSession, path: str, block: int = 10_000_000) -> DataFrame:
    """Byte arrays in .npy files as text: blocks are decoded each for itself, so a character across an edge is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.array(x, np.int64).astype(np.uint8).tobytes().decode("utf-8", "ignore") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts)], ["_file", "_id", "text"])

    rows = npy.read_npy(spark, path, block).mapInArrow(run, "_file string, _id bigint, text string").withColumn("_part", F.floor(F.col("_id") / block))
    return _numbered(rows.where("text != ''"), ["text"], ["_id"])


#: Readers by the name of the format, with the settings of a dataset that each takes.
READERS: dict[str, Callable] = {
    "text": lambda spark, s, resolve=None: read_text(spark, s.path, s.delimiter),
    "jsonl": lambda spark, s, resolve=None: read_jsonl(spark, s.path, s.text_field),
    "parquet": lambda spark, s, resolve=None: read_parquet(spark, s.path, s.text_field, resolve),
    "npy": lambda spark, s, resolve=None: read_npy_documents(spark, s.path, s.chunk_size, s.min_length),
    "utf8_tokens": lambda spark, s, resolve=None: read_byte_text(spark, s.path),
}


def reader(name: str) -> Callable:
    if name not in READERS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(sorted(READERS))}")
    return READERS[name]


# ---------------------------------------------------------------- finding files

# What a path is scored by when a data set is looked for, and folders that are not searched.
SCORES = (
    (r"/tinystories-gpt4-clean/train\.txt$", 100), ("tinystories-gpt4-clean", 20), (r"\.txt$", 5), ("boundary", 3), (r"\.arrow$", -10),
)
SUFFIXES = (".txt", ".json", ".jsonl", ".parquet", ".arrow", ".npy")
SKIPPED = {".git", ".venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache"}


def locate(spark: SparkSession, roots: list[str], max_depth: int, word: str = "tinystories", scores: tuple[tuple[str, int], ...] = SCORES) -> DataFrame:
    """Files below the roots (to a depth) whose path has the word: `path`, `score`, best first; caches may get scores of their own."""
    found = []
    for root in roots:
        depth = len(os.path.abspath(root).split(os.sep))
        for folder, inner, names in os.walk(root):
            if len(os.path.abspath(folder).split(os.sep)) - depth >= max_depth:
                inner.clear()
            inner[:] = sorted(d for d in inner if d not in SKIPPED and not d.startswith("."))
            found += [(os.path.join(os.path.abspath(folder), n),) for n in names if n.lower().endswith(SUFFIXES)]
    rows = spark.createDataFrame(found, "path string").where(F.contains(F.lower("path"), F.lit(word)))
    score = sum((F.when(F.lower("path").rlike(p), n).otherwise(0) for p, n in scores), F.lit(0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "path")


_BRACES = re.compile(r"\{([^{}]+)\}")
_RANGE = re.compile(r"(-?\d+)\.\.(-?\d+)")


def expand_braces(pattern: str) -> list[str]:
    """All patterns that `{a,b}` and `{00..07}` stand for; ranges may descend, be negative and be padded with zeros."""
    todo, out = [pattern], []
    while todo:
        head = todo.pop(0)
        group = _BRACES.search(head)
        if group is None:
            out.append(head)
            continue
        if ends := _RANGE.fullmatch(group[1]):
            a, b = int(ends[1]), int(ends[2])
            width = max(len(x.lstrip("-")) for x in ends.groups())
            options = [f"{'-' if v < 0 else ''}{abs(v):0{width}d}" for v in (range(a, b + 1) if b >= a else range(a, b - 1, -1))]
        else:
            options = group[1].split(",")
        todo = [head[: group.start()] + o + head[group.end() :] for o in options] + todo
    return out


def select_paths(paths: DataFrame, allow: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Rows whose `path` fits an allowed pattern (none: all) and no ignored one; patterns may have braces."""

    def fits(patterns):
        wanted = [fnmatch.translate(p) for x in patterns for p in expand_braces(x)]
        return F.col("path").rlike("|".join(f"(?:{w})" for w in wanted).replace(r"\Z", r"\z"))

    if allow:
        paths = paths.where(fits(allow))
    return paths.where(~fits(ignore)) if ignore else paths
