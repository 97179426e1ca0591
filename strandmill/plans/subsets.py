"""The chain that cuts a text file to size: clean, keep whole documents up to a budget, tokenize, keep a prefix of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokenizers import Tokenizer
from ..operators import documents as dc
from ..operators import packing
from ..ordinal import scan
from ..sources import npy, paths
from ..sources.reports import parse_bytes, parse_tokens


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """`line_no` (from 0), `line`, `n_bytes` (with its line feed) of a text file, read in parallel."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_id"), (F.octet_length("value") + 1).cast("bigint").alias("_n"))
    out = scan(raw, [], F.col("_part"), ["_id"], "line_no", {"_upto": "_n"})
    # The last line may have no line feed: the size of the file tells.
    size = F.lit(paths.size(spark, path)).cast("bigint")
    return out.select((F.col("line_no") - 1).alias("line_no"), "line", F.least(F.col("_n"), size - (F.col("_upto") - F.col("_n"))).alias("n_bytes"))


def clean_file(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a wiki text file, cleaned: `segment` (from its first header on), `text`."""
    lines = dc.segment_lines(file_lines(spark, path), tx.boundary(F.col("line"), "wikitext"), "line_no")
    whole = lines.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return whole.select("segment", tx.clean_wikitext(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def extract_text(spark: SparkSession, path: str, size: str, dataset: str | None = None, pattern: str | None = None) -> DataFrame:
    """The lines of a file that make up `size` (as `parse_bytes` reads it).

    With a boundary: whole documents in order until the size is reached, so it may be exceeded; without: lines.
    """
    lines, budget = file_lines(spark, path), parse_bytes(size)
    if dataset is None and pattern is None:
        return packing.within_budget(lines, budget, "n_bytes", "line_no").withColumn("segment", F.lit(None).cast("bigint"))
    cut = dc.segment_lines(lines, tx.boundary(F.col("line"), dataset, pattern), "line_no")
    sizes = cut.groupBy("segment").agg(F.sum("n_bytes").alias("size"))
    kept = packing.within_budget(sizes, budget, "size", "segment").select(F.col("segment").alias("_s"))
    return cut.join(kept, F.col("segment") == F.col("_s"), "left_semi")


def tokenize_file(spark: SparkSession, path: str, tokenizer: Tokenizer, folder: str, name: str) -> DataFrame:
    """Writes the tokens of a file, line by line in order, to `folder/name.npy`; gives `file`, `n_tokens`.

    Character and byte tokens are those of the whole file; vocabularies with merges don't merge across line ends.
    """
    lines = file_lines(spark, path)
    text = F.when(F.col("n_bytes") > F.octet_length("line"), F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    rows = lines.select("line_no", F.lit(name).alias("name"), tokenizer.encode(text).alias("tokens"))
    return _named(rows, folder, ["line_no"], name)


def extract_token_file(spark: SparkSession, path: str, size: str, folder: str, name: str) -> DataFrame:
    """Writes the first tokens of a token file (at most as many as there are) to `folder/name.npy`."""
    rows = npy.read_npy(spark, path).withColumn("n_tokens", F.size("tokens").cast("bigint"))
    kept = packing.token_prefix(rows.select("start", "tokens", "n_tokens").withColumnRenamed("start", "at"), parse_tokens(size), "at")
    return _named(kept.withColumn("name", F.lit(name)), folder, ["at"], name)


def _named(rows: DataFrame, folder: str, order: list[str], name: str) -> DataFrame:
    head, _, tail = name.rpartition("_")
    prefix, label = (head, tail) if head else (name, "tokens")
    return npy.write_npy(rows.withColumn("name", F.lit(label)), folder, ["name"], order, prefix)
