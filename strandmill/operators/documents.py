"""Per-document stages: segmentation, tokenizing, length and unknown filters, per-source caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens as tk
from ..ordinal import id_block, scan


def usable(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`source`, `doc_ord`, `text` of documents with a source and a text; `doc_ord` is the read order."""
    return documents.where("text is not null and text != '' and source is not null").select("source", F.col(id_col).alias("doc_ord"), "text")


def segment(texts: DataFrame, delimiter: str, order: str = "doc_ord") -> DataFrame:
    """Texts cut at a literal delimiter: stripped pieces without blank ones, with `piece` as their place."""
    pieces = F.split(tx.universal_newlines(F.col("text")), F.lit(r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E"))
    rest = [c for c in texts.columns if c != "text"]
    return texts.select(*rest, F.posexplode(pieces).alias("piece", "text")).withColumn("text", tx.strip(F.col("text"))).where("text != ''")


def segment_lines(lines: DataFrame, is_boundary: Column, order: str, group: str | None = None, size: int = 65536) -> DataFrame:
    """Adds `segment`: how many boundary lines have come so far. A boundary line opens the document it stands before."""
    marked = lines.withColumn("_b", F.coalesce(is_boundary.cast("int"), F.lit(0)))
    out = scan(marked, [group] if group else [], id_block(order, size), [order], "_r", {"segment": "_b"})
    return out.drop("_r", "_b")


def tokenize(documents: DataFrame, mode: str = "utf8", vocab_size: int | None = None) -> DataFrame:
    return documents.withColumn("tokens", tk.encode(F.col("text"), mode, vocab_size))


def unknown_filter(documents: DataFrame, unk_id: int = 0, max_rate: float = 0.02) -> DataFrame:
    """Unknown ids are deleted; documents with too many are dropped, as are those left without tokens."""
    return documents.withColumn("tokens", tk.filter_unknown(F.col("tokens"), unk_id, max_rate)).where("tokens is not null and size(tokens) > 0")


def length_filter(documents: DataFrame, min_length: int = 0, max_length: int | None = None, characters: bool = True) -> DataFrame:
    """Drops texts (if `characters`) and token lists shorter than `min_length`; longer ones than `max_length` are cut."""
    if characters and min_length:
        documents = documents.where(F.char_length("text") >= min_length)
    documents = documents.withColumn("tokens", tk.truncate(F.col("tokens"), max_length))
    return documents.where(F.size("tokens") >= max(1, min_length))


def source_caps(documents: DataFrame, max_docs: int | None, max_tokens: int | None, tokens: str = "n_tokens") -> DataFrame:
    """Of each source the documents before the first that would break a cap: a prefix, not a selection."""
    if max_docs is None and max_tokens is None:
        return documents
    ranked = scan(documents, ["source"], id_block("doc_ord", 4096), ["doc_ord"], "_rank", {"_sum": tokens})
    keep = F.lit(True)
    if max_docs is not None:
        keep = keep & (F.col("_rank") <= max_docs)
    if max_tokens is not None:
        keep = keep & (F.col("_sum") <= max_tokens)
    return ranked.where(keep).drop("_rank", "_sum")


def prepared(documents: DataFrame, min_length: int = 10, normalize: bool = True, id_col: str = "doc_id") -> DataFrame:
    """`source`, `doc_ord`, `n_tokens` of documents after normalisation, byte tokens, unknown and length filters.

    Byte tokens have id 0 only for NUL, so their number and the filter need no arrays.
    """
    rows = usable(documents, id_col)
    text = tx.nfkc(F.col("text")) if normalize else F.col("text")
    rows = rows.withColumn("text", tx.strip_controls(text)).where(F.char_length("text") >= min_length)
    return rows.select("source", "doc_ord", F.octet_length("text").cast("bigint").alias("n_tokens")).where(F.col("n_tokens") >= min_length)
