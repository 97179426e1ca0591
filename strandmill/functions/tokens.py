"""Token arrays: the character tokenizers, their inverses, unknown-token filters, check sums.

Encoders are Arrow functions over the buffers of a string column: UTF-8 bytes are already there, so byte tokens are a
widening copy, and code points and UTF-16 units are one conversion of the whole batch. Counts need no arrays and stay
in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The modes of the character tokenizer with the size of their vocabulary (None: given by the user).
MODES = {"codepoint": None, "utf8": 256, "utf16": 65_536, "utf32": 1_114_112}


def vocabulary_size(mode: str, vocab_size: int | None = None) -> int:
    """The size a mode implies; a size may be given for code points only (default 128)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if MODES[mode] is None:
        if vocab_size is not None and vocab_size < 1:
            raise ValueError("vocab_size must be positive")
        return 128 if vocab_size is None else vocab_size
    if vocab_size is not None and vocab_size != MODES[mode]:
        raise ValueError(f"mode {mode!r} has a fixed vocabulary of {MODES[mode]}")
    return MODES[mode]


def _lists(values: np.ndarray, sizes: np.ndarray, missing: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array(missing) if missing.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)), mask=mask)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, the offsets of each, and which texts are null."""
    missing = np.asarray(texts.is_null())
    held = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0], missing


def _units(texts: pa.Array, encoding: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All units of an encoding, the number of each text, and which texts are null: one conversion of the whole batch."""
    whole, offsets, missing = _bytes(texts)
    units = np.frombuffer(whole.tobytes().decode("utf-8", "replace").encode(encoding, "surrogatepass"), kind)
    # A unit for each byte that starts a character, in UTF-16 two for characters of four bytes.
    starts = ((whole & 0xC0) != 0x80).astype(np.int64)
    if kind == "<u2":
        starts += whole >= 0xF0
    before = np.concatenate([[0], np.cumsum(starts)])
    return units, np.diff(before[offsets]), missing


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _utf8(texts: pa.Array) -> pa.Array:
    whole, offsets, missing = _bytes(texts)
    return _lists(whole, np.diff(offsets), missing)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _utf16(texts: pa.Array) -> pa.Array:
    return _lists(*_units(texts, "utf-16-le", "<u2"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _utf32(texts: pa.Array) -> pa.Array:
    return _lists(*_units(texts, "utf-32-le", "<u4"))


def _codepoints_below(limit: int):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        values, sizes, missing = _units(texts, "utf-32-le", "<u4")
        keep = values < limit
        kept = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(sizes)
        return _lists(values[keep], kept[ends] - kept[ends - sizes], missing)

    return encode


def encode(text: Column, mode: str = "utf8", vocab_size: int | None = None) -> Column:
    """Token ids of a text: code points below the vocabulary (others are dropped), UTF-8 bytes, UTF-16 units or code points.

    A null text has null tokens, an empty one none.
    """
    size = vocabulary_size(mode, vocab_size)
    if mode == "utf8":
        return _utf8(text)
    if mode == "utf16":
        return _utf16(text)
    return _utf32(text) if mode == "utf32" else _codepoints_below(size)(text)


def count_tokens(text: Column, mode: str = "utf8", vocab_size: int | None = None) -> Column:
    """Number of tokens without making them."""
    size = vocabulary_size(mode, vocab_size)
    if mode == "utf8":
        return F.octet_length(text).cast("bigint")
    if mode == "utf16":
        return F.floor(F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("bigint")
    if mode == "utf32":
        return F.char_length(text).cast("bigint")
    if size > 0x10FFFF:
        return F.char_length(text).cast("bigint")
    low, high = "\\x{0}", f"\\x{{{size - 1:X}}}"
    return F.char_length(F.regexp_replace(text, f"[^{low}-{high}]", "")).cast("bigint")


def _decoder(mode: str, size: int):
    kind, encoding = {"utf8": ("<u1", "utf-8"), "utf16": ("<u2", "utf-16-le")}.get(mode, ("<u4", "utf-32-le"))

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(ids)
        missing = np.asarray(lengths.is_null())
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False))])
        values = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        keep = (values >= 0) & (values < size)
        if kind == "<u4":
            keep &= (values <= 0x10FFFF) & ~((values >= 0xD800) & (values <= 0xDFFF))
        if not keep.all():
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            values = values[keep]
        raw, width = values.astype(kind).tobytes(), np.dtype(kind).itemsize
        cut = (ends * width).tolist()
        return pa.array([None if gone else raw[a:b].decode(encoding, "ignore") for gone, a, b in zip(missing.tolist(), cut, cut[1:])], pa.string())

    return decode


def decode(ids: Column, mode: str = "utf8", vocab_size: int | None = None) -> Column:
    """The text of token ids; ids outside the vocabulary and invalid sequences are left out."""
    return _decoder(mode, vocabulary_size(mode, vocab_size))(ids)


def filter_unknown(tokens: Column, unk_id: int = 0, max_rate: float = 0.02) -> Column:
    """Tokens without the unknown id; null (drop the document) if it makes up more than `max_rate`. A negative id: as they are."""
    if unk_id < 0:
        return tokens
    n = F.size(tokens)
    unknown = n - F.size(F.array_remove(tokens, unk_id))
    return F.when(n <= 0, tokens).when(unknown.cast("double") / n > max_rate, F.lit(None)).otherwise(F.array_remove(tokens, unk_id))


def truncate(tokens: Column, max_length: int | None) -> Column:
    """The first `max_length` tokens; None or 0: all."""
    return F.slice(tokens, 1, max_length) if max_length else tokens


def append_eos(tokens: Column, eos: int) -> Column:
    """One end token after the document if its id is not negative."""
    return F.concat(tokens, F.array(F.lit(eos).cast("int"))) if eos >= 0 else tokens


def fit_window(prompt: Column, choice: Column, window: int) -> tuple[Column, Column]:
    """Prompt and choice tokens that fit a context: the choice is kept, the prompt loses its start."""
    empty = F.slice(prompt, 1, 0)
    tail = lambda a, n: F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), n)
    if window <= 1:
        return tail(prompt, F.lit(1)), F.slice(choice, 1, 1)
    keep = F.lit(window) - F.size(choice)
    whole = F.size(prompt) <= keep
    return (
        F.when(whole, prompt).when(keep <= 0, empty).otherwise(tail(prompt, F.greatest(keep, F.lit(0)))),
        F.when(whole | (keep > 0), choice).otherwise(tail(choice, F.lit(window))),
    )


def summary(tokens: Column) -> list[Column]:
    """`n`, `total`, `weighted` (sum of token times place), `least`, `most` of an array: enough to compare it."""
    total = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, x: a + x)
    weighted = F.aggregate(
        tokens, F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("s")), lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["s"] + (a["i"] + 1) * x).alias("s")), lambda a: a["s"]
    )
    return [F.size(tokens).cast("bigint").alias("n"), total.alias("total"), weighted.alias("weighted"), F.array_min(tokens).cast("bigint").alias("least"), F.array_max(tokens).cast("bigint").alias("most")]
