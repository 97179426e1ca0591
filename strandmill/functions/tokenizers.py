"""Tokenizers by name: each encodes, decodes and counts columns. Vocabularies are applied, never trained."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk


@dataclass(frozen=True)
class Tokenizer:
    """Column functions of a tokenizer."""

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    count: Callable[[Column], Column]


_REGISTRY: dict[str, Callable[..., Tokenizer]] = {}
_LOADED: dict[tuple[str, str], tuple[Callable, Callable]] = {}
# Byte-level vocabularies smaller than this come from a file of their own; the word pattern of rank files.
LEAST_RANKED = 10_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def register(name: str, make: Callable[..., Tokenizer]) -> None:
    """Adds a tokenizer; a name that is taken is an error."""
    if name in _REGISTRY:
        raise ValueError(f"tokenizer {name!r} is registered already")
    _REGISTRY[name] = make


def names() -> list[str]:
    return sorted(_REGISTRY)


def create(name: str, **settings) -> Tokenizer:
    if name not in _REGISTRY:
        raise ValueError(f"unknown tokenizer {name!r}; known: {', '.join(names())}")
    return _REGISTRY[name](**settings)


def character(mode: str = "utf8", vocab_size: int | None = None) -> Tokenizer:
    """Code points, UTF-8 bytes, UTF-16 units or UTF-32 values."""
    tk.vocabulary_size(mode, vocab_size)
    return Tokenizer(f"char_{mode}", lambda c: tk.encode(c, mode, vocab_size), lambda c: tk.decode(c, mode, vocab_size), lambda c: tk.count_tokens(c, mode, vocab_size))


def _load(kind: str, path: str) -> tuple[Callable, Callable]:
    """(encode, decode) of lists by a vocabulary file; a worker loads a file once."""
    if (kind, path) not in _LOADED:
        if kind == "unigram":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[kind, path] = (lambda listed: model.encode(listed, num_threads=1)), (lambda ids: model.decode(ids))
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[kind, path] = (lambda listed: [model.encode_ordinary(t) for t in listed]), (lambda lists: [model.decode(x) for x in lists])
        else:
            from tokenizers import Tokenizer as Library

            model = Library.from_file(path)
            model.encode_special_tokens = True
            _LOADED[kind, path] = (lambda listed: [e.ids for e in model.encode_batch(listed, add_special_tokens=False)]), (lambda lists: model.decode_batch(lists, skip_special_tokens=False))
    return _LOADED[kind, path]


def library(kind: str, path: str | None) -> Tokenizer:
    """A vocabulary file of a library: a rank file or JSON vocabulary ("bpe", "hf_bpe"), or a sentencepiece model ("unigram").

    Null stays null and an empty text has no tokens.
    """
    if not path:
        raise ValueError(f"tokenizer {kind!r} needs the path of its vocabulary")

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        listed = texts.to_pylist()
        found = _load(kind, path)[0]([t or "" for t in listed])
        return pa.array([None if t is None else ids for t, ids in zip(listed, found)], pa.list_(pa.int32()))

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        listed = ids.to_pylist()
        found = _load(kind, path)[1]([x or [] for x in listed])
        return pa.array([None if x is None else t for x, t in zip(listed, found)], pa.string())

    return Tokenizer(kind, encode, decode, lambda c: F.size(encode(c)).cast("bigint"))


register("char", lambda mode="codepoint", vocab_size=None: character(mode, vocab_size))
register("utf8", lambda: character("utf8"))
for _kind in ("bpe", "hf_bpe", "unigram"):
    register(_kind, lambda path=None, kind=_kind: library(kind, path))


def resolve(name: str, backend: str | None = None, mode: str | None = None, vocab_size: int | None = None) -> tuple[str, dict]:
    """(name, settings) that a training config's tokenizer fields mean.

    A backend for byte-level or unigram vocabularies wins over the name; small byte-level ones come from JSON files; a
    character tokenizer is UTF-8 by default, and code points number 256 by default.
    """
    chosen = {"gpt2_bpe": "bpe", "unigram": "unigram"}.get(backend or "", name)
    if chosen == "bpe":
        return ("hf_bpe", {}) if vocab_size is not None and vocab_size < LEAST_RANKED else ("bpe", {})
    if chosen == "unigram":
        return "unigram", {}
    mode = mode or "utf8"
    return chosen, {"mode": mode} | ({"vocab_size": vocab_size or 256} if mode == "codepoint" else {})


def resolved(name: str, backend: Column, mode: Column, vocab_size: Column) -> tuple[Column, Column]:
    """The name and the mode (null if it has none) that `resolve` gives, as columns."""
    chosen = F.when(backend == "gpt2_bpe", "bpe").when(backend == "unigram", "unigram").otherwise(name)
    bare = F.when((chosen == "bpe") & (vocab_size < LEAST_RANKED), "hf_bpe").otherwise(chosen)
    return bare, F.when(chosen.isin("bpe", "unigram"), None).when(mode != "", mode).otherwise("utf8")


def configured(name: str, backend: str | None = None, mode: str | None = None, vocab_size: int | None = None, folder: str | None = None, path: str | None = None) -> Tokenizer:
    """The tokenizer of a training config; `path` names the vocabulary file, or `folder` where the usual ones lie."""
    chosen, settings = resolve(name, backend, mode, vocab_size)
    if chosen in ("bpe", "hf_bpe", "unigram"):
        path = path or (os.path.join(folder, f"bpe_vocab_{vocab_size}.json") if folder and chosen == "hf_bpe" else None)
        settings = {"path": path}
    return create(chosen, **settings)
