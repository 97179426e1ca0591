"""Problem 6: token ids of every text by a public byte-level BPE vocabulary.

Speculate and verify. Texts are cut at spaces that stand between two other characters, where the vocabulary's
pattern always starts a new word; each distinct chunk is encoded once and its ids are kept. For all new words of a
batch at once, greedy longest match (a trie held in sorted arrays) proposes tokens and an array-wise check tests
every adjacent pair: a proposal whose pairs are all compatible is what the merges give. Only words with a failing
pair go through exact merging. The vocabulary's tables are built once on the driver from the rank file, whose path
is a parameter, and are broadcast: their size is bounded by the vocabulary (about 4 MB for 50,000 tokens).
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import blocks

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Kept chunks and their characters; at these numbers the worker starts anew, so memory is bounded whatever the corpus.
KEPT, KEPT_CHARS = 400_000, 8_000_000
#: Longer chunks (texts without spaces) are not kept.
LONG = 100
#: Rows and bytes of text that are encoded at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8_000_000

_SPACES = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
_ASCII_UNSAFE = ["  ", *(x for c in _SPACES if c.isascii() for x in (f" {c}", f"{c} "))]
_UNSAFE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NONE = np.int64(1 << 40)


def merge_exactly(word: bytes, ranks: dict[bytes, int], most: int = 1 << 30) -> list[int]:
    """The ids of a word by merging the adjacent pair of least rank again and again, the leftmost of equals.

    Pairs wait in a heap and parts form a linked list, so that a word of n bytes takes n log n steps, however long it
    is. No token is longer than `most` bytes.
    """
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        # A pair is void once one of its parts has been merged with another.
        if middle == 0 or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if end[stop] - i <= most and (r := ranks.get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0 and stop - p <= most and (r := ranks.get(word[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Tables:
    """Arrays made from a rank file: trie, halves of each token, mergeable pairs."""

    def __init__(self, data: bytes):
        self.tokens = [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]
        ids = [int(line.split()[1]) for line in data.splitlines() if line.strip()]
        if ids != list(range(len(ids))):
            raise ValueError("ranks must be consecutive and start at 0")
        ranks = {t: i for i, t in enumerate(self.tokens)}
        self.left = np.arange(len(ids), dtype=np.int64)
        self.right = self.left.copy()
        pair_keys, pair_ids = [], []
        edges: dict[int, int] = {}
        terminal = [-1]
        for i, t in enumerate(self.tokens):
            node = 0
            for b in t:
                key = node << 8 | b
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(terminal)
                    terminal.append(-1)
            terminal[node] = i
            halves = [(a, b) for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
            pair_keys += [a << 24 | b for a, b in halves]
            pair_ids += [i] * len(halves)
            fit = [(a, b) for a, b in halves if a < i and b < i]
            if len(fit) == 1:
                self.left[i], self.right[i] = fit[0]
            elif fit:
                # The last merge of the token: merge its bytes with the lower ranks only.
                lower = {t[a:b]: r for a in range(len(t)) for b in range(a + 1, len(t) + 1) if (r := ranks.get(t[a:b])) is not None and r < i}
                last = merge_exactly(t, lower)
                self.left[i], self.right[i] = last if len(last) == 2 else fit[0]
        order = np.argsort(np.array(pair_keys, np.int64))
        self.pair_keys, self.pair_ids = np.array(pair_keys, np.int64)[order], np.array(pair_ids, np.int64)[order]
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.terminal = np.array(terminal, np.int64)


class Encoder:
    """Encodes texts with the tables of a vocabulary; keeps the ids of the chunks it has seen."""

    def __init__(self, tables: Tables, pattern: str = PATTERN, kept: int = KEPT):
        self.t, self.pattern, self.kept = tables, regex.compile(pattern), kept
        self.ranks = {t: i for i, t in enumerate(tables.tokens)}
        self.ids: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.longest = max(map(len, tables.tokens), default=0)
        self.exact = self.seen = self.chars = 0

    def _propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens and the word of each, in order."""
        size = np.array([len(w) for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        at, end, live = start[:-1].copy(), start[1:], np.arange(len(words))
        tokens, owners = [], []
        t = self.t
        while len(live):
            node, pos = np.zeros(len(live), np.int64), at[live]
            best, stop = np.full(len(live), -1, np.int64), pos.copy()
            go = np.arange(len(live))
            while len(go):
                key = node[go] << 8 | flat[pos[go]]
                k = np.minimum(np.searchsorted(t.edge_keys, key), len(t.edge_keys) - 1)
                hit = t.edge_keys[k] == key
                go = go[hit]
                node[go] = t.edge_to[k[hit]]
                pos[go] += 1
                found = t.terminal[node[go]]
                some = found >= 0
                best[go[some]], stop[go[some]] = found[some], pos[go[some]]
                go = go[pos[go] < end[live[go]]]
            tokens.append(best)
            owners.append(live)
            at[live] = stop
            live = live[stop < end[live]]
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return token[order], owner[order]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a + b ends with just a, b, for arrays of adjacent tokens.

        Undoes the merges of both sides from the last to the first; a pair across the border that would have
        merged before the side it takes from had been complete shows the proposal wrong.
        """
        t, fine = self.t, np.ones(len(a), bool)
        a, b, limit, go = a.copy(), b.copy(), np.full(len(a), _NONE), np.arange(len(a))
        while len(go):
            x, y = a[go], b[go]
            key = x << 24 | y
            k = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
            merged = np.where(t.pair_keys[k] == key, t.pair_ids[k], _NONE)
            wrong = merged < limit[go]
            fine[go[wrong]] = False
            go, x, y = go[~wrong], x[~wrong], y[~wrong]
            can_a, can_b = t.right[x] != x, t.left[y] != y
            undo_a = can_a & ((x > y) | ~can_b)
            undo_b = can_b & ~undo_a
            limit[go] = np.where(undo_a, x, y + 1)
            a[go] = np.where(undo_a, t.right[x], x)
            b[go] = np.where(undo_b, t.left[y], y)
            go = go[undo_a | undo_b]
        return fine

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of words that are new; very long ones are merged exactly at once, as proposals go token by token."""
        for w in [w for w in words if len(w) > LONG]:
            self.words[w] = tuple(merge_exactly(w.encode("utf-8", "replace"), self.ranks, self.longest))
        words = [w for w in words if len(w) <= LONG]
        if not words:
            return
        raw = [w.encode("utf-8", "replace") for w in words]
        token, owner = self._propose(raw)
        same = owner[1:] == owner[:-1]
        fine = np.ones(len(words), bool)
        fine[owner[1:][same][~self._compatible(token[:-1][same], token[1:][same])]] = False
        cut = np.searchsorted(owner, np.arange(len(words) + 1))
        listed = token.tolist()
        self.seen += len(words)
        self.exact += int((~fine).sum())
        for i, w in enumerate(words):
            self.words[w] = tuple(listed[cut[i] : cut[i + 1]]) if fine[i] else tuple(merge_exactly(raw[i], self.ranks, self.longest))

    def _chunks(self, text: str) -> list[str]:
        if text.isascii():
            unsafe = any(map(text.__contains__, _ASCII_UNSAFE))
        else:
            unsafe = _UNSAFE.search(text) is not None
        parts = _CUT.split(text) if unsafe else text.split(" ")
        if not unsafe and (parts[0] == "" or parts[-1] == ""):
            parts = _CUT.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, texts: list[str | None]) -> tuple[array, np.ndarray]:
        """Flat ids of all texts and the offsets of each; null and empty texts have none."""
        if max(len(self.ids), len(self.words)) > self.kept or self.chars > KEPT_CHARS:
            self.ids, self.words, self.chars = {}, {}, 0
        cut = [self._chunks(t) if t else [] for t in texts]
        new = list(set().union(*cut) - self.ids.keys()) if cut else []
        found = [self.pattern.findall(c) for c in new]
        self._learn(list(set(chain.from_iterable(found)) - self.words.keys()))
        for c, ws in zip(new, found):
            self.ids[c] = self.words[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(self.words.__getitem__, ws)))
        flat, offsets = array("i"), np.zeros(len(texts) + 1, np.int64)
        get = self.ids.__getitem__
        for i, c in enumerate(cut):
            flat.extend(chain.from_iterable(map(get, c)))
            offsets[i + 1] = len(flat)
        for c, ws in zip(new, found):
            if len(c) > LONG:
                del self.ids[c]
                for w in ws:
                    if len(w) > LONG:
                        self.words.pop(w, None)
            else:
                self.chars += len(c)
        return flat, offsets


_WORKER: dict[tuple, Encoder] = {}


def _encoder(shared, name: str) -> Encoder:
    """The worker's encoder, kept between the tasks of a worker."""
    key = (name,)
    if key not in _WORKER:
        _WORKER[key] = Encoder(shared.value)
    return _WORKER[key]


def load(spark: SparkSession, vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZERS):
    """The broadcast tables of a rank file."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return spark.sparkContext.broadcast(Tables(f.read()))


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZERS, keep: str | None = None) -> DataFrame:
    """One row per input row: `doc_id`, `ids` (array of int) without special tokens, and the column `keep` if one is named.

    Null and empty texts have the empty list; blank texts have the ids of their white space; special tokens'
    strings are ordinary text. Repeated rows come out as often as they come in; other columns, whatever their names,
    are ignored. Only a scan of fewer tasks than cores is shuffled.
    """
    shared = load(documents.sparkSession, vocabulary, folder)
    name = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name)
        for batch in batches:
            for part in blocks.parts(batch, 1, BATCH_ROWS, BATCH_BYTES):
                flat, offsets = encoder.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *part.columns[2:]], ["doc_id", "ids", *more])

    more = [keep] if keep else []
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return spread(rows).mapInArrow(run, ", ".join(["doc_id bigint", "ids array<int>", *(f"`{c}` {dict(rows.dtypes)[c]}" for c in more)]))


def token_counts(documents: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and `n_tokens` (bigint) of each row; null and empty texts have 0."""
    shared = load(documents.sparkSession, vocabulary, folder)
    name = f"{folder}/{vocabulary}"
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name)
        for batch in batches:
            for part in blocks.parts(batch, batch.num_columns - 1, BATCH_ROWS, BATCH_BYTES):
                _, offsets = encoder.encode(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(offsets))], [*keep, "n_tokens"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens bigint"])
    return spread(documents.select(*keep, F.col(text_col).cast("string").alias("_text"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """`doc_id`, `text` of rows `doc_id`, `ids`: the bytes of the tokens put together; bytes that are no text become replacement characters."""
    shared = load(encoded.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.tokens.__getitem__
        for batch in batches:
            texts = [None if ids is None else b"".join(map(get, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
