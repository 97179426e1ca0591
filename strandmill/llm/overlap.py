"""Problem 2: records of evaluation splits that also stand, exactly or almost, in the train split.

Two records overlap if at most a tenth of the words of the longer must be changed, added or dropped. The work goes

1. Index. The distinct evaluation texts, as words, are cut by length into shards of bounded size; each shard becomes a
   compressed full-text index (`WordIndex`: a compressed suffix array with a rank structure and sampled positions, from
   which the texts themselves can be read).
2. Search. Training texts are streamed past the shards of their lengths, unshuffled. Backward search cuts a text into
   windows, each extended to the left until it has at most so many occurrences (`windows`). An edit hits at most one
   window, so with m windows and K edits at least m - K stand unchanged in a partner; a text that has more than K windows
   without any occurrence has no partner. Windows of what remains are located, extended to maximal matches, and
   these are merged to spans and counted per pair.
3. Verify. Pairs with enough windows on near diagonals and nearly equal parities of word counts go through the exact
   edit distance of words.

Copies of an evaluation text (equal words) are indexed once and expanded last; those of a training text are searched
once per batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread
from . import blocks, folding

#: Words in a shard of the index, in the shards that one pass over the training texts searches, and in a batch of texts.
SHARD_WORDS = 1 << 20
PASS_WORDS = 1 << 24
BATCH_WORDS = 2_000_000
#: Every so many words of the indexed texts have their place stored.
SAMPLE = 8
#: Words that are searched or read one after another; longer texts are cut into so many, side by side.
LANE = 1024
#: Occurrences that a window may have: none first, then more for texts that have too few such windows.
LEVELS = (0, 2, 16, 128, 1024, 8192, 1 << 40)
#: Occurrences that are located at once, and copies in a block of the expansion.
LOCATED = 1_000_000
BLOCK = 1000


def longest_partner(n: np.ndarray) -> np.ndarray:
    """The most words that a text overlapping one of n words can have: the largest m with m - m // 10 <= n."""
    m = n * 10 // 9 + 1
    while (bad := m - m // 10 > n).any():
        m[bad] -= 1
    return m


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def sketches(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parities of word counts in 128 buckets, as two integers per text: an edit changes at most two of them."""
    of = np.repeat(np.arange(len(n)), n)
    bucket = (_mixed(flat + np.uint64(11)) >> np.uint64(57)).astype(np.int64)
    odd = np.bincount(of * 128 + bucket, minlength=len(n) * 128).reshape(-1, 2, 64).astype(np.uint64) & np.uint64(1)
    return (odd << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def suffix_order(whole: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `whole` (values below `symbols`) in order, and the place of each in that order.

    Suffixes are sorted by their first symbols, then those that are still equal by twice as many, and so on.
    """
    n, step = len(whole), 1
    key = whole.astype(np.int64)
    while step < 3 and symbols ** (step + 1) < 1 << 62:
        key = key * symbols + np.concatenate([whole[step:], np.zeros(min(step, n), np.int64)])
        step += 1
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    alone = first & np.concatenate([first[1:], [True]])
    open_ = np.flatnonzero(~alone)
    while len(open_):
        sub = order[open_]
        after = np.where(sub + step < n, rank[np.minimum(sub + step, n - 1)] + 1, 0)
        both = rank[sub] * (n + 1) + after
        by = np.argsort(both, kind="stable")
        sub, both = sub[by], both[by]
        order[open_] = sub
        first = np.concatenate([[True], both[1:] != both[:-1]])
        rank[sub] = np.maximum.accumulate(np.where(first, open_, 0))
        open_ = open_[~(first & np.concatenate([first[1:], [True]]))]
        step *= 2
    return order, rank


class WordIndex:
    """Compressed full-text index of texts given as word hashes.

    The texts stand one after another with a separator (symbol 0) before, between and after them. For the suffix in row
    i of the suffix array, `symbol(i) * (n + 1) + psi(i)`, with psi the row of the suffix that starts one word later, is
    ascending in i. It is held in two parts: the leading bits as starts of buckets, the rest of each value in 16 bits.
    A step of backward search counts smaller values in a bucket; reading the values forward gives the texts back. Every
    `SAMPLE`-th place is stored, with a bitmap of the rows that have one. This takes some 4 bytes a word.
    """

    def __init__(self, texts: list[np.ndarray]):
        size = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[1], 1 + np.cumsum(size + 1)])[:-1]
        self.vocabulary, coded = np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]), return_inverse=True)
        self.n = n = int(size.sum()) + len(texts) + 1
        whole = np.zeros(n, np.int64)
        inside = np.arange(len(coded)) + 1 + np.repeat(np.arange(len(texts)), size)
        whole[inside] = coded + 1
        order, rank = suffix_order(whole, len(self.vocabulary) + 1)
        # The rows where the texts start, and again after each `LANE` words.
        lanes = -(-size // LANE)
        self.lanes = np.cumsum(lanes) - lanes
        inner = np.arange(int(lanes.sum())) - np.repeat(self.lanes, lanes)
        self.home = rank[np.repeat(self.starts, lanes) + inner * LANE].astype(np.uint32)
        value = whole[order] * (n + 1) + rank[(order + 1) % n]
        # As many leading bits as give about one bucket for two words, or one for each if 16 bits are left then.
        top = (len(self.vocabulary) + 1) * (n + 1)
        self.bits = (2 * top // n).bit_length()
        self.bits -= self.bits == 17
        kind = np.uint16 if self.bits <= 16 else np.uint32
        self.low = (value & ((1 << self.bits) - 1)).astype(kind)
        self.first = np.searchsorted(value >> self.bits, np.arange((top >> self.bits) + 2)).astype(np.uint32)
        self.rows = np.searchsorted(value, np.arange(len(self.vocabulary) + 2) * (n + 1)).astype(np.uint32)
        marked = order % SAMPLE == 0
        self.places = (order[marked] // SAMPLE).astype(np.uint32)
        padded = np.zeros(-(-n // 64) * 64, np.uint8)
        padded[:n] = marked
        self.marks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks))])[:-1].astype(np.uint32)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbols of words, -1 for those that no text has."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def below(self, value: np.ndarray) -> np.ndarray:
        """How many of the index's values are smaller than each of these: a binary search in its bucket."""
        bucket, want = value >> self.bits, (value & ((1 << self.bits) - 1)).astype(self.low.dtype)
        low, high = self.first[bucket].astype(np.int64), self.first[bucket + 1].astype(np.int64)
        go = np.flatnonzero(low < high)
        while len(go):
            a, b = low[go], high[go]
            mid = (a + b) >> 1
            less = self.low[mid] < want[go]
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            low[go], high[go] = a, b
            go = go[a < b]
        return low

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows of symbol + pattern from those of the pattern. No row for symbol -1."""
        known = np.maximum(symbol, 0)
        start, stop = self.rows[known].astype(np.int64), self.rows[known + (symbol >= 0)].astype(np.int64)
        # All rows of a symbol for an empty pattern; else those between its first and last with the pattern after it.
        go = np.flatnonzero((high - low < self.n) & (start < stop))
        base = known[go] * (self.n + 1)
        both = self.below(np.concatenate([base + low[go], base + high[go]]))
        start[go], stop[go] = both[: len(go)], both[len(go) :]
        return start, stop

    def forward(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first symbol of the suffix in each row, and the row of the suffix after it."""
        bucket = np.searchsorted(self.first, row.astype(np.uint32), side="right") - 1
        value = bucket << self.bits | self.low[row].astype(np.int64)
        symbol = value // (self.n + 1)
        return symbol, value - symbol * (self.n + 1)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start: forward to the next stored place."""
        out, row, go, walked = np.zeros(len(row), np.int64), row.copy(), np.arange(len(row)), 0
        while len(go):
            word, bit = row >> 6, (row & 63).astype(np.uint64)
            mark = self.marks[word] >> bit & np.uint64(1) == 1
            at = self.before[word[mark]] + np.bitwise_count(self.marks[word[mark]] & ((np.uint64(1) << bit[mark]) - np.uint64(1)))
            # Walking over the end goes on at the start.
            out[go[mark]] = (self.places[at].astype(np.int64) * SAMPLE - walked) % self.n
            go, row = go[~mark], row[~mark]
            if len(go):
                row = self.forward(row)[1]
            walked += 1
        return out

    def texts(self, number: np.ndarray) -> list[np.ndarray]:
        """The symbols of texts by number, read from the index, all lanes of `LANE` words at once."""
        size = np.diff(self.starts, append=self.n)[number] - 1
        lanes = -(-size // LANE)
        ends = np.cumsum(size)
        inner = (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        left, at = np.minimum(LANE, np.repeat(size, lanes) - inner), np.repeat(ends - size, lanes) + inner
        row = self.home[np.repeat(self.lanes[number], lanes) + inner // LANE].astype(np.int64)
        order = np.argsort(-left, kind="stable")
        left, at, row = left[order], at[order], row[order]
        out, k = np.zeros(int(size.sum()), np.int64), 0
        while many := int(np.searchsorted(-left, -k, side="left")):
            out[at[:many] + k], row = self.forward(row[:many])
            k += 1
        return np.split(out, ends[:-1])


def windows(index: WordIndex, flat: np.ndarray, first: np.ndarray, stop: np.ndarray, text: np.ndarray, most: int, enough: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Lanes cut from their ends into windows of words with at most `most` occurrences: (text, start, end, low, high row).

    Lane k has the symbols `flat[first[k] : stop[k]]` and is part of `text[k]`. A window is extended to the left until it
    is rare enough, so no cut of a lane gives more windows. With `enough`, a text is left as soon as it has so many.
    """
    out: list[tuple[np.ndarray, ...]] = []
    pos, end, low, high = stop - 1, stop.copy(), np.zeros(len(first), np.int64), np.full(len(first), index.n, np.int64)
    number = np.zeros(0 if enough is None else len(enough), np.int64)
    while len(text):
        low, high = index.step(flat[pos], low, high)
        cut = high - low <= most
        if cut.any():
            out.append((text[cut], pos[cut], end[cut], low[cut], high[cut]))
            end, low, high = np.where(cut, pos, end), np.where(cut, 0, low), np.where(cut, index.n, high)
            if enough is not None:
                np.add.at(number, text[cut], 1)
        pos = pos - 1
        go = pos >= first
        if enough is not None:
            go &= number[text] < enough[text]
        if not go.all():
            text, first, pos, end, low, high = text[go], first[go], pos[go], end[go], low[go], high[go]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out))


def edit_distance(a: list, b: list, most: int) -> int:
    """Words to change, add or drop to get b from a, or most + 1 if more: furthest-reaching diagonals."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1

    def slide(i: int, d: int) -> int:
        while i < n and i + d < m and a[i] == b[i + d]:
            i += 1
        return i

    reach = {0: slide(0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        new = {}
        for d in range(-e - 1, e + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            if i >= 0 and -n <= d <= m and abs(d - (m - n)) <= most:
                i = min(i, n, m - d)
                new[d] = slide(i, d)
        reach = new
    return most + 1


def spans(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, shift: np.ndarray) -> tuple[int, int]:
    """(words of `a` covered, number of maximal matches) of windows a[start:end] == b[start + shift : end + shift].

    Each window is extended both ways while the words are equal; windows of one maximal match count once.
    """
    matches: set[tuple[int, int, int]] = set()
    for s, e, d in sorted(zip(start.tolist(), end.tolist(), shift.tolist())):
        if any(x <= s and e <= y and d == z for x, y, z in matches):
            continue
        left = a[max(0, -d) : s][::-1] != b[max(0, d) : s + d][::-1]
        right = a[e : len(b) - d] != b[e + d : len(a) + d]
        x = s - (int(left.argmax()) if left.any() else len(left))
        y = e + (int(right.argmax()) if right.any() else len(right))
        matches.add((x, y, d))
    covered, reach = 0, 0
    for x, y, _ in sorted(matches):
        covered += max(0, y - max(x, reach))
        reach = max(reach, y)
    return covered, len(matches)


class Words:
    """Numbers of words as they come, with the hash of each; to be renewed at a number of words, so memory is bounded."""

    def __init__(self, kept: int = 500_000):
        self.kept = kept
        self.number, self.hashes, self.tables = {}, np.zeros(0, np.uint64), {}

    def full(self) -> bool:
        return len(self.number) > self.kept

    def renew(self) -> None:
        """Forget all words if there are too many; numbers given before are void then."""
        if self.full():
            self.number, self.hashes, self.tables = {}, np.zeros(0, np.uint64), {}

    def __call__(self, listed: list[list[str]]) -> np.ndarray:
        """The numbers of all words, one text after another."""
        new = list(set().union(*listed) - self.number.keys())
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        get = self.number.__getitem__
        return np.fromiter(map(get, chain.from_iterable(listed)), np.int64, sum(map(len, listed)))

    def symbols(self, key: int, index: WordIndex) -> np.ndarray:
        """The symbols in an index of all words so far."""
        table = self.tables.get(key, np.zeros(0, np.int64))
        if len(table) < len(self.hashes):
            table = self.tables[key] = np.concatenate([table, index.symbols(self.hashes[len(table) :])])
        return table


def class_key(ws: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(ws).encode("utf-8", "replace"))


class Shard:
    """The index of some evaluation texts with what is known of each: record, number of words, parities."""

    def __init__(self, ids: list[int], texts: list[np.ndarray]):
        self.ids, self.size = np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64)
        self.index = WordIndex(texts)
        self.parities = sketches(np.concatenate(texts), self.size)

    def candidates(self, words: np.ndarray, n: np.ndarray, parities: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For texts of symbols one after another: (text, indexed text, windows in common) with arrays of (pair, start, end, shift).

        Every pair that overlaps is among them.
        """
        index, starts = self.index, np.concatenate([[0], np.cumsum(n)])[:-1]
        partner = np.minimum(longest_partner(n.copy()), int(self.size.max()))
        budget = np.maximum(n, partner) // 10
        todo = np.flatnonzero((n - n // 10 <= self.size.max()) & (longest_partner(n.copy()) >= self.size.min()))
        if not len(todo):
            return
        # Each text with a separator before and after it; long ones as several lanes, so that no lane is long.
        padded = np.zeros(len(words) + 2 * len(n), np.int64)
        first = starts + 2 * np.arange(len(n))
        stop = first + n + 2
        padded[np.arange(len(words)) + 1 + 2 * np.repeat(np.arange(len(n)), n)] = words
        for most in LEVELS:
            lanes = -(-(stop - first)[todo] // LANE)
            of = np.repeat(todo, lanes)
            a = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
            b = np.minimum(a + LANE, stop[of])
            text, start, end, low, high = windows(index, padded, a, b, of, most, budget + 1 if most == 0 else None)
            # A separator alone says nothing.
            telling = (end - start > 1) | (padded[start] != 0)
            text, start, end, low, high = (x[telling] for x in (text, start, end, low, high))
            number = np.bincount(text, minlength=len(n))
            if most == 0:
                todo = todo[number[todo] <= budget[todo]]
                continue
            ready = number > budget
            keep = ready[text]
            yield from self._met([x[keep] for x in (text, start - first[text] - 1, end - first[text] - 1, low, high)], n, parities, number, budget)
            todo = todo[~ready[todo]]
            if not len(todo):
                return

    def _met(self, found: list[np.ndarray], n: np.ndarray, parities: np.ndarray, number: np.ndarray, budget: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        text, start, end, low, high = found
        order = np.lexsort((high - low, text))
        text, start, end, low, high = (x[order] for x in (text, start, end, low, high))
        times = high - low
        edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
        # The rarest windows of a text that has many occurrences: as many as are needed, and more while these are few.
        total = np.cumsum(times)
        before = np.repeat(total[edge] - times[edge], np.diff(np.concatenate([edge, [len(text)]])))
        place = np.arange(len(text)) - np.repeat(edge, np.diff(np.concatenate([edge, [len(text)]])))
        keep = (place <= budget[text]) | (total - before <= LOCATED // 8)
        text, start, end, low, times = text[keep], start[keep], end[keep], low[keep], times[keep]
        number = np.bincount(text, minlength=len(n))
        edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else []
        total, at = np.cumsum(times), 0
        for k in [*edge[1:], len(text)]:
            if k == len(text) or total[k - 1] - (total[at - 1] if at else 0) > LOCATED // 2:
                if k > at:
                    yield self._pairs(text[at:k], start[at:k], end[at:k], low[at:k], times[at:k], n, parities, number)
                at = k

    def _pairs(self, text, start, end, low, times, n, parities, number) -> tuple[np.ndarray, ...]:
        index = self.index
        w = np.repeat(np.arange(len(text)), times)
        row = np.repeat(low, times) + np.arange(len(w)) - np.repeat(np.cumsum(times) - times, times)
        place = index.locate(row)
        # A window's last word, or the separator after it, tells the text.
        mate = np.searchsorted(index.starts, place + (end - start)[w], side="left") - 1
        t = text[w]
        shift = place - index.starts[mate] - start[w]
        budget = np.maximum(n[t], self.size[mate]) // 10
        near = (np.abs(shift) <= budget) & (np.abs(n[t] - self.size[mate]) <= budget)
        w, t, mate, shift, budget = w[near], t[near], mate[near], shift[near], budget[near]
        odd = np.bitwise_count(parities[t] ^ self.parities[mate]).sum(axis=1)
        near = odd <= 2 * budget
        w, t, mate, shift, budget = w[near], t[near], mate[near], shift[near], budget[near]
        order = np.lexsort((np.abs(shift), w, mate, t))
        w, t, mate, shift, budget = w[order], t[order], mate[order], shift[order], budget[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (mate[1:] != mate[:-1])]) if len(t) else np.zeros(0, bool)
        pair = np.cumsum(new) - 1
        once = np.concatenate([[True], (pair[1:] != pair[:-1]) | (w[1:] != w[:-1])]) if len(t) else new
        hits = np.bincount(pair, weights=once, minlength=int(new.sum()))
        # Of a text's windows at most one per edit is changed.
        good = hits >= number[t[new]] - budget[new]
        keep = good[pair] if len(pair) else new
        renamed = np.cumsum(good) - 1
        return t[new][good], mate[new][good], renamed[pair[keep]], start[w[keep]], end[w[keep]], shift[keep]

    def search(self, words: np.ndarray, n: np.ndarray, parities: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, record, words of the longer, words covered by maximal matches, their number, edits) of every overlap."""
        starts = np.concatenate([[0], np.cumsum(n)])
        for t, mate, pair, start, end, shift in self.candidates(words, n, parities):
            if not len(t):
                continue
            unique, at = np.unique(mate, return_inverse=True)
            read = self.index.texts(unique)
            cut = np.searchsorted(pair, np.arange(len(t) + 1))
            for k, i in enumerate(t.tolist()):
                a, b = words[starts[i] : starts[i + 1]], read[at[k]]
                longer = max(len(a), len(b))
                edits = edit_distance(a.tolist(), b.tolist(), longer // 10)
                if edits <= longer // 10:
                    own = slice(cut[k], cut[k + 1])
                    covered, matches = spans(a, b, np.maximum(start[own], 0), np.minimum(end[own], len(a)), shift[own])
                    yield i, int(self.ids[mate[k]]), longer, covered, matches, edits


_PAIRS = "train_id bigint, eval_id bigint, words int, covered int, matches int, edits int"


def _search(batches: Iterator[pa.RecordBatch], shards: list[Shard]) -> Iterator[pa.RecordBatch]:
    """Training texts past the shards; copies in a batch are searched once."""
    words, held, size = Words(), {}, 0

    def run() -> Iterator[pa.RecordBatch]:
        ids = [v[0] for v in held.values()]
        flat = np.concatenate([v[1] for v in held.values()])
        n = np.array([len(v[1]) for v in held.values()], np.int64)
        parities = sketches(words.hashes[flat], n)
        rows = [(r, *rest) for k, shard in enumerate(shards) for i, *rest in shard.search(words.symbols(k, shard.index)[flat], n, parities) for r in ids[i]]
        if rows:
            kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["train_id", "eval_id", "words", "covered", "matches", "edits"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            new: dict[bytes, list[str]] = {}
            for r, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if ws := folding.words(text):
                    key = class_key(ws)
                    held.setdefault(key, ([], None))[0].append(r)
                    if held[key][1] is None:
                        new[key] = ws
            flat, ends = words(list(new.values())), np.cumsum([len(ws) for ws in new.values()])
            for key, numbers in zip(new, np.split(flat, ends[:-1])):
                held[key] = (held[key][0], numbers)
            size += len(flat)
            if size > BATCH_WORDS or words.full():
                yield from run()
                held, size = {}, 0
                words.renew()
    if held:
        yield from run()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`record_id`, `class`, `n` (words) and `hashes` (8 bytes a word) of texts that have words."""
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            pairs = [(r, ws) for r, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if (ws := folding.words(t))]
            if pairs:
                listed = [ws for _, ws in pairs]
                n = np.array([len(ws) for ws in listed], np.int64)
                words.renew()
                flat = words(listed)
                raw, ends = words.hashes[flat], np.cumsum(n)
                cols = [pa.array([r for r, _ in pairs], pa.int64()), pa.array([class_key(ws) for ws in listed], pa.binary()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([raw[e - k : e].tobytes() for e, k in zip(ends, n)], pa.binary())], ["record_id", "class", "n", "hashes"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`record_id`, `side` and `class` of texts that have words."""
    for batch in batches:
        keys = [class_key(ws) if (ws := folding.words(t)) else None for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary())], ["record_id", "side", "class"])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    shard = Shard(pdf["record_id"].tolist(), [np.frombuffer(h, np.uint64) for h in pdf["hashes"]])
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_words": [int(shard.size.sum())], "data": [pickle.dumps(shard, 5)]})


def length_bands(rows: list[tuple[int, int, int]], most: int = SHARD_WORDS) -> list[tuple[int, int, int]]:
    """(band, first shard, number of shards) of bands of lengths (band, texts, words): bands in order share a shard up to `most` words."""
    out, shard, filled = [], 0, 0
    for band, _, n_words in sorted(rows):
        if n_words > most:
            shard += filled > 0
            parts = -(-n_words // most)
            out.append((band, shard, parts))
            shard, filled = shard + parts, 0
            continue
        if filled + n_words > most:
            shard, filled = shard + 1, 0
        out.append((band, shard, 1))
        filled += n_words
    return out


def _sides(records: DataFrame, train: str, evaluation: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    rows = records.where("record_id is not null and text is not null").select(F.col("record_id").cast("bigint").alias("record_id"), F.col("text").cast("string").alias("text"), "split")
    return rows.where(F.col("split") == train).select("record_id", "text"), rows.where(F.col("split").isin(*evaluation)).select("record_id", "text")


def index_shards(evaluation: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """The index of texts (`record_id`, `text`): shards (`shard`, `n_words`, `data`), and `record_id`, `eval_id` (least record with equal words).

    Shards hold texts of similar lengths, so that a text is searched in few of them.
    """
    folded = checkpoint(spread(evaluation).mapInArrow(_folded, "record_id bigint, class binary, n bigint, hashes binary"))
    distinct = folded.groupBy("class").agg(F.min("record_id").alias("record_id"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    members = folded.select(F.col("record_id"), "class").join(folded.groupBy("class").agg(F.min("record_id").alias("eval_id")), "class").select("record_id", "eval_id").distinct()
    # Bands: each number of words up to 512, then steps of a hundredth. There are a few thousand, whatever the table.
    band = F.when(F.col("n") <= 512, F.col("n")).otherwise(512 + F.floor(100 * F.log(F.col("n") / 512))).cast("bigint")
    distinct = distinct.withColumn("band", band)
    lengths = [tuple(r) for r in distinct.groupBy("band").agg(F.count(F.lit(1)), F.sum("n")).collect()]
    spark = evaluation.sparkSession
    placed = spark.createDataFrame(length_bands(lengths, shard_words), "band bigint, shard bigint, parts bigint")
    cut = distinct.join(F.broadcast(placed), "band").withColumn("shard", F.col("shard") + F.pmod(F.xxhash64("class"), "parts"))
    shards = cut.select("shard", "record_id", "hashes").groupBy("shard").applyInPandas(_build, "shard bigint, n_words bigint, data binary")
    return checkpoint(shards), members


def overlapping_texts(records: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS) -> tuple[DataFrame, DataFrame]:
    """Overlaps of train records with distinct evaluation texts, and which records have those texts.

    The first has `train_id`, `eval_id` (the least record with that text), `words` of the longer, `covered` (words in
    maximal matches), `matches`, `edits`; the second `record_id`, `eval_id`. Null texts and texts without words are in none.
    """
    sides = _sides(records, train, evaluation)
    shards, members = index_shards(sides[1], shard_words)
    out = records.sparkSession.createDataFrame([], _PAIRS)
    sizes = sorted(tuple(r) for r in shards.select("shard", "n_words").collect())
    texts, at = spread(sides[0]), 0
    while at < len(sizes):
        # One pass over the training texts for as many shards as fit: about 4 bytes a word are held at once.
        end, held = at, 0
        while end < len(sizes) and (end == at or held + sizes[end][1] <= pass_words):
            held += sizes[end][1]
            end += 1
        mine = shards.where(F.col("shard").between(sizes[at][0], sizes[end - 1][0])).select("shard", "data").collect()
        shared = records.sparkSession.sparkContext.broadcast([bytes(r[1]) for r in sorted(mine)])
        found = texts.mapInArrow(lambda it, shared=shared: _search(it, [pickle.loads(x) for x in shared.value]), _PAIRS)
        out = found if at == 0 else out.unionByName(found)
        at = end
    return out, members


def overlaps(records: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), block: int = BLOCK, shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """Pairs of a train and an evaluation record that overlap: `train_id`, `eval_id`, each once.

    Copies (equal words) of an evaluation text are paired in full; a text with more than `block` copies or partners in
    blocks of so many. Null and blank texts and records without an id are in no pair; a record delivered again counts
    once. Empty tables give none.
    """
    found, members = overlapping_texts(records, train, evaluation, shard_words, pass_words)
    found = checkpoint(found.select("train_id", F.col("eval_id").alias("text")).distinct())
    members = members.select(F.col("record_id").alias("eval_id"), F.col("eval_id").alias("text"))
    sized = found.groupBy("text").agg(F.count(F.lit(1)).alias("n_train")).join(members.groupBy("text").agg(F.count(F.lit(1)).alias("n_eval")), "text")
    large = checkpoint(sized.where(F.greatest("n_train", "n_eval") > block))
    if large.isEmpty():
        return found.join(members, "text").where("train_id != eval_id").select("train_id", "eval_id").distinct()
    full = found.join(large, "text", "left_anti").join(members, "text").select("train_id", "eval_id")
    pairs, sides = large, []
    for i, (side, rows) in enumerate((("train", found), ("eval", members)), 1):
        parts = F.ceil(F.col(f"n_{side}") / block)
        pairs = pairs.withColumn(f"part_{i}", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        part = F.pmod(F.xxhash64(f"{side}_id"), parts)
        sides.append(rows.join(large.select("text", f"n_{side}"), "text").select(F.struct("text", part.alias("part")).alias(f"block_{i}"), f"{side}_id"))
    pairs = pairs.select(*[F.struct("text", F.col(f"part_{i}").alias("part")).alias(f"block_{i}") for i in (1, 2)])
    return full.unionByName(blocks.cross(pairs, *sides).select("train_id", "eval_id")).where("train_id != eval_id").distinct()


def as_pairs(found: DataFrame) -> DataFrame:
    """`record_id_1` < `record_id_2` of the pairs."""
    return found.select(F.least("train_id", "eval_id").alias("record_id_1"), F.greatest("train_id", "eval_id").alias("record_id_2")).distinct()


def overlap_classes(records: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """One row per record and side with words: `record_id`, `side` (train, evaluation), `class_id` (least record with equal words), `n_links`.

    `n_links` is the number of different texts of the other side that overlap it (its own copies there count as one).
    """
    sides = _sides(records, train, evaluation)
    both = [s.select("record_id", "text", F.lit(k).alias("side")) for s, k in zip(sides, ("train", "evaluation"))]
    keyed = checkpoint(spread(both[0].unionByName(both[1])).mapInArrow(_keyed, "record_id bigint, side string, class binary").where("class is not null").distinct())
    classes = keyed.groupBy("class").agg(F.min("record_id").alias("class_id"))
    rows = keyed.join(classes, "class").select("record_id", "side", "class_id")
    found = overlapping_texts(records, train, evaluation)[0].select("train_id", "eval_id").distinct()
    of = {s: rows.where(F.col("side") == s).select(F.col("record_id").alias(c), F.col("class_id").alias(k)) for s, c, k in (("train", "train_id", "own"), ("evaluation", "eval_id", "other"))}
    links = checkpoint(found.join(of["train"], "train_id").join(of["evaluation"], "eval_id").select("own", "other").distinct())
    counted = links.groupBy(F.col("own").alias("class_id"), F.lit("train").alias("side")).agg(F.count(F.lit(1)).alias("n_links"))
    counted = counted.unionByName(links.groupBy(F.col("other").alias("class_id"), F.lit("evaluation").alias("side")).agg(F.count(F.lit(1)).alias("n_links")))
    return rows.join(counted, ["class_id", "side"], "left").na.fill(0, ["n_links"]).select("record_id", "side", "class_id", "n_links")


def overlap_report(records: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Per evaluation split and source: `n_records`, `n_overlapping` (with a train record) and their `share`."""
    found, members = overlapping_texts(records, train, evaluation)
    # A record that stands on both sides with one text is no partner of itself.
    met = found.groupBy(F.col("eval_id").alias("text")).agg(F.min("train_id").alias("least"), F.max("train_id").alias("most"))
    hit = members.join(met, F.col("eval_id") == F.col("text")).where("least != record_id or most != record_id").select(F.col("record_id").alias("_id")).distinct()
    each = records.where(F.col("split").isin(*evaluation)).where("record_id is not null").select("record_id", "split", "source").distinct()
    return (
        each.join(hit, F.col("record_id") == F.col("_id"), "left")
        .groupBy("split", "source")
        .agg(F.countDistinct("record_id").alias("n_records"), F.countDistinct("_id").alias("n_overlapping"))
        .withColumn("share", F.col("n_overlapping") / F.col("n_records"))
    )
