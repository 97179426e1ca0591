"""Problem 4: passages of evaluation items inside corpus documents.

Q-gram lemma filtering. The passages (question and choices of each item, as folded words) are a stated query set: they
are indexed by character q-grams in blocks of bounded size, and each block is broadcast. Documents stream past: their
q-grams are hashed array-wise, matches are counted in diagonal bands of (document, passage), bands that can't hold
enough shared q-grams for a passage of the least length within the edit budget are dropped, and what remains is verified
by banded alignment of words. Edits are of words: with an edit budget the q-grams are runs of words and the diagonals
count words, as one edit of a word may change any number of characters. Documents are not shuffled (but for a scan of fewer tasks than cores).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import blocks, folding

Q = 12
#: Words in a q-gram where words may be edited, at most.
Q_WORDS = 3
MIN_WORDS = 10
#: Characters of items in one broadcast index; more items make more blocks, each a pass over the documents. An index takes
#: at most 12 bytes a character (8 for a q-gram's hash, 4 for its place), 8 a word and a filter of 16 MB: under 100 MB.
BLOCK_CHARS = 4_000_000
#: A q-gram that occurs more often in the passages is common; passages that can be found without theirs leave them out.
COMMON = 50
#: Rows and bytes of documents that are searched at once, and matches that are expanded at once.
BATCH_ROWS, BATCH_BYTES, MATCHES = 1000, 4_000_000, 2_000_000
#: Alignments that are made at once.
JOBS = 20_000
_LEAD = re.compile(r"^\s*question\s*:\s*")
_TAIL = re.compile(r"\s*answer\s*:\s*$")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")


def passages(prompt: str | None, choices: list[str | None] | None) -> list[tuple[int, list[str]]]:
    """The (kind, words) of an item: -1 the question, 0.. the choices."""
    out = []
    if prompt:
        text = _TAIL.sub("", _LEAD.sub("", folding.fold(prompt)))
        out.append((-1, _WORD.findall(text)))
    out += [(i, folding.words(c)) for i, c in enumerate(choices or []) if c]
    return out


def q_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q codes, by doubling: log q array operations."""
    part, length, power = codes.astype(np.uint64), 1, _BASE
    out, size = None, 0
    with np.errstate(over="ignore"):
        while True:
            if q & length:
                n = len(codes) - size - length + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = part[:n] if out is None else out[:n] * power + part[size : size + n]
                size += length
            n = len(part) - length
            if length * 2 > q or n <= 0:
                break
            part = part[:n] * power + part[length:]
            power = power * power
            length *= 2
        if size < q:
            return np.zeros(0, np.uint64)
        out = out ^ (out >> np.uint64(31))
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def word_codes(listed: list[list[str]]) -> np.ndarray:
    """Hashes of the words of all texts one after another, with a 1 (no word's) after each text."""
    code = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) | 2 for w in set().union(*listed)}
    return np.fromiter((c for ws in listed for c in (*map(code.__getitem__, ws), 1)), np.uint64)


@dataclass
class Index:
    """The q-gram index of a block of passages."""

    q: int
    keys: np.ndarray  # sorted hashes
    at: np.ndarray  # their positions in the joined passages
    starts: np.ndarray  # where each passage starts
    codes: np.ndarray  # hashes of the words of all passages
    cuts: np.ndarray  # where the words of each passage start, in words
    places: np.ndarray | None  # where each word starts in the joined passages, in characters
    items: list[list[tuple[int, int]]]  # the (item, kind)s of each passage
    least: np.ndarray  # shared q-grams that a region of each passage must have
    seen: np.ndarray  # filter: which leading hash bits occur
    by_words: bool  # whether q and positions count words, not characters


def build(items: list[tuple[int, str | None, list | None]], q: int, min_words: int, edits: int, common: int = COMMON) -> Index | None:
    """Index of all passages of at least `min_words` words; equal passages are indexed once. None if there are none.

    Without edits, q-grams are of characters: a region of `min_words` equal words holds all q-grams of these words.
    `edits` edits of words leave the matched words in at most `edits` + 1 runs, which have
    `min_words - (edits + 1) * (w - 1)` runs of w words or more, on diagonals at most `edits` apart; w is as large as that
    is at least 1, up to Q_WORDS. A passage leaves out its q-grams that occur more than `common` times if every region
    has others; regions then need as many of those as any of them has at least, so that none is lost.
    """
    unique: dict[str, list[tuple[int, int]]] = {}
    for item, prompt, choices in items:
        for kind, ws in passages(prompt, choices):
            if len(ws) >= min_words:
                unique.setdefault(" ".join(ws), []).append((item, kind))
    if not unique:
        return None
    texts = list(unique)
    listed = [t.split(" ") for t in texts]
    size = np.array([len(ws) for ws in listed], np.int64)
    cuts = np.concatenate([[0], np.cumsum(size)])
    spaced = word_codes(listed)
    codes = spaced[spaced != 1]
    places = None
    if edits:
        q = min(Q_WORDS, max(min_words - 1, 0) // (edits + 1) + 1)
        joined, starts = spaced, np.concatenate([[0], np.cumsum(size + 1)])
        word_at = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), size)
    else:
        joined = np.frombuffer("\x00".join(texts).encode("utf-32-le", "replace"), np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        lengths = np.fromiter((len(w) + 1 for ws in listed for w in ws), np.int64)
        word_at = places = np.cumsum(lengths) - lengths
    hashes = q_hashes(joined, q)
    ends = starts[1:] - 1
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(hashes)]
    inside = np.arange(len(hashes)) + q <= ends[owner]
    number = np.unique(hashes[inside], return_inverse=True, return_counts=True)
    often = np.zeros(len(joined) + 1, bool)
    often[: len(hashes)][inside] = number[2][number[1]] > common
    held = np.zeros(len(joined) + 1, bool)
    held[: len(hashes)] = inside
    # Of each region of the least length: its q-grams, and those of them that aren't common.
    width = min_words + edits
    region = np.flatnonzero(np.arange(len(codes)) + min_words <= cuts[np.repeat(np.arange(1, len(cuts)), size)])
    of = np.repeat(np.arange(len(texts)), size)[region]
    last = np.minimum(region + width, cuts[of + 1]) - 1
    low = word_at[region]
    high = word_at[last] + (1 if edits else lengths[last] - 1) - q + 1

    def total(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[np.maximum(high, low)] - upto[low]

    if edits:
        whole = np.full(len(region), min_words - (edits + 1) * (q - 1))
        rare = whole - total(held & often)
    else:
        whole, rare = total(held), total(held & ~often)
    edge = np.searchsorted(of, np.arange(len(texts)))
    least, without = np.minimum.reduceat(whole, edge), np.minimum.reduceat(rare, edge)
    leaves = without >= 1
    use = np.flatnonzero(inside & ~(often[: len(hashes)] & leaves[owner]))
    order = use[np.argsort(hashes[use], kind="stable")]
    bits = max(16, min(24, int(len(order)).bit_length() + 5))
    seen = np.zeros(1 << bits, bool)
    seen[(hashes[order] >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Index(q, hashes[order], order.astype(np.uint32), starts[:-1], codes, cuts, places, list(unique.values()), np.maximum(1, np.where(leaves, without, least)), seen, edits > 0)


#: A cell of an alignment as one integer: score, matches and edits in 12 bits each, the text word where it starts in 26.
_SCORE, _MATCH, _EDIT = 1 << 50, 1 << 38, 1 << 26
_FIELD, _START = (1 << 12) - 1, (1 << 26) - 1


def align(passage: np.ndarray, size: np.ndarray, first: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, shift: np.ndarray, width: int) -> np.ndarray:
    """Banded alignments, all at once, of passages with texts; columns: longest run, words matched, edits, first text word.

    Job k aligns the words `passage[first[k] : first[k] + size[k]]` with `text[begin[k] : end[k]]`, word i of the first near
    word i + shift[k] of the second, within `width`. The run is of equal consecutive words; the others are of the best
    local alignment: a match counts 1, an edit -1.
    """
    jobs, band = len(size), 2 * width + 1
    before, length = np.zeros((jobs, band + 1), np.int64), np.zeros((jobs, band), np.int64)
    top, best, run = np.zeros(jobs, np.int64), np.zeros(jobs, np.int64), np.zeros(jobs, np.int64)
    order = np.argsort(-size, kind="stable")
    size, first, begin, shift = size[order], first[order], begin[order], shift[order]
    limit = end[order] - begin
    columns = np.arange(band) - width
    for i in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -i, side="left"))
        place = i + shift[:n, None] + columns
        inside = (place >= 0) & (place < limit[:n, None])
        words = text[np.where(inside, begin[:n, None] + place, 0)]
        equal = inside & (words == passage[first[:n] + i][:, None])
        was = before[:n]
        diagonal, above = was[:, :band], was[:, 1:]
        matched = np.where(diagonal > 0, diagonal, place & _START) + (_SCORE + _MATCH)
        lost = np.maximum(diagonal, above) - (_SCORE - _EDIT)
        now = np.zeros((n, band + 1), np.int64)
        side = np.zeros(n, np.int64)
        for c in range(band):
            cell = np.where(equal[:, c], matched[:, c], np.maximum(lost[:, c], side - (_SCORE - _EDIT)))
            side = now[:, c] = np.where((cell >= _SCORE) & inside[:, c], cell, 0)
        before[:n] = now
        length[:n] = np.where(equal, length[:n] + 1, 0)
        run[:n] = np.maximum(run[:n], length[:n].max(axis=1))
        at = (now[:, :band] // _SCORE).argmax(axis=1)
        cell = now[np.arange(n), at]
        more = cell // _SCORE > top[:n]
        top[:n], best[:n] = np.where(more, cell // _SCORE, top[:n]), np.where(more, cell, best[:n])
    out = np.empty((jobs, 4), np.int64)
    out[order] = np.stack([run, best >> 38 & _FIELD, best >> 26 & _FIELD, best & _START], axis=1)
    return out


def search(index: Index, texts: list[str | None], edits: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, passage, longest run, words matched, edits, first text word) of every region that passes the filter."""
    listed = [folding.words(t) for t in texts]
    if index.by_words:
        codes, sizes = word_codes(listed), [len(ws) + 1 for ws in listed]
    else:
        joined = [" ".join(ws) for ws in listed]
        codes, sizes = np.frombuffer("\x01".join(joined).encode("utf-32-le", "replace"), np.uint32), [len(t) + 1 for t in joined]
    hashes = q_hashes(codes, index.q)
    if not len(hashes):
        return
    bits = len(index.seen).bit_length() - 1
    pos = np.flatnonzero(index.seen[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
    low = np.searchsorted(index.keys, hashes[pos], side="left")
    number = np.searchsorted(index.keys, hashes[pos], side="right") - low
    pos, low, number = pos[number > 0], low[number > 0], number[number > 0]
    if not len(pos):
        return
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # Bands of twice the least power of two above the edits, overlapping by half: `edits` + 1 diagonals lie in one.
    band_bits = max(0, int(edits).bit_length())
    # Matches are expanded in parts of bounded size that end between texts.
    text_of = np.searchsorted(starts, pos, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], np.diff(text_of) > 0]))
    weight = np.cumsum(number)
    cut = [0]
    for f in first[1:]:
        if weight[f - 1] - (weight[cut[-1] - 1] if cut[-1] else 0) > MATCHES:
            cut.append(int(f))
    for a, b in zip(cut, [*cut[1:], len(pos)]):
        n = number[a:b]
        p = np.repeat(pos[a:b], n)
        t = np.repeat(text_of[a:b], n)
        offset = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        s = index.at[np.repeat(low[a:b], n) + offset].astype(np.int64)
        passage = np.searchsorted(index.starts, s, side="right") - 1
        diagonal = (p - starts[t]) - (s - index.starts[passage])
        shifted = diagonal + (1 << 40)
        jobs = []
        for half in range(2 if band_bits else 1):
            band = (shifted + (half << band_bits)) >> (band_bits + 1) if band_bits else shifted
            order = np.lexsort((p, band, passage, t))
            key = np.stack([t[order], passage[order], band[order]])
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0).any(axis=0)]))
            count = np.diff(np.concatenate([edge, [len(order)]]))
            row = order[edge[count >= index.least[passage[order[edge]]]]]
            if index.by_words:
                shift = (band[row] << (band_bits + 1)) - (half << band_bits) + (1 << band_bits) - (1 << 40)
            else:
                # The words at the band: those of the passage against the same place of the text.
                spaces = np.concatenate([[0], np.cumsum(codes == ord(" "))])
                mine = np.searchsorted(index.places, s[row], side="right") - 1 - index.cuts[passage[row]]
                shift = spaces[p[row]] - spaces[starts[t[row]]] - mine
            jobs.append(np.stack([t[row], passage[row], shift], axis=1))
        jobs = np.unique(np.concatenate(jobs), axis=0)
        if not len(jobs):
            continue
        used = np.unique(jobs[:, 0])
        words = word_codes([listed[i] for i in used])
        ends = np.cumsum([len(listed[i]) + 1 for i in used])
        for k in range(0, len(jobs), JOBS):
            i, g, shift = jobs[k : k + JOBS].T
            at = np.searchsorted(used, i)
            begin = np.where(at > 0, ends[at - 1], 0)
            found = align(index.codes, index.cuts[g + 1] - index.cuts[g], index.cuts[g], words, begin, ends[at] - 1, shift, 1 << band_bits)
            yield from zip(i.tolist(), g.tolist(), *found.T.tolist())


_SCHEMA = "doc_id bigint, item_id bigint, passage int, run int, matched int, edits int, word int"


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, edits: int = 0, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Regions of documents that hold passages of items.

    Rows: `doc_id`, `item_id`, `passage` (-1 the question, 0.. the choice), `run` (most consecutive equal words),
    `matched` and `edits` of the best local alignment, `word` (where it starts in the text). A passage of fewer than
    `min_words` words can't leak. Null and blank texts hold nothing; items with null prompts or choices count with what
    they have; a null item_id is ignored. Items that share a passage each count. Repeated rows come out repeatedly.

    `edits` is in words, as is the column: every region whose best local alignment has at least `min_words` matched
    words and at most `edits` edits comes out, however long the edited words are; others may come out too. `q` is in
    characters and holds for `edits` = 0.
    """
    known = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "prompt", "choices")
    size = known.agg(F.sum(F.coalesce(F.length("prompt"), F.lit(0)) + F.coalesce(F.length(F.array_join("choices", " ")), F.lit(0)))).first()[0] or 0
    n_blocks = max(1, -(-int(size) // block_chars))
    texts = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = None
    for k in range(n_blocks):
        part = known if n_blocks == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        index = build([tuple(r) for r in part.collect()], q, min_words, edits)
        if index is None:
            continue
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                for piece in blocks.parts(batch, 1, BATCH_ROWS, BATCH_BYTES):
                    ids = piece.column(0).to_pylist()
                    rows = [(ids[i], item, kind, *rest) for i, g, *rest in search(ix, piece.column(1).to_pylist(), edits) for item, kind in ix.items[g]]
                    if rows:
                        cols = list(zip(*rows))
                        kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 5
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "passage", "run", "matched", "edits", "word"])

        found = texts.mapInArrow(run, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return documents.sparkSession.createDataFrame([], _SCHEMA) if out is None else out


def leaked(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc_id`, `item_id` of documents that hold `min_words` or more consecutive words of a passage of the item, each once."""
    return find_leaks(documents, items, min_words).where((F.col("run") >= min_words) & F.col("doc_id").isNotNull()).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per item: `task`, `split`, `n_documents` that hold a passage of it and the longest run of words; 0 where none does."""
    found = find_leaks(documents, items, min_words).where(F.col("run") >= min_words)
    hits = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("run").alias("longest_run"))
    return (
        items.select("item_id", "task", "split")
        .distinct()
        .join(hits, "item_id", "left")
        .na.fill(0, ["n_documents", "longest_run"])
    )


def leaked_regions(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, edits: int = 2) -> DataFrame:
    """The best region of each document, item and passage with `min_words` matched words: `matched`, `edits`, `run`, `word`.

    Best is the one with most matched words, then fewest edits, then the longest run, then the first.
    """
    found = find_leaks(documents, items, min_words, edits).where((F.col("matched") >= min_words) & F.col("doc_id").isNotNull())
    best = F.max(F.struct("matched", (-F.col("edits")).alias("fewer"), "run", (-F.col("word")).alias("first"))).alias("b")
    return found.groupBy("doc_id", "item_id", "passage").agg(best).select("doc_id", "item_id", "passage", "b.matched", (-F.col("b.fewer")).alias("edits"), "b.run", (-F.col("b.first")).alias("word"))
