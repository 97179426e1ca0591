"""Problem 8: statistics of each text that tell natural prose from lists, tables, markup and junk.

One pass computes the statistics of each document, array-wise for all texts of a batch. Mergeable quantile sketches
(KLL) of each statistic per language give its distribution; values become robust z-scores (distance from the median in
units of the quartile range), and documents in the tails are flagged. A document whose scores of the statistics of
words are together far out in the tails is no prose. The language is the one whose common words the text has most of,
as `lang` may be wrong.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread
from . import blocks, folding

#: Statistics with a sketch, and the tail that is suspicious: -1 low, 1 high, 0 both.
STATISTICS = {
    "common_share": 0, "letters_share": -1, "symbol_ratio": 1, "digit_ratio": 1, "mean_word_length": 0, "distinct_words": -1,
    "longest_token": 1, "punctuated_lines": -1, "words_per_line": -1, "words_per_sentence": 0, "item_lines": 1, "cell_lines": 1,
}
#: Statistics of words: those that together decide whether a text is prose.
DECIDING = ("common_share", "distinct_words", "longest_token", "digit_ratio")
#: A robust z-score of this size is in the tail; the deciding ones together are far out from this length of their vector.
TAIL_Z = 2.0
FAR_Z = 6.5
#: Quartile ranges count as this at least (and as this share of the median).
LEAST_RANGE = 0.02
#: Shares of a text scatter more the shorter it is: scores are divided by sqrt(1 + SCATTER / number of characters).
SCATTER = 18.0
#: A text with more than this share of letters of other scripts has no common words to be expected (look-alikes count as Latin).
FOREIGN_SHARE = 0.3
#: Characters whose arrays are held at once; a longer text is taken alone.
BATCH_CHARS = 1_000_000

_LETTER, _DIGIT, _SPACE, _LINE, _STOP, _CLOSE, _PAUSE, _WIDE, _ITEM, _CELL, _COMMA = (1 << k for k in range(11))
_STOPS = ".!?…。！？"
_PAUSES = ";:,"
_CLOSING = "\"'”’»)]"
_WIDE_STOPS = "。！？"
_ITEMS = "-*•·–+#>|"
_CELLS = "|;\t»"
_MARKER = re.compile(r"<\|[^|<>\n]*\|>")
#: Scripts written without spaces: each character is a token of its own.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3FFFF))
#: From here on letters aren't Latin.
_FOREIGN = 0x370


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point, as bits."""
    out = np.zeros(sys.maxunicode + 1, np.uint16)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            out[c] = _LETTER
        elif ch.isspace():
            out[c] = _SPACE
        elif ch.isdecimal():
            out[c] = _DIGIT
    for a, b in _UNSPACED:
        out[a : b + 1] |= _WIDE
    for chars, bit in (("\n", _LINE), (_STOPS, _STOP), (_CLOSING, _CLOSE), (_PAUSES, _PAUSE), (_ITEMS, _ITEM), (_CELLS, _CELL), (",", _COMMA)):
        for ch in chars:
            out[ord(ch)] |= bit
    return out


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2^64 and their inverses."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (base, inverse))


def word_hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs codes[start:stop], from one running sum."""
    size = 1 << int(len(codes)).bit_length()
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)])
        h = (total[stop] - total[start]) * inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


class CommonWords:
    """A word list per language: the hash of each word, and which languages (as bits) it is common in."""

    def __init__(self, common: dict[str, set[str] | frozenset[str]]):
        self.languages = sorted(common)
        bits: dict[int, int] = {}
        for k, lang in enumerate(self.languages):
            for w in sorted(common[lang]):
                codes = np.frombuffer(w.encode("utf-32-le", "replace"), np.uint32)
                h = int(word_hashes(codes, np.array([0]), np.array([len(codes)]))[0])
                bits[h] = bits.get(h, 0) | 1 << k
        self.hashes = np.array(sorted(bits), np.uint64)
        self.bits = np.array([bits[h] for h in sorted(bits)], np.int64)
        self.foreign = any(ord(c) >= _FOREIGN and c.isalpha() for ws in common.values() for w in ws for c in w)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The languages of words, 0 for those that aren't listed."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.bits[at], 0)


def statistics(texts: list[str], common: CommonWords) -> dict[str, np.ndarray | list]:
    """`language`, `n_words`, `n_lines` and the STATISTICS of canonical texts with visible characters; NaN where one isn't defined.

    `common_share` isn't defined for a text without words, nor for one in letters that no listed word is written in.
    """
    many, joined = len(texts), [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in joined], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    codes = np.frombuffer(("\n".join(joined) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = _kinds()[codes]
    # Of ascending places: how many are in each text, and the text of each.
    count = lambda at: np.diff(np.searchsorted(at, first))
    of = lambda at: np.repeat(np.arange(many), count(at))
    has = lambda bits: kind & np.uint16(bits) != 0
    space, letter = has(_SPACE), has(_LETTER)

    def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
        return edge[::2], edge[1::2]

    # Words: runs of letters that no digit or underscore touches.
    start, stop = runs(letter)
    bound = has(_DIGIT) | (codes == ord("_"))
    alone = ~(bound[np.maximum(start, 1) - 1] & (start > 0)) & ~bound[np.minimum(stop, len(codes) - 1)]
    start, stop = start[alone], stop[alone]
    hashes, doc = word_hashes(codes, start, stop), of(start)
    n_words = np.bincount(doc, minlength=many)
    letters = np.bincount(doc, weights=stop - start, minlength=many)
    listed = common.of(hashes)
    tally = np.stack([np.bincount(doc[listed >> k & 1 == 1], minlength=many) for k in range(len(common.languages))] or [np.zeros(many)])
    best, most = tally.argmax(axis=0), tally.max(axis=0)
    foreign = np.zeros(many) if common.foreign else count(np.flatnonzero(letter & (codes >= _FOREIGN)))
    pair = np.sort(doc.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    distinct = np.bincount((pair[np.concatenate([[True], pair[1:] != pair[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=many) if len(pair) else n_words
    # Tokens: runs of visible characters; those of unspaced scripts stand alone.
    a, b = runs(~space & ~has(_WIDE))
    tokens, longest = count(a), np.zeros(many)
    if len(a):
        longest[tokens > 0] = np.maximum.reduceat(b - a, (np.cumsum(tokens) - tokens)[tokens > 0])
    solid = count(np.flatnonzero(~space))
    longest = np.where((longest == 0) & (solid > 0), 1, longest)
    digits = count(np.flatnonzero(has(_DIGIT)))
    # Lines with something in them.
    ends = np.flatnonzero(has(_LINE))
    begins = np.concatenate([[0], ends[:-1] + 1])
    visible = np.flatnonzero(~space)
    head = np.searchsorted(visible, begins)
    filled = head < np.searchsorted(visible, ends)
    begins, ends, head = begins[filled], ends[filled], visible[head[filled]]
    line = of(begins)
    n_lines = np.bincount(line, minlength=many)
    telling = np.flatnonzero(~space & ~has(_CLOSE))
    last = np.searchsorted(telling, ends) - 1
    inside = (last >= 0) & (telling[last] >= begins) if len(telling) else np.zeros(len(ends), bool)
    punctuated = inside & has(_STOP | _PAUSE)[telling[last]] if len(telling) else inside
    # A number with a sign after it opens an item as well.
    other = np.flatnonzero(~has(_DIGIT))
    after = other[np.searchsorted(other, head)]
    item = has(_ITEM)[head] | (after > head) & (after - head <= 4) & np.isin(codes[after], np.array([ord(c) for c in ".):"], np.uint32))
    # A comma without a space after it separates cells.
    cells = np.flatnonzero(has(_CELL | _COMMA))
    cells = cells[~has(_COMMA)[cells] | ~space[np.minimum(cells + 1, len(codes) - 1)]]
    cell = np.searchsorted(cells, ends) - np.searchsorted(cells, begins) >= 2
    # Sentence ends: a stop, then closing marks, then space or the end.
    stops = np.flatnonzero(has(_STOP))
    open_ = np.flatnonzero(~has(_CLOSE))
    done = space[open_[np.searchsorted(open_, stops + 1)]] | np.isin(codes[stops], np.array([ord(c) for c in _WIDE_STOPS], np.uint32))
    sentences = count(stops[done])

    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda x, n, empty=0.0: np.where(n > 0, x / n, empty)
        return {
            "language": [common.languages[k] if m else "und" for k, m in zip(best, most)],
            "n_words": n_words,
            "n_lines": n_lines,
            "common_share": np.where(foreign > FOREIGN_SHARE * count(np.flatnonzero(letter)), np.nan, share(most, n_words, 0.0)),
            "letters_share": share(letters, solid),
            "symbol_ratio": share(np.maximum(0, solid - letters - digits), solid),
            "digit_ratio": share(digits, solid),
            "mean_word_length": share(letters, n_words),
            "distinct_words": share(distinct, n_words),
            "longest_token": np.log2(np.maximum(longest, 1)),
            "punctuated_lines": share(np.bincount(line, weights=punctuated, minlength=many), n_lines),
            "words_per_line": share(n_words, n_lines),
            # As logarithms, like the longest token: lists have very few words to a sentence end, or very many.
            "words_per_sentence": np.log2((n_words + 1) / np.maximum(sentences, 1)),
            "item_lines": share(np.bincount(line, weights=item, minlength=many), n_lines),
            "cell_lines": share(np.bincount(line, weights=cell, minlength=many), n_lines),
        }


_KINDS = "language string, n_words bigint, n_chars bigint, n_lines bigint, " + ", ".join(f"{k} double" for k in STATISTICS)
_NAMES = ["language", "n_words", "n_chars", "n_lines", *STATISTICS]


def _plain(text: str) -> str:
    """The canonical form, with markers as line ends."""
    text = folding.canonical(text)
    return _MARKER.sub("\n\n", text) if "<|" in text else text


def _batch(part: pa.RecordBatch, common: CommonWords) -> pa.RecordBatch:
    texts = part.column(1).to_pylist()
    forms = [_plain(t) if t else "" for t in texts]
    full = [i for i, t in enumerate(forms) if t.strip()]
    cols: dict[str, pa.Array] = {}
    at = np.full(len(texts), -1)
    at[full] = np.arange(len(full))
    take = pa.array(np.where(at < 0, 0, at), mask=at < 0)
    found = statistics([forms[i] for i in full], common) if full else {k: [] for k in _NAMES}
    found["n_chars"] = [len(texts[i]) for i in full]
    for k in _NAMES:
        kind = pa.string() if k == "language" else pa.int64() if k.startswith("n_") else pa.float64()
        cols[k] = pa.array(found[k], kind, from_pandas=k in STATISTICS).take(take)
    return pa.RecordBatch.from_arrays([part.column(0), *cols.values()], ["doc_id", *_NAMES])


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row per input row: `doc_id`, `language`, `n_words`, `n_chars`, `n_lines` and the STATISTICS.

    Null, empty and blank texts have null statistics. `common_words` is a word list: its number of rows is checked.
    """
    rows = common_words.where("lang is not null and word is not null").select("lang", "word").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 common words")
    common = CommonWords({lang: {r[1].lower() for r in rows if r[0] == lang} for lang in {r[0] for r in rows}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.parts(batch, 1, 100_000, BATCH_CHARS):
                yield _batch(part, common)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, " + _KINDS)


def distributions(stats: DataFrame) -> DataFrame:
    """Quantiles from mergeable sketches over all texts that aren't blank: `group`, `n`, and low, middle, high quartile of each statistic.

    A group is a language, `und` (texts without one), or null: all languages together.
    """
    known = stats.where("language is not null")
    sketches = [F.kll_sketch_agg_double(F.col(k)).alias(k) for k in STATISTICS]
    parts = checkpoint(known.groupBy(F.col("language").alias("group")).agg(F.count(F.lit(1)).alias("n"), *sketches))
    quartiles = [F.kll_sketch_get_quantile_double(k, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(k) for k in STATISTICS]
    merged = parts.where("group != 'und'").groupBy(F.lit(None).cast("string").alias("group")).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in STATISTICS])
    return parts.unionByName(merged).select("group", "n", *quartiles)


def assess(documents: DataFrame, common_words: DataFrame, tail: float = TAIL_Z, far: float = FAR_Z) -> DataFrame:
    """`document_statistics` with robust z-scores, the number of tails a document is in, its `distance` and its `kind`.

    `z_...` are relative to all documents of the document's language, however few, and to those of all languages where a
    text has none (to all texts if no text has one). `distance` is the length of the vector of the DECIDING scores, each as far as it is in a suspicious
    tail. `kind`: from a distance of `far` on no prose, namely table (most lines have cells), list (most lines open an
    item) or junk; unusual (in a tail), prose, or blank. Repeated rows are each assessed; an empty table gives no rows.
    """
    stats = checkpoint(document_statistics(documents, common_words))
    # At most one row per listed language, one for texts without a language and one for all.
    groups = {r["group"]: r for r in distributions(stats).collect()}
    whole = groups.get(None, groups.get("und"))
    chosen = [(g, *[(whole if g == "und" else r)[k] for k in STATISTICS]) for g, r in sorted((g, r) for g, r in groups.items() if g is not None)]
    own = stats.sparkSession.createDataFrame(chosen, "_g string, " + ", ".join(f"_{k} array<double>" for k in STATISTICS))
    rows = stats.join(F.broadcast(own), F.col("language") == F.col("_g"), "left")
    scores, tails, distance = [], F.lit(0), F.lit(0.0)
    for k, side in STATISTICS.items():
        q = F.col(f"_{k}")
        spread_ = F.greatest(q[2] - q[0], F.lit(LEAST_RANGE), F.abs(q[1]) * LEAST_RANGE) / 1.349
        z = (F.col(k) - q[1]) / spread_ / F.sqrt(1 + SCATTER / F.col("n_chars"))
        scores.append(z.alias(f"z_{k}"))
        out = F.coalesce(F.abs(z) if side == 0 else F.greatest(z * side, F.lit(0.0)), F.lit(0.0))
        tails = tails + F.when(out >= tail, 1).otherwise(0)
        if k in DECIDING:
            distance = distance + out * out
    rows = rows.withColumns({"tails": F.when(F.col("language").isNotNull(), tails), "distance": F.when(F.col("language").isNotNull(), F.sqrt(distance))})
    kind = (
        F.when(F.col("language").isNull(), "blank")
        .when((F.col("distance") >= far) & (F.col("cell_lines") > 0.5), "table")
        .when((F.col("distance") >= far) & (F.col("item_lines") > 0.5), "list")
        .when(F.col("distance") >= far, "junk")
        .when(F.col("tails") > 0, "unusual")
        .otherwise("prose")
    )
    return rows.select(*stats.columns, *scores, "tails", "distance", kind.alias("kind"))


def junk(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """`doc_id` of the documents that are no prose (table, list or junk), each once; null ids are left out."""
    return assess(documents, common_words).where("kind in ('table', 'list', 'junk') and doc_id is not null").select("doc_id").distinct()
