"""Problem 5: cutting texts that exceed their limit into pieces at natural boundaries.

Dynamic programming over boundary positions: a cut costs by its kind (the source's delimiter, a blank line, a line
end, a sentence end, a clause end, a space, none) and a piece by its squared distance from equal sizes; the cheapest
sequence of cuts is taken, subject to the limit and to the overlap that each piece repeats of the one before. All
boundaries count. Cuts at none are tried only where neighbouring boundaries are further apart than a piece can be:
elsewhere such a cut costs 12, and the two boundaries around it cost at most 3 each and make pieces that cost at most 1
each, so they are always cheaper. Many texts are planned at once, a position at a time. All positions count code points
of the text as stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small
from . import blocks

KINDS = ("delimiter", "paragraph", "line", "sentence", "clause", "space", "none")
COSTS = (0.0, 0.1, 0.3, 0.5, 1.5, 3.0, 12.0)
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*|(?:\r\n[^\S\r\n]*){2,}")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*")
_CLAUSE = re.compile(r"[,;:]\s+|\s[–—-]\s+|[，；：、]")
_SPACE = re.compile(r"\s+")


#: Cells of the tables that are planned at once.
CELLS = 2_000_000


@cache
def _spaces() -> np.ndarray:
    """Which code points of the basic plane are white space: there are none beyond it."""
    return np.array([chr(c).isspace() for c in range(0x10000)])


def _joined(codes: np.ndarray) -> np.ndarray:
    """Whether a cut before each place would part a character from its combining mark, joiner or selector."""
    before = np.concatenate([[0], codes[:-1]])
    return (codes == 0x200D) | (codes == 0xFE0F) | (before == 0x200D) | ((codes >= 0x300) & (codes <= 0x36F)) | ((codes >= 0x1F3FB) & (codes <= 0x1F3FF))


def _marks(text: str, delimiter: str | None, start: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the text may be cut, with their kind: ascending, between `start` and the length."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.full(n + 1, len(KINDS), np.int8)
    space = _spaces()[np.minimum(codes, 0xFFFF)]
    kind[np.flatnonzero(space[:-1] & ~space[1:]) + 1] = 5
    for k, pattern in ((4, _CLAUSE), (3, _SENTENCE), (2, _LINE), (1, _PARAGRAPH)):
        kind[[m.end() for m in pattern.finditer(text)]] = k
    if delimiter:
        at = text.find(delimiter)
        while at >= 0:
            # A delimiter of line ends and spaces closes its piece; one with visible characters opens the next.
            kind[at + len(delimiter) if not delimiter.strip() else at + len(delimiter) - len(delimiter.lstrip())] = 0
            at = text.find(delimiter, at + len(delimiter))
    kind[: start + 1] = kind[n] = len(KINDS)
    edges = np.concatenate([[start], np.flatnonzero(kind < len(KINDS)), [n]])
    wide = np.flatnonzero(np.diff(edges) > room)
    if len(wide):
        joined = _joined(codes)
        for w in wide:
            inner = np.arange(edges[w] + 1, edges[w + 1])
            kind[inner[~joined[inner]]] = 6
        # Where characters are joined for longer than a piece can be, even they are parted.
        edges = np.concatenate([[start], np.flatnonzero(kind < len(KINDS)), [n]])
        for w in np.flatnonzero(np.diff(edges) > room):
            kind[edges[w] + 1 : edges[w + 1]] = 6
    marks = np.flatnonzero(kind < len(KINDS))
    return marks, kind[marks]


def _plan(tables: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """The cheapest cuts of several texts: for each (positions from start to end, costs, room) the indexes of the cuts and the end."""
    size = [len(t[0]) for t in tables]
    pos, cost = np.zeros((len(tables), size[0])), np.zeros((len(tables), size[0]))
    low = np.zeros((len(tables), size[0]), np.int32)
    equal = np.ones((len(tables), 1))
    for t, (p, c, r) in enumerate(tables):
        pos[t, : size[t]], cost[t, : size[t]] = p, c
        low[t, : size[t]] = np.searchsorted(p, p - r)
        equal[t] = (p[-1] - p[0]) / ceil((p[-1] - p[0]) / r)
    best, back = np.zeros(pos.shape), np.zeros(pos.shape, np.int32)
    # ((p_j - p_i) / e - 1)^2 is a part of j, a part of i, and -2 (p_j - e) p_i / e^2.
    of_i, slope = (pos / equal) ** 2, pos / equal**2
    lengths = -np.array(size)
    for j in range(1, size[0]):
        m = int(np.searchsorted(lengths, -j, side="left"))
        first = low[:m, j]
        a = int(first.min())
        total = slope[:m, a:j] * (-2 * (pos[:m, j : j + 1] - equal[:m]))
        total += of_i[:m, a:j]
        if (first > a).any():
            total[np.arange(a, j) < first[:, None]] = np.inf
        k = a + total.argmin(axis=1)
        rows = np.arange(m)
        best[:m, j] = best[rows, k] + ((pos[:m, j] - pos[rows, k]) / equal[:m, 0] - 1) ** 2 + cost[:m, j]
        of_i[:m, j] += best[:m, j]
        back[:m, j] = k
    out = []
    for t in range(len(tables)):
        cuts, j = [], size[t] - 1
        while j > 0:
            cuts.append(j)
            j = int(back[t, j])
        out.append(np.array(cuts[::-1], np.int64))
    return out


def cut_all(texts: list[tuple[str, int, int, str | None]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of each (text, limit, overlap, delimiter) as (start, end, kind of the cut at the end).

    Pieces are at most `limit` long and cover the text; each after the first starts `overlap` before the end of the
    one before. A text within its limit is one piece. An overlap of the limit or more is taken as limit - 1, a negative
    one as 0.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    todo = []
    for i, (text, limit, overlap, delimiter) in enumerate(texts):
        if limit < 1:
            raise ValueError("the limit must be positive")
        overlap = max(0, min(overlap, limit - 1))
        if len(text) <= limit:
            out[i] = [(0, len(text), len(KINDS) - 1)]
            continue
        # The first piece repeats nothing: its own part begins where the overlap of a piece would end.
        marks, kinds = _marks(text, delimiter, overlap, limit - overlap)
        pos = np.concatenate([[overlap], marks, [len(text)]])
        todo.append((i, pos, np.concatenate([[len(KINDS) - 1], kinds, [len(KINDS) - 1]]), overlap, limit - overlap))
    # Texts of like numbers of positions together: a position of the longest is a step for all that have so many.
    todo.sort(key=lambda x: -len(x[1]))
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and (end - at + 1) * len(todo[at][1]) <= CELLS:
            end += 1
        group = todo[at:end]
        for (i, pos, kinds, overlap, _), cuts in zip(group, _plan([(p.astype(float), np.append(np.array(COSTS)[k[:-1]], 0.0), r) for _, p, k, _, r in group])):
            start = 0
            for j in cuts:
                out[i].append((start, int(pos[j]), int(kinds[j])))
                start = int(pos[j]) - overlap
        at = end
    return out


def cut(text: str, limit: int, overlap: int = 0, delimiter: str | None = None) -> list[tuple[int, int, int]]:
    """`cut_all` of one text."""
    return cut_all([(text, limit, overlap, delimiter)])[0]


def with_limits(records: DataFrame, sources: DataFrame) -> DataFrame:
    """`record_id`, `text`, `delimiter`, `overlap` and `cap` (null: none) of each row.

    The limit is the smaller of chunk_size and max_length, null or non-positive values set none; a null or unknown
    source has no limit. A source listed twice takes its smallest values.
    """
    limit = F.least(F.when(F.col("chunk_size") > 0, F.col("chunk_size")), F.when(F.col("max_length") > 0, F.col("max_length")))
    known = (
        sources.where("source is not null")
        .groupBy(F.col("source").alias("_source"))
        .agg(F.min(limit).alias("cap"), F.min("chunk_overlap").alias("overlap"), F.min("delimiter").alias("delimiter"))
    )
    rows = records.select(F.col("record_id"), F.col("source").alias("_at"), F.col("text").cast("string").alias("text"))
    return rows.join(small(known), F.col("_at") == F.col("_source"), "left").select("record_id", "text", "delimiter", "overlap", "cap")


def _pieces(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece_of in blocks.parts(batch, 1, 2000, 8_000_000):
            part = piece_of.to_pydict()
            ids, numbers, of, starts, ends, kinds, piece = [], [], [], [], [], [], []
            planned = cut_all([(t, len(t) or 1 if c is None else c, o or 0, d) for t, d, o, c in zip(part["text"], part["delimiter"], part["overlap"], part["cap"])])
            for r, t, found in zip(part["record_id"], part["text"], planned):
                for i, (a, b, k) in enumerate(found):
                    ids.append(r), numbers.append(i), of.append(len(found)), starts.append(a), ends.append(b), kinds.append(KINDS[k])
                    if texts:
                        piece.append(t[a:b])
            cols = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(of, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string())]
            names = ["record_id", "piece", "n_pieces", "start", "stop", "boundary"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(piece, pa.string())] * texts, names + ["text"] * texts)


_SCHEMA = "record_id bigint, piece int, n_pieces int, start int, stop int, boundary string"


def cut_plan(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each row over its limit is cut: `record_id`, `piece`, `n_pieces`, `start`, `stop`, `boundary` (of its end).

    Only rows over their limit leave the JVM. Null and empty texts are never over one. A row that is delivered
    again is cut again, the same way.
    """
    over = with_limits(records, sources).where("char_length(text) > cap")
    return over.mapInArrow(lambda it: _pieces(it, False), _SCHEMA)


def cut_texts(records: DataFrame, sources: DataFrame) -> DataFrame:
    """`cut_plan` with the texts of the pieces and with the rows within their limit as one piece each.

    A record delivered again (same `record_id`) comes out once, in its latest delivery. Null texts have no piece,
    an empty text has one empty piece.
    """
    latest = records.groupBy("record_id").agg(F.max(F.struct(F.col("loaded_at"), F.col("source"), F.col("text"))).alias("r")).select("record_id", "r.source", "r.text")
    rows = with_limits(latest, sources).where("text is not null")
    return rows.mapInArrow(lambda it: _pieces(it, True), _SCHEMA + ", text string")


def over_limit(records: DataFrame, sources: DataFrame) -> DataFrame:
    """`record_id` of the records that are cut into more than one piece, each once; null ids are left out."""
    return cut_plan(records, sources).where("n_pieces > 1 and piece = 1 and record_id is not null").select("record_id").distinct()


def covered(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Per record with a text: `n_chars`, whether it is cut, and whether its pieces cover it and are within its limit."""
    known = with_limits(records.select("record_id", "source", F.lit("").alias("text")), sources).groupBy("record_id").agg(F.max("cap").alias("most"))
    whole = cut_texts(records, sources).groupBy("record_id").agg(
        F.max("stop").cast("bigint").alias("n_chars"), (F.count(F.lit(1)) - 1).alias("cuts"), F.max(F.col("stop") - F.col("start")).alias("longest"),
        F.sum(F.col("stop") - F.col("start")).alias("sum"), F.min("start").alias("first"),
    )
    return whole.join(known, "record_id").select("record_id", "n_chars", (F.col("cuts") > 0).alias("is_cut"), ((F.col("first") == 0) & (F.col("sum") >= F.col("n_chars"))).alias("is_covered"), (F.coalesce("most", "longest") >= F.col("longest")).alias("is_within"))
