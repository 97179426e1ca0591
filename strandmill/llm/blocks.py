"""Work in pieces of bounded size: pairs between blocks of rows, and parts of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def cross(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of the blocks of each pair: columns of `left` (with `block_1`) and of `right` (with `block_2`).

    `pairs` has each (`block_1`, `block_2`) once. Rows are sent to the pairs of their block and meet there: one pair is
    the most that a task has to take at once.
    """
    return pairs.join(left, "block_1").join(pairs.join(right, "block_2"), ["block_1", "block_2"])


def attach(rows: DataFrame, groups: DataFrame, on: list[str], size: str, most: int = 20_000) -> DataFrame:
    """The inner join of rows with the values of their group, one row of `groups` for each `on`.

    The largest groups by `size`, at most `most` of them, are broadcast, so that their rows aren't shuffled and no hot
    group makes a large task; the others have less than 1 / `most` of all rows each.
    """
    if groups.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(groups), on)
    top = checkpoint(groups.orderBy(F.desc(size), *on).limit(most))
    known = F.broadcast(top.select(*on))
    return rows.join(F.broadcast(top), on).unionByName(rows.join(known, on, "left_anti").join(groups.join(known, on, "left_anti"), on))


def parts(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into parts of at most so many rows, and of at most so many bytes of a text column or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end
