"""Ranks and running sums over whole tables without a one-partition window.

Spark computes a window without (or with few) partition keys in one task per key. Here the order is first cut
into ranges ("blocks") by a caller-given block expression that is monotone in the order; a small aggregate has
each block's total, the prefix of those totals is taken over the small aggregate, and the rows get
`offset of the block + rank within the block`. The window over rows has one task per block, so neither a huge
group nor the lack of groups makes a large task. Nothing is cached: both passes are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task ranks where blocks follow from a hash.
BLOCK_ROWS = 50_000


def scan(
    df: DataFrame,
    group: Sequence[str],
    block: Column,
    order: Sequence[str | Column],
    rank: str = "rank",
    running: dict[str, str] | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add a 1-based `rank` and, per item of `running` (new name -> summed column), an inclusive running sum.

    `block` must be monotone in `order` within a group; `order` must be total (end it with a unique key).
    Running sums skip nulls as SQL does. `total`, if given, names a column with the number of rows of the group. Rows with null
    groups or blocks form groups and blocks of their own. An empty table gives an empty table.
    """
    running = running or {}
    keys = list(group)
    # One struct as the key of window, aggregate and join: its null fields are equal, and all three share a partitioning.
    data = df.withColumn("_scan_key", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], block.alias("block")))
    sums = [F.count(F.lit(1)).alias("_scan_n")] + [F.coalesce(F.sum(c), F.lit(0)).alias(f"_scan_s_{new}") for new, c in running.items()]
    blocks = data.groupBy("_scan_key").agg(*sums)
    by_group = Window.partitionBy(*([F.col(f"_scan_key.k{i}") for i in range(len(keys))] or [F.lit(0)]))
    before = by_group.orderBy(F.col("_scan_key.block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_scan_key",
        F.coalesce(F.sum("_scan_n").over(before), F.lit(0)).alias("_scan_before"),
        *[F.coalesce(F.sum(f"_scan_s_{new}").over(before), F.lit(0)).alias(f"_scan_before_{new}") for new in running],
        *([F.sum("_scan_n").over(by_group).alias("_scan_total")] if total else []),
    )
    within = Window.partitionBy("_scan_key").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = data.withColumn("_scan_rank", F.row_number().over(within).cast("bigint"))
    for new, c in running.items():
        ranked = ranked.withColumn(f"_scan_run_{new}", F.coalesce(F.sum(c).over(upto), F.lit(0)))
    out = ranked.join(offsets, "_scan_key")
    out = out.withColumn(rank, F.col("_scan_before") + F.col("_scan_rank"))
    for new in running:
        out = out.withColumn(new, F.col(f"_scan_before_{new}") + F.col(f"_scan_run_{new}"))
    if total:
        out = out.withColumn(total, F.col("_scan_total"))
    return out.select(*df.columns, rank, *running, *([total] if total else []))


def md5_key(seed: int | Column, *parts: Column) -> Column:
    """The order key of seeded shuffles: md5 of the '|'-joined seed and parts, the same in any SQL engine."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", first.cast("string"), *[p.cast("string") for p in parts]))


def md5_block(key: Column, rows: int) -> Column:
    """A block expression that is monotone in an md5 key, with some `BLOCK_ROWS` of so many rows in a block."""
    digits = 1
    while 16**digits * BLOCK_ROWS < rows:
        digits += 1
    return F.substring(key, 1, digits)


def id_block(column: str | Column, size: int = 65536) -> Column:
    """A block expression that is monotone in an integer id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / F.lit(size))
