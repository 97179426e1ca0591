"""Shards, training windows, budgets and statistics of ordered documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordinal import id_block, md5_block, md5_key, scan
from ..session import checkpoint, small


def statistics(rows: DataFrame, keys: tuple[str, ...] = ("split", "source")) -> DataFrame:
    """Per group: documents, tokens, mean, exact median, least and most tokens."""
    n = F.col("n_tokens")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_docs"),
        F.sum(n).alias("total_tokens"),
        F.avg(n).alias("mean_len"),
        F.median(n).alias("median_len"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
    )


def split_totals(rows: DataFrame, eos: int = -1) -> DataFrame:
    """Per split: documents, tokens, and tokens written, which has an end token for each document if `eos` is not negative."""
    extra = F.count(F.lit(1)) if eos >= 0 else F.lit(0)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("num_docs"), F.sum("n_tokens").alias("total_tokens"), (F.sum("n_tokens") + extra).alias("written_tokens"))


def fill_shards(sizes: np.ndarray, size: int, filled: int = 0) -> tuple[np.ndarray, int, int]:
    """Shard steps of documents in order: a document opens a new shard if it doesn't fit or the shard is full.

    Gives for each document whether it opens a shard, and the fill after the last. Found by jumps over prefix sums:
    as many steps as there are shards.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    opens = np.zeros(len(sizes), np.int64)
    at, n = 0, len(sizes)
    while at < n:
        # Documents that still fit: the running sum stays within what is free.
        if filled >= size:
            fit = at
        else:
            full = ends[at] + (size - filled)
            fit = int(np.searchsorted(ends, full, side="right")) - 1
            if ends[fit] == full:
                # A full shard takes nothing more, not even documents without tokens.
                fit = int(np.searchsorted(ends, full, side="left"))
        if fit > at:
            filled += int(ends[fit] - ends[at])
            at = fit
            continue
        if filled == 0:
            # An empty shard takes any document.
            filled = int(sizes[at])
            at += 1
            continue
        opens[at] = 1
        filled = int(sizes[at])
        at += 1
    return opens, int(opens.sum()), filled


def range_table(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a range of documents does to the open shard, for every fill that it may have before the range.

    Gives ascending bounds with the shards opened and the fill after the range: with `free` tokens left before it, the
    first bound of at least `free` holds; beyond the last nothing is opened and all documents are added. Chains of
    shards from all documents that may open the first one are followed together; most of them soon meet.
    """
    m = len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    filled = np.append(np.flatnonzero(sizes > 0), m)
    # The most free tokens with which a document still opens a shard.
    bounds = np.maximum(ends - 1, starts)
    first = np.arange(min(m, int(np.searchsorted(bounds, size, side="left")) + 1))
    at, opened, fill = first.copy(), np.ones(len(first), np.int64), np.zeros(len(first), np.int64)
    go = np.arange(len(first))
    while len(go):
        here, back = np.unique(at[go], return_inverse=True)
        base = starts[here]
        # Documents without tokens leave a new shard empty, and an empty shard takes any document.
        holds = filled[np.searchsorted(filled, here)]
        after = np.minimum(np.searchsorted(ends, base + size, side="right"), np.searchsorted(starts, base + size, side="left"))
        after = np.minimum(np.maximum(after, holds + 1), m)
        over = after[back] == m
        fill[go[over]] = (ends[-1] - base)[back[over]]
        opened[go[~over]] += 1
        at[go[~over]] = after[back[~over]]
        go = go[~over]
    last = np.append((np.diff(opened) != 0) | (np.diff(fill) != 0), True)
    return bounds[first][last], opened[last], fill[last]


_TABLE = "bound bigint, opened bigint, fill bigint, total bigint"


def _ranges(placed: DataFrame, size: int, group_kind: str) -> DataFrame:
    """`_g`, `_range`, and the `_fill` and `_shard` before each range: the tables of ranges, composed in order."""

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("_o")["_n"].to_numpy()
        bounds, opened, fill = range_table(sizes, size)
        _, n, left = fill_shards(sizes, size, 0)
        out = pd.DataFrame({"bound": np.append(-1, bounds), "opened": np.append(n, opened), "fill": np.append(left, fill), "total": int(sizes.sum())})
        out.insert(0, "_range", pdf["_range"].iloc[0])
        out.insert(0, "_g", pdf["_g"].iloc[0])
        return out

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, shard, filled, held = None, 0, 0, None

        def step(part: pd.DataFrame) -> tuple:
            nonlocal group, shard, filled
            g, r = part["_g"].iloc[0], int(part["_range"].iloc[0])
            if g != group:
                group, shard, filled = g, 0, 0
            row = (g, r, filled, shard)
            # The first row holds for an empty shard; the others are looked up by what is free.
            k = 0 if filled == 0 else 1 + int(np.searchsorted(part["bound"].to_numpy()[1:], max(0, size - filled), side="left"))
            if k < len(part):
                shard, filled = shard + int(part["opened"].iloc[k]), int(part["fill"].iloc[k])
            else:
                filled += int(part["total"].iloc[0])
            return row

        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf])
            parts = [x for _, x in pdf.groupby(["_g", "_range"], sort=False, dropna=False)]
            held = parts.pop() if parts else None
            if parts:
                yield pd.DataFrame([step(x) for x in parts], columns=["_g", "_range", "_fill", "_shard"])
        if held is not None and len(held):
            yield pd.DataFrame([step(held)], columns=["_g", "_range", "_fill", "_shard"])

    tables = placed.groupBy("_g", "_range").applyInPandas(table, f"_g {group_kind}, _range bigint, {_TABLE}")
    return tables.repartition("_g").sortWithinPartitions("_g", "_range", "bound").mapInPandas(compose, f"_g {group_kind}, _range bigint, _fill bigint, _shard bigint")


def assign_shards(rows: DataFrame, size: int, order: str = "mix_ord", group: str = "split", eos: int = -1, range_docs: int | None = None) -> DataFrame:
    """Adds `shard` (from 0): documents fill shards of up to `size` tokens in order, never divided.

    Documents are cut into ranges of so many (some hundred shards each). A task per range tells what the range does to
    the open shard for every fill before it; these small tables are composed in order, and a task per range then
    assigns its documents. So no task sees more than a range, and only the tables meet in one place.
    """
    if size <= 0:
        return rows.withColumn("shard", F.lit(0).cast("bigint"))
    kinds = dict(rows.dtypes)
    length = F.col("n_tokens") + (1 if eos >= 0 else 0)
    narrow = rows.select(F.col(group).alias("_g"), F.col(order).alias("_o"), length.cast("bigint").alias("_n"))
    known = narrow.agg(F.count(F.lit(1)), F.sum("_n")).first()
    docs = range_docs or max(65_536, min(2_000_000, 256 * size * known[0] // max(1, known[1] or 1)))
    def assign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        opens, _, _ = fill_shards(pdf["_n"].to_numpy(), size, int(pdf["_fill"].iloc[0]))
        return pd.DataFrame({"_g": pdf["_g"], "_o": pdf["_o"], "shard": int(pdf["_shard"].iloc[0]) + np.cumsum(opens)})

    if known[0] <= docs:
        # One range, and nothing before it.
        before = narrow.withColumns({c: F.lit(0).cast("bigint") for c in ("_range", "_fill", "_shard")})
    else:
        ranked = scan(narrow, ["_g"], id_block("_o"), ["_o"], "_r")
        placed = checkpoint(ranked.withColumn("_range", F.floor((F.col("_r") - 1) / docs)).drop("_r"))
        entry = _ranges(placed, size, kinds[group])
        entry = small(checkpoint(entry).select(F.col("_g").alias("_eg"), F.col("_range").alias("_er"), "_fill", "_shard"))
        before = placed.join(entry, F.col("_g").eqNullSafe(F.col("_eg")) & (F.col("_range") == F.col("_er"))).drop("_eg", "_er")
    found = before.groupBy("_g", "_range").applyInPandas(assign, f"_g {kinds[group]}, _o {kinds[order]}, shard bigint")
    return rows.join(found, F.col(group).eqNullSafe(F.col("_g")) & (F.col(order) == F.col("_o"))).drop("_g", "_o")


def shard_summary(rows: DataFrame, group: str = "split", eos: int = -1) -> DataFrame:
    length = F.col("n_tokens") + (1 if eos >= 0 else 0)
    return rows.groupBy(group, "shard").agg(F.count(F.lit(1)).alias("num_docs"), F.sum(length).alias("num_tokens"))


def with_offsets(rows: DataFrame, group: list[str], order: str, tokens: str = "n_tokens", size: int = 4096) -> DataFrame:
    """Adds `start`, `stop`: where each document's tokens stand in the group's stream."""
    out = scan(rows, group, id_block(order, size), [order], "_r", {"stop": tokens})
    return out.drop("_r").withColumn("start", F.col("stop") - F.col(tokens))


def windows(rows: DataFrame, length: int, group: list[str], order: str, offset: int = 0) -> DataFrame:
    """Training windows of a token stream: `window_id`, `x`, `y` of `length` tokens each, `y` one token later.

    Windows are `length + 1` apart from `offset` on, and the last, incomplete one is dropped. Documents are cut into
    the parts that each window needs (never into single tokens), and a window's parts are put together in order.
    Needs `tokens`, `n_tokens`. A window's parts are bounded by its tokens.
    """
    width = length + 1
    at = with_offsets(rows, group, order)
    a, b = F.col("start") - offset, F.col("stop") - offset
    first, last = F.floor(F.greatest(a, F.lit(0)) / width), F.floor((b - 1) / width)
    cut = at.where(b > 0).where(F.col("n_tokens") > 0).select(*group, "start", "tokens", F.explode(F.sequence(first, last)).alias("window_id"), "stop")
    begin = F.greatest(F.col("window_id") * width + offset, F.col("start"))
    end = F.least((F.col("window_id") + 1) * width + offset, F.col("stop"))
    parts = cut.select(*group, "window_id", begin.alias("begin"), F.slice("tokens", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    whole = parts.groupBy(*group, "window_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda s: s["part"])).alias("w"))
    whole = whole.where(F.size("w") == width)
    return whole.select(*group, "window_id", F.slice("w", 1, length).alias("x"), F.slice("w", 2, length).alias("y"))


def batches(samples: DataFrame, size: int, seed: int | None = None, key: str = "window_id", group: list[str] | None = None, drop_last: bool = False) -> DataFrame:
    """Adds `batch_id` and `place`: samples in order, or in seeded order, dealt into batches of `size`; the last may be smaller.

    With `drop_last` an incomplete one is left out. Groups (splits) have batches of their own.
    """
    if seed is None:
        dealt = scan(samples, group or [], id_block(key, 65536), [key], "_i", total="_all" if drop_last else None)
    else:
        keyed = samples.withColumn("_k", md5_key(seed, F.col(key)))
        dealt = scan(keyed, group or [], md5_block(F.col("_k"), samples.count()), ["_k", key], "_i", total="_all" if drop_last else None).drop("_k")
    if drop_last:
        dealt = dealt.where(F.col("_i") <= F.floor(F.col("_all") / size) * size).drop("_all")
    return dealt.withColumn("batch_id", F.floor((F.col("_i") - 1) / size)).withColumn("place", F.pmod(F.col("_i") - 1, F.lit(size))).drop("_i")


def rank_shards(samples: DataFrame, world: int, seed: int | None, key: str = "window_id", group: list[str] | None = None) -> DataFrame:
    """Adds `rank` (0..world - 1) and `turn`: samples dealt to workers in (seeded) order, the last ones kept."""
    if seed is None:
        dealt = scan(samples, group or [], id_block(key, 65536), [key], "_i")
    else:
        keyed = samples.withColumn("_k", md5_key(seed, F.col(key)))
        dealt = scan(keyed, group or [], md5_block(F.col("_k"), samples.count()), ["_k", key], "_i").drop("_k")
    return dealt.withColumn("rank", F.pmod(F.col("_i") - 1, F.lit(world))).withColumn("turn", F.floor((F.col("_i") - 1) / world)).drop("_i")


def within_budget(rows: DataFrame, budget: int, cost: str, order: str, group: list[str] | None = None, overshoot: bool = True) -> DataFrame:
    """Rows in order as long as the cost before them is below the budget (or, without overshoot, with them within it)."""
    at = scan(rows, group or [], id_block(order, 65536), [order], "_r", {"_upto": cost})
    keep = F.col("_upto") - F.col(cost) < budget if overshoot else F.col("_upto") <= budget
    return at.where(keep).drop("_r", "_upto")


def token_prefix(rows: DataFrame, limit: int, order: str) -> DataFrame:
    """The first `limit` tokens of the stream, the last document cut. Needs `tokens`, `n_tokens`."""
    at = with_offsets(rows, [], order).where(F.col("start") < limit)
    return at.withColumn("tokens", F.slice("tokens", 1, F.least(F.col("n_tokens"), F.lit(limit) - F.col("start")).cast("int"))).withColumn("n_tokens", F.size("tokens").cast("bigint"))


def corpus_prefix(rows: DataFrame, characters: int, order: list[str]) -> DataFrame:
    """Texts in order up to a number of characters, the last one cut: the sample that a tokenizer would be fitted on."""
    sized = rows.withColumn("_n", F.char_length("text").cast("bigint"))
    at = scan(sized, [], id_block(order[-1], 4096) if len(order) == 1 else F.struct(*order[:-1], id_block(order[-1], 4096).alias("b")), list(order), "_r", {"_upto": "_n"})
    at = at.where(F.col("_upto") - F.col("_n") < characters)
    return at.withColumn("text", F.substring("text", F.lit(1), F.least(F.col("_n"), F.lit(characters) - (F.col("_upto") - F.col("_n"))).cast("int"))).drop("_r", "_upto", "_n")




def subset_statistics(rows: DataFrame, budget: int, cost: str = "n_bytes", lines: str | None = "n_lines") -> DataFrame:
    """Documents, lines, bytes, tokens at four bytes each, and how far the budget was exceeded (percent)."""
    used = F.coalesce(F.sum(cost), F.lit(0))
    n_lines = F.coalesce(F.sum(lines), F.lit(0)) if lines else F.lit(0).cast("bigint")
    out = rows.agg(F.count(F.lit(1)).alias("n_docs"), n_lines.alias("n_lines"), used.alias("n_bytes"))
    over = F.greatest(F.lit(0), F.col("n_bytes") - budget) * 100.0 / budget
    return out.withColumns({"est_tokens": F.floor(F.col("n_bytes") / 4), "overage_percent": over})
