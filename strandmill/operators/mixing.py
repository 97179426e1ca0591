"""Sampling, mixing, curriculum and splits on narrow rows (`source`, `doc_ord`, `n_tokens`).

Seeded order is the order of md5 keys, so it is the same on any engine and cluster. Tokens are joined last, by the
sink: everything here moves a few dozen bytes per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordinal import id_block, md5_block, md5_key, scan
from ..session import checkpoint, small


def normalized_ratios(ratios: dict[str, float]) -> dict[str, float]:
    whole = sum(ratios.values())
    if whole <= 0:
        raise ValueError("ratios must have a positive sum")
    return {k: v / whole for k, v in ratios.items()}


def derive_ratios(weights: dict[str, float], explicit: dict[str, float] | None, weight_by: str = "docs") -> dict[str, float] | None:
    """Explicit ratios win; else weights count if they differ or tokens are to be weighted; else there are none."""
    if explicit:
        return dict(explicit)
    active = {k: w for k, w in weights.items() if w > 0}
    if active and (weight_by == "tokens" or len(set(active.values())) > 1):
        return active
    return None


def counts(documents: DataFrame) -> DataFrame:
    """Per source: `n_docs`, `n_tokens_all`."""
    return documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens_all"))


def targets(documents: DataFrame, ratios: dict[str, float] | None = None, total_docs: int | None = None, total_tokens: int | None = None, balance: str | None = None) -> DataFrame:
    """Documents wanted of each source: `source`, `n_docs`, `target`.

    With ratios and a total: `int(total * ratio)` documents, or the documents that hold as many tokens at the source's
    mean length, at least one of a positive share. Sources without a ratio share what the ratios leave. Without ratios
    `total_docs` is wanted of each source; `balance` "max" or "min" wants as many as the largest or smallest source has.
    """
    sizes = counts(documents)
    if ratios and (total_docs or total_tokens):
        share = normalized_ratios(ratios)
        table = documents.sparkSession.createDataFrame(sorted(share.items()), "_s string, ratio double")
        missing = sizes.join(F.broadcast(table), F.col("source") == F.col("_s"), "left_anti").agg(F.count(F.lit(1)).alias("missing"))
        left = max(0.0, 1.0 - sum(share.values()))
        joined = sizes.join(F.broadcast(table), F.col("source") == F.col("_s"), "left").join(F.broadcast(missing))
        ratio = F.coalesce(F.col("ratio"), F.lit(left) / F.greatest(F.col("missing"), F.lit(1)))
        if total_docs:
            target = F.floor(F.lit(float(total_docs)) * ratio)
        else:
            mean = F.greatest(F.lit(1.0), F.col("n_tokens_all") / F.col("n_docs"))
            wanted = F.floor(F.lit(float(total_tokens)) * ratio)
            target = F.when(wanted <= 0, 0).otherwise(F.greatest(F.lit(1), F.floor(wanted / mean)))
        return joined.select("source", "n_docs", target.cast("bigint").alias("target"))
    if total_docs:
        return sizes.select("source", "n_docs", F.lit(total_docs).cast("bigint").alias("target"))
    if balance is None:
        return sizes.select("source", "n_docs", F.col("n_docs").alias("target"))
    if balance not in ("max", "min"):
        raise ValueError("balance is 'max' or 'min'")
    bound = sizes.agg((F.max if balance == "max" else F.min)("n_docs").alias("target"))
    return sizes.select("source", "n_docs").join(F.broadcast(bound))


def shuffled(documents: DataFrame, seed: int) -> DataFrame:
    """Adds `place` (from 0) in the seeded order of each source and `n_docs` of the source."""
    keyed = documents.withColumn("_key", md5_key(seed, F.col("source"), F.col("doc_ord")))
    out = scan(keyed, ["source"], md5_block(F.col("_key"), documents.count()), ["_key", "doc_ord"], "place", total="n_docs")
    return out.withColumn("place", F.col("place") - 1).drop("_key")


def counted(rows: DataFrame, first, stop, name: str, step: int = 65_536) -> DataFrame:
    """A row for each number from `first` up to `stop`, in two steps, so that no array grows with the data."""
    parts = rows.where(stop > first).withColumn("_part", F.explode(F.sequence(first, stop - 1, F.lit(step).cast("bigint"))))
    return parts.withColumn(name, F.explode(F.sequence("_part", F.least(F.col("_part") + step, stop) - 1))).drop("_part")


def sample(documents: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Draws `target` documents of each source: `draw` from 0 with the columns of the document.

    As many as there are: all, in order. Fewer: without replacement, the first of the seeded order. More: with
    replacement, draw i takes the document at a hash of (seed, source, i). A source without a target gives none.
    """
    plan = small(wanted.select(F.col("source").alias("_s"), "target", F.col("n_docs").alias("_n")).where("target > 0"))
    ranked = shuffled(documents.select("source", "doc_ord", "n_tokens"), seed).drop("n_docs").join(plan, F.col("source") == F.col("_s"))
    down = ranked.where("target < _n and place < target").select("source", "doc_ord", "n_tokens", F.col("place").alias("draw"))
    whole = documents.select("source", "doc_ord", "n_tokens").join(plan, (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_n")))
    same = scan(whole.drop("_s", "target", "_n"), ["source"], id_block("doc_ord", 4096), ["doc_ord"], "draw").withColumn("draw", F.col("draw") - 1)
    draws = counted(plan.where("target > _n"), F.lit(0).cast("bigint"), F.col("target"), "draw")
    key = F.conv(F.substring(md5_key(seed, F.col("_s"), F.col("draw")), 1, 8), 16, 10).cast("bigint")
    draws = draws.select(F.col("_s").alias("_d"), "draw", F.pmod(key, F.col("_n")).alias("_at"))
    up = draws.join(ranked.where("target > _n").select("source", "doc_ord", "n_tokens", "place"), (F.col("_d") == F.col("source")) & (F.col("_at") == F.col("place")))
    return down.unionByName(same.select("source", "doc_ord", "n_tokens", "draw")).unionByName(up.select("source", "doc_ord", "n_tokens", "draw"))


def with_source_order(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds `source_ord`: the place in a given list, else in the alphabet."""
    if order is None:
        names = rows.select("source").distinct()
        ranks = scan(names, [], F.lit(0), ["source"], "source_ord")
        table = ranks.select(F.col("source").alias("_s"), (F.col("source_ord") - 1).alias("source_ord"))
    else:
        table = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(order)], "_s string, source_ord bigint")
    return rows.join(small(table), F.col("source") == F.col("_s")).drop("_s")


def concatenate(drawn: DataFrame) -> DataFrame:
    """`mix_ord` (from 0): sources one after another, each in the order of its draws. Needs `source_ord`."""
    out = scan(drawn, [], F.struct("source_ord", id_block("draw", 65536).alias("b")), ["source_ord", "draw"], "mix_ord")
    return out.withColumn("mix_ord", F.col("mix_ord") - 1)


def interleave(drawn: DataFrame, seed: int, block_size: int = 1) -> DataFrame:
    """`mix_ord` (from 0): rounds of up to `block_size` documents of each source that has some left, each source shuffled.

    In closed form: a document at shuffled place p is in round p div block size, and rounds are sorted by source.
    """
    keyed = drawn.withColumn("_key", md5_key(seed, F.col("source"), F.col("draw")))
    n = drawn.count()
    placed = scan(keyed, ["source"], md5_block(F.col("_key"), n), ["_key", "draw"], "_p").drop("_key")
    rounds = placed.withColumn("_p", F.col("_p") - 1).withColumn("_round", F.floor(F.col("_p") / block_size))
    out = scan(rounds, [], F.floor(F.col("_round") / max(256, n // 1_000_000)), ["_round", "source_ord", "_p"], "mix_ord")
    return out.withColumn("mix_ord", F.col("mix_ord") - 1).drop("_p", "_round")


#: The mixers by name.
MIXERS = {"interleave": interleave, "concatenate": lambda drawn, seed=0, block_size=1: concatenate(drawn)}

# What is added to the seed for the schedule of each split.
SCHEDULE_OFFSETS = {"train": 0, "val": 1, "test": 2}


def schedule(rows: DataFrame, seed: int) -> DataFrame:
    """`write_ord` (from 0) within a split: slots of sources in seeded order, each source's documents in their own order.

    Needs `split`, `source`, `draw`.
    """
    own = scan(rows, ["split", "source"], id_block("draw", 65536), ["draw"], "_i").withColumn("_i", F.col("_i") - 1)
    # A source's slots are a set of keys; sorting them tells the slot of its i-th document.
    offset = F.lit(seed) + F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).when(F.col("split") == "test", 2).otherwise(3)
    keyed = own.withColumn("_key", md5_key(offset, F.col("split"), F.col("source"), F.col("_i")))
    slots = scan(keyed.select("split", "source", "_key"), ["split"], md5_block(F.col("_key"), rows.count()), ["_key", "source"], "_slot")
    order = scan(slots, ["split", "source"], id_block("_slot", 65536), ["_slot"], "_j")
    order = order.select(F.col("split").alias("_sp"), F.col("source").alias("_so"), (F.col("_j") - 1).alias("_j"), (F.col("_slot") - 1).alias("write_ord"))
    return own.join(order, (F.col("split") == F.col("_sp")) & (F.col("source") == F.col("_so")) & (F.col("_i") == F.col("_j"))).drop("_sp", "_so", "_i", "_j")


# ---------------------------------------------------------------- curriculum


def by_length(rows: DataFrame, stages: int, order: str = "doc_ord") -> DataFrame:
    """`stage_ord`, `stage`: equal parts of the documents by length, the rest in the last; names tell the lengths."""
    ranked = scan(rows, [], F.struct(F.col("n_tokens").alias("a"), id_block(order, 65536).alias("b")), ["n_tokens", order], "_rn", total="_n")
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / stages))
    staged = ranked.withColumn("stage_ord", F.least(F.floor((F.col("_rn") - 1) / size), F.lit(stages - 1)).cast("bigint")).drop("_rn", "_n")
    names = staged.groupBy("stage_ord").agg(F.min("n_tokens").alias("a"), F.max("n_tokens").alias("b"))
    names = names.select(F.col("stage_ord").alias("_o"), F.concat(F.lit("stage"), F.col("stage_ord"), F.lit("_len"), F.col("a"), F.lit("-"), F.col("b")).alias("stage"))
    return staged.join(F.broadcast(names), F.col("stage_ord") == F.col("_o")).drop("_o")


def by_domain(rows: DataFrame, order: str) -> DataFrame:
    """A stage per source, in the order in which sources first appear."""
    first = rows.groupBy("source").agg(F.min(order).alias("_first"))
    ranks = scan(first, [], F.lit(0), ["_first", "source"], "stage_ord").select(F.col("source").alias("_s"), (F.col("stage_ord") - 1).alias("stage_ord"))
    return rows.join(small(ranks), F.col("source") == F.col("_s")).drop("_s").withColumn("stage", F.concat(F.lit("stage"), F.col("stage_ord"), F.lit("_"), F.col("source")))


def reweighted(rows: DataFrame, weights: dict[str, float], order: str, seed: int = 42) -> DataFrame:
    """As many rows as there are, drawn by source weights; sources in the order in which they first appear, then draws."""
    wanted = targets(rows, weights, total_docs=rows.count())
    first = rows.groupBy("source").agg(F.min(order).alias("_first"))
    ranks = scan(first, [], F.lit(0), ["_first", "source"], "_so").select(F.col("source").alias("_s"), "_so")
    drawn = sample(rows, wanted, seed).join(small(ranks), F.col("source") == F.col("_s"))
    out = scan(drawn, [], F.struct("_so", id_block("draw", 65536).alias("b")), ["_so", "draw"], order)
    return out.withColumn(order, F.col(order) - 1).select("source", "doc_ord", "n_tokens", order)


def by_rules(rows: DataFrame, stages: list[dict], order: str) -> DataFrame:
    """Stages that may overlap: name, least and greatest length (0 or None: any), sources, then a part of the first.

    `source_weights` draws a stage's documents anew by source. `fraction` counts `int(all documents * fraction)`;
    without it (or 0) `num_docs` is the limit; without both all match. Gives `stage_ord`, `stage`, `source`, `doc_ord`,
    `n_tokens` and `order`.
    """
    table = [
        (i, s["name"], s.get("min_length") or None, s.get("max_length") or None, s.get("sources") or None, s.get("fraction") or None, s.get("num_docs") or None)
        for i, s in enumerate(stages)
    ]
    kinds = "stage_ord bigint, stage string, _min bigint, _max bigint, _sources array<string>, _fraction double, _docs bigint"
    each = F.broadcast(rows.sparkSession.createDataFrame(table, kinds))
    fits = (
        (F.col("_min").isNull() | (F.col("n_tokens") >= F.col("_min")))
        & (F.col("_max").isNull() | (F.col("n_tokens") <= F.col("_max")))
        & (F.col("_sources").isNull() | F.array_contains(F.col("_sources"), F.col("source")))
    )
    columns = ["stage_ord", "source", "doc_ord", "n_tokens", order]
    named = [c for c in dict.fromkeys(["source", "doc_ord", "n_tokens", order])]
    matched = rows.select(*named).join(each, fits).select(*dict.fromkeys(columns))
    weighted = [i for i, s in enumerate(stages) if s.get("source_weights")]
    picked = matched.where(~F.col("stage_ord").isin(weighted)) if weighted else matched
    for i in weighted:
        mine = checkpoint(matched.where(F.col("stage_ord") == i).drop("stage_ord"))
        again = reweighted(mine.withColumn("_at", F.col(order)), stages[i]["source_weights"], "_at")
        again = again.withColumn("stage_ord", F.lit(i).cast("bigint"))
        if order != "doc_ord":
            again = again.withColumn(order, F.col("_at"))
        picked = picked.unionByName(again.select(*dict.fromkeys(columns)))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_all")))
    caps = F.broadcast(rows.sparkSession.createDataFrame(table, kinds).select("stage_ord", "stage", "_fraction", "_docs"))
    ranked = scan(picked, ["stage_ord"], id_block(order, 65536), [order], "_rank").join(total).join(caps, "stage_ord")
    cap = F.when(F.col("_fraction").isNotNull(), F.floor(F.col("_all") * F.col("_fraction"))).otherwise(F.col("_docs"))
    return ranked.where(cap.isNull() | (F.col("_rank") <= cap)).select("stage_ord", "stage", *named)


def curriculum_outputs(staged: DataFrame, mode: str) -> DataFrame:
    """Adds `output`: "merged" for all stages as one, the stage's name for each ("separate"), or both."""
    merged = staged.withColumn("output", F.lit("merged"))
    separate = staged.withColumn("output", F.col("stage"))
    if mode == "merged":
        return merged
    if mode == "separate":
        return separate
    if mode == "both":
        return separate.unionByName(merged)
    raise ValueError(f"unknown output mode {mode!r}")


# ---------------------------------------------------------------- splits


def _cut(place, n, train: float, val: float):
    """The split at a place from 0: counts are the integer parts of products of doubles; what is left is test."""
    share = F.lit(float(train)) + F.lit(float(val))
    return F.when(place < F.floor(n * F.lit(float(train))), "train").when(place < F.floor(n * share), "val").otherwise("test")


def split_stratified(rows: DataFrame, seed: int, train: float, val: float, order: str = "doc_ord", shuffle: bool = True) -> DataFrame:
    """`split` of each row, cut within each source in seeded order (or in `order`)."""
    keyed = rows.withColumn("_key", md5_key(seed, F.col("source"), F.col(order)) if shuffle else F.lit(""))
    block = md5_block(F.col("_key"), rows.count()) if shuffle else id_block(order, 4096)
    ranked = scan(keyed, ["source"], block, ["_key", order], "_p", total="_n")
    return ranked.withColumn("split", _cut(F.col("_p") - 1, F.col("_n"), train, val)).drop("_key", "_p", "_n")


def split_simple(rows: DataFrame, seed: int, train: float, val: float, order: str = "doc_ord", shuffle: bool = True) -> DataFrame:
    """`split` of each row, cut over all rows."""
    keyed = rows.withColumn("_key", md5_key(seed, F.col("source"), F.col(order)) if shuffle else F.lit(""))
    block = md5_block(F.col("_key"), rows.count()) if shuffle else id_block(order, 4096)
    ranked = scan(keyed, [], block, ["_key", order, "source"], "_p", total="_n")
    return ranked.withColumn("split", _cut(F.col("_p") - 1, F.col("_n"), train, val)).drop("_key", "_p", "_n")
