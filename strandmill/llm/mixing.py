"""Problem 7: mixing sources to target shares of tokens.

Each source is one long sequence of tokens in document order, cut into blocks of a fixed number of tokens. A plan
needs a number of blocks of each source; output shards get theirs by multinomial draws, conditioned on the exact totals
(a multivariate hypergeometric draw), so that shares don't drift: first groups of shards, then the shards of each group, in
parallel. The j-th slot of a source takes block
`permutation(pass, j mod blocks)` of pass `j div blocks`: a keyed Feistel permutation of the block numbers, which costs
no shuffle and repeats no block within a pass. Blocks are then joined with the spans of documents by block number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.mixing import counted as numbered
from ..ordinal import id_block, scan
from ..session import checkpoint, small
from . import encoding

BLOCK_TOKENS = 128
SHARD_BLOCKS = 1024
#: Shards are drawn in so many groups on the driver, and within each group by a task.
GROUPS = 1024
#: More rows of targets than these raise an error.
MOST_TARGETS = 10_000


@dataclass
class Quota:
    """What a plan takes of a source."""

    plan: str
    source: str
    share: float
    tokens_wanted: float
    repeats: int
    available: int
    blocks: int
    slots: int
    capped: bool


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A hash of 64-bit integers (multiply, shift, exclusive or)."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permutation(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Maps index i of 0..size-1 to another, one to one for each (size, key); arrays of equal length.

    A Feistel network over the next power of four, walked until the value is within the size.
    """
    size = size.astype(np.uint64)
    half = np.ones(len(size), np.uint64)
    while (wide := (half * np.uint64(2)) < np.uint64(64)).any():
        need = wide & ((np.uint64(1) << (half * np.uint64(2))) < size)
        if not need.any():
            break
        half[need] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, go = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(go):
        left, right = out[go] >> half[go], out[go] & mask[go]
        for turn in range(4):
            left, right = right, left ^ (_mixed(right ^ key[go], 0x51ED27 * (turn + 1)) & mask[go])
        out[go] = left << half[go] | right
        go = go[out[go] >= size[go]]
    return out.astype(np.int64)


def quotas(targets: list[tuple], totals: dict[str, int], block: int = BLOCK_TOKENS) -> list[Quota]:
    """The blocks that each plan takes of each source.

    Shares are ratios over the sum of the plan's positive ratios; null, zero and negative ratios take nothing. A plan
    without a total takes as many tokens as its sources hold. A source gives at most `max_repeats` times its blocks
    (null: once); what it lacks is not taken from others, so that those keep their own amounts.
    """
    out = []
    for name in sorted({t[0] for t in targets}):
        rows = sorted({t[1]: t for t in sorted(targets, key=str) if t[0] == name and t[1] is not None}.values(), key=lambda t: t[1])
        ratio = {t[1]: max(0.0, t[2] or 0.0) for t in rows}
        whole = sum(ratio.values())
        total = next((t[4] for t in rows if t[4] is not None), None)
        if total is None:
            total = sum(totals.get(s, 0) for s in ratio if ratio[s] > 0)
        exact = {s: (r / whole * total / block if whole else 0.0) for s, r in ratio.items()}
        slots = {s: int(x) for s, x in exact.items()}
        for s in sorted(exact, key=lambda s: (slots[s] - exact[s], s))[: round(sum(exact.values())) - sum(slots.values())]:
            slots[s] += 1
        for t in rows:
            s, repeats = t[1], max(0, 1 if t[3] is None else t[3])
            blocks = -(-totals.get(s, 0) // block)
            n = min(slots[s], blocks * repeats)
            out.append(Quota(name, s, ratio[s] / whole if whole else 0.0, exact[s] * block, repeats, totals.get(s, 0), blocks, n, n < slots[s]))
    return out


def _rng(*key) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest("|".join(map(str, key)))))


def draws(left: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many slots of each source each of some parts gets: multinomial draws, given that all slots are used.

    Parts of `sizes` are drawn one after another without replacement, which is what multinomial draws are once their
    totals are known. The library draws from fewer than 10^9 slots; of more, in units of several.
    """
    left, out = left.copy(), np.zeros((len(sizes), len(left)), np.int64)
    for k, size in enumerate(sizes):
        unit = -(-int(left.sum()) // 500_000_000) or 1
        if k == len(sizes) - 1:
            out[k] = left
        else:
            some = min(int(size) // unit, int((left // unit).sum()))
            out[k] = np.minimum(left, rng.multivariate_hypergeometric(left // unit, some, method="marginals") * unit)
        left -= out[k]
    return out


def shard_groups(plan: list[Quota], seed: int, groups: int = GROUPS) -> list[tuple]:
    """(plan, group, first shard, shards, source, first slot, slots, blocks, key) of each group of shards that takes from a source.

    A shard has `SHARD_BLOCKS` slots, whatever their number; groups hold as many shards each.
    """
    name, slots = plan[0].plan, np.array([q.slots for q in plan], np.int64)
    total = int(slots.sum())
    shards = -(-total // SHARD_BLOCKS)
    groups = min(groups, shards)
    edges = [g * shards // max(groups, 1) for g in range(groups + 1)]
    sizes = np.diff([e * total // max(shards, 1) for e in edges])
    drawn = draws(slots, sizes, _rng(seed, name))
    first = np.cumsum(drawn, axis=0) - drawn
    return [
        (name, g, edges[g], edges[g + 1] - edges[g], q.source, int(first[g, i]), int(drawn[g, i]), q.blocks, xxhash.xxh64_intdigest(f"{seed}|{name}|{q.source}") >> 1)
        for g in range(groups)
        for i, q in enumerate(plan)
        if drawn[g, i]
    ]


_SHARDS = "plan_name string, source string, shard bigint, first bigint, n bigint, blocks bigint, key bigint"


def _shards(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The shards of a group: what each takes of each source."""
    pdf = pdf.sort_values("source")
    name, group, shard, shards = (pdf[c].iloc[0] for c in ("plan_name", "group", "shard", "shards"))
    total = int(pdf["n"].sum())
    drawn = draws(pdf["n"].to_numpy(), np.diff([k * total // shards for k in range(shards + 1)]), _rng(seed, name, group))
    first = np.cumsum(drawn, axis=0) - drawn + pdf["first"].to_numpy()
    k, i = np.nonzero(drawn)
    columns = {c: pdf[c].to_numpy()[i] for c in ("source", "blocks", "key")}
    return pd.DataFrame({"plan_name": name, "source": columns["source"], "shard": shard + k, "first": first[k, i], "n": drawn[k, i], "blocks": columns["blocks"], "key": columns["key"]})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
        slot, size, key = (get(n).to_numpy(zero_copy_only=False) for n in ("slot", "blocks", "key"))
        turn, index = slot // size, slot % size
        keys = _mixed(key.astype(np.uint64) ^ turn.astype(np.uint64), 7)
        found = permutation(index, size, keys)
        yield pa.RecordBatch.from_arrays([get("plan_name"), get("source"), get("shard"), get("slot"), pa.array(found)], ["plan_name", "source", "shard", "slot", "block"])


@dataclass
class Mix:
    """A mix as lazy tables: document spans by block, drawn blocks, and the quotas."""

    spans: DataFrame
    drawn: DataFrame
    quotas: DataFrame
    ids: Callable[[], DataFrame]
    size: int

    def documents(self) -> DataFrame:
        """`plan_name`, `source`, `doc_id`, `uses` (the most that any of its tokens is used), `tokens` (drawn in all)."""
        times = self.drawn.groupBy("plan_name", "source", "block").agg(F.count(F.lit(1)).alias("uses"))
        return (
            times.join(self.spans, ["source", "block"])
            .groupBy("plan_name", "source", "doc_id")
            .agg(F.max("uses").alias("uses"), F.sum(F.col("uses") * F.col("length")).alias("tokens"))
        )

    def slots(self) -> DataFrame:
        """The mixed output in order: `plan_name`, `shard`, `place` in the shard, `source`, `block`, `turn` (times drawn before)."""
        by = Window.partitionBy("plan_name", "shard").orderBy(F.xxhash64("plan_name", "source", "slot"), "source", "slot")
        return self.drawn.withColumn("place", F.row_number().over(by)).select("plan_name", "shard", "place", "source", "block", "slot")

    def blocks(self) -> DataFrame:
        """The mixed output with its tokens: `plan_name`, `shard`, `place`, `source`, `block`, `ids`.

        Texts are encoded again and cut into blocks in the same order as the spans; parts of blocks that nobody drew are
        dropped before they are put together. A source's last block may be shorter.
        """
        slots = self.slots()
        wanted = slots.select("source", "block").distinct()
        rows = self.ids().withColumn("n_tokens", F.size("ids").cast("bigint")).where("n_tokens > 0")
        at = scan(rows, ["source"], id_block("doc_id", 256), ["doc_id", "n_tokens", F.xxhash64("ids")], running={"stop": "n_tokens"}).withColumn("start", F.col("stop") - F.col("n_tokens"))
        first, last = F.floor(F.col("start") / self.size), F.floor((F.col("stop") - 1) / self.size)
        parts = at.select("source", "start", "stop", "ids", F.explode(F.sequence(first, last)).alias("block"))
        begin, end = F.greatest("start", F.col("block") * self.size), F.least("stop", (F.col("block") + 1) * self.size)
        parts = parts.select("source", "block", begin.alias("begin"), F.slice("ids", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
        whole = parts.join(wanted, ["source", "block"], "left_semi").groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("p"))
        tokens = whole.select("source", "block", F.flatten(F.transform("p", lambda x: x["part"])).alias("ids"))
        return slots.join(tokens, ["source", "block"]).select("plan_name", "shard", "place", "source", "block", "ids")

    def limits(self) -> DataFrame:
        """Per plan and source: `target_share`, and whether no token is used more often than allowed and no more are drawn than repeats give."""
        most = F.col("max_repeats")
        return self.shares().select("plan_name", "source", F.round("target_share", 9).alias("target_share"), ((F.col("most_uses") <= most) & (F.col("tokens_drawn") <= most * F.col("tokens_available"))).alias("is_within"))

    def shares(self) -> DataFrame:
        """Per plan and source: target and actual share of the tokens, the tokens themselves and the largest number of uses."""
        got = self.documents().groupBy("plan_name", "source").agg(F.sum("tokens").alias("tokens_drawn"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses"))
        every = self.quotas.join(small(got), ["plan_name", "source"], "left").na.fill(0, ["tokens_drawn", "n_documents", "most_uses"])
        whole = every.groupBy("plan_name").agg(F.sum("tokens_drawn").alias("_all"))
        return every.join(F.broadcast(whole), "plan_name").select(
            "plan_name", "source", "target_share", F.when(F.col("_all") > 0, F.col("tokens_drawn") / F.col("_all")).otherwise(0.0).alias("actual_share"),
            "tokens_wanted", "tokens_drawn", "tokens_available", "max_repeats", "most_uses", "n_documents", "capped",
        )


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, block: int = BLOCK_TOKENS, vocabulary: str = encoding.BYTE_BPE_50K, folder: str = encoding.TOKENIZERS) -> Mix:
    """The mix of each plan of `targets` from `documents`.

    Documents without tokens (null or empty text) or source, or of sources in no plan, are not drawn. A source
    without documents gives nothing and is reported. Repeated rows are documents of their own. Rows of a plan that
    name a source twice count once. Empty tables give empty results.
    """
    spark = documents.sparkSession
    rows = [tuple(r) for r in targets.where("plan_name is not null").select("plan_name", "source", "target_ratio", "max_repeats", "target_total_tokens").limit(MOST_TARGETS + 1).collect()]
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = sorted({r[1] for r in rows if r[1] is not None and (r[2] or 0) > 0})
    counted = encoding.token_counts(documents.where(F.col("source").isin(wanted)), ["doc_id", "source"], vocabulary=vocabulary, folder=folder)
    counted = checkpoint(counted.where("n_tokens > 0"))
    totals = {r[0]: int(r[1]) for r in counted.groupBy("source").agg(F.sum("n_tokens")).collect()}
    plan = quotas(rows, totals, block)
    names = sorted({q.plan for q in plan})
    groups = [g for n in names for g in shard_groups([q for q in plan if q.plan == n], seed)]
    kind = "plan_name string, group bigint, shard bigint, shards bigint, source string, first bigint, n bigint, blocks bigint, key bigint"
    group_table = spark.createDataFrame(groups, kind)
    names = [c.split()[0] for c in _SHARDS.split(", ")]
    shard_table = group_table.where("shards = 1").select(*names)
    if any(g[3] > 1 for g in groups):
        shard_table = shard_table.unionByName(group_table.where("shards > 1").groupBy("plan_name", "group").applyInPandas(lambda pdf: _shards(pdf, seed), _SHARDS))
    slots = numbered(shard_table, F.col("first"), F.col("first") + F.col("n"), "slot").select("plan_name", "source", "shard", "blocks", "key", "slot")
    drawn = slots.mapInArrow(_blocks, "plan_name string, source string, shard bigint, slot bigint, block bigint")
    at = scan(counted, ["source"], id_block("doc_id", 4096), ["doc_id", "n_tokens"], running={"stop": "n_tokens"}).withColumn("start", F.col("stop") - F.col("n_tokens"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
    spans = at.select("source", "doc_id", "start", "stop", F.explode(F.sequence(first, last)).alias("block"))
    spans = spans.select("source", "block", "doc_id", (F.least("stop", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("length"))
    kind = "plan_name string, source string, target_share double, tokens_wanted double, tokens_available bigint, max_repeats int, capped boolean"
    quota_table = spark.createDataFrame([(q.plan, q.source, q.share, q.tokens_wanted, q.available, q.repeats, q.capped) for q in plan], kind)
    ids = lambda: encoding.encode(documents.where(F.col("source").isin(wanted)), vocabulary=vocabulary, folder=folder, keep="source")
    return Mix(spans, drawn, quota_table, ids, block)
