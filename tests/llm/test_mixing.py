import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmill.llm import encoding, mixing


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one(size):
    seen = []
    for key in (1, 2, 3):
        out = mixing.permutation(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
        assert sorted(out.tolist()) == list(range(size))
        seen.append(tuple(out.tolist()))
    assert size < 16 or len(set(seen)) == 3


def test_quotas():
    targets = [("p", "a", 3.0, 2, 1000), ("p", "b", 1.0, 1, 1000), ("p", "none", 0.0, 1, 1000), ("p", "gone", None, None, 1000), ("q", "a", 1.0, None, None), ("z", "a", 0.0, 1, 10)]
    found = {(q.plan, q.source): q for q in mixing.quotas(targets, {"a": 5000, "b": 100}, 10)}
    assert found["p", "a"].slots == 75 and not found["p", "a"].capped
    assert found["p", "b"].slots == 10 and found["p", "b"].capped and found["p", "b"].share == 0.25
    assert found["p", "none"].slots == found["p", "gone"].slots == found["z", "a"].slots == 0
    assert found["q", "a"].slots == 500


@pytest.mark.parametrize("groups", [1, 3, 1024])
def test_shards_take_exact_totals(groups):
    """All shards have the same size, and each source's slots follow each other over the shards, whatever the groups."""
    slots = {"a": 50_000, "b": 3, "c": 0}
    plan = [mixing.Quota("p", s, 0.5, 0, 9, 0, 500, n, False) for s, n in slots.items()]
    rows = []
    columns = ["plan_name", "group", "shard", "shards", "source", "first", "n", "blocks", "key"]
    found = pd.DataFrame(mixing.shard_groups(plan, 7, groups), columns=columns)
    assert found.equals(pd.DataFrame(mixing.shard_groups(plan, 7, groups), columns=columns)) and not found.equals(pd.DataFrame(mixing.shard_groups(plan, 8, groups), columns=columns))
    for _, part in found.groupby("group"):
        rows += mixing._shards(part, 7).itertuples(index=False)
    for s, n in slots.items():
        mine = sorted((r.first, r.n) for r in rows if r.source == s)
        assert sum(x[1] for x in mine) == n and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:]))
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n
    assert sorted(sizes) == list(range(-(-50_003 // mixing.SHARD_BLOCKS))) and max(sizes.values()) - min(sizes.values()) <= 1 and max(sizes.values()) <= mixing.SHARD_BLOCKS


def test_draws_follow_the_shares():
    """Means of the draws are those of multinomial ones; of very many slots as of few."""
    for scale in (1, 1000, 10**7):
        left = np.array([600, 300, 100]) * scale
        found = mixing.draws(left, np.full(100, 10 * scale), np.random.default_rng(3))
        assert (found.sum(axis=0) == left).all() and (found.sum(axis=1) <= 11 * scale).all()
        assert abs(found[:50].mean(axis=0) / (10 * scale) - [0.6, 0.3, 0.1]).max() < 0.05


def tables(spark):
    docs = [(i, "hot", f"word number {i} " * 20) for i in range(300)] + [(1000 + i, "rare", "few words only here") for i in range(5)]
    docs += [(2000, None, "no source"), (2001, "hot", None), (2002, "rare", ""), (2003, "other", "not in a plan")]
    targets = [("p", "hot", 1.0, 2, 4000), ("p", "rare", 1.0, 4, 4000), ("p", "empty", 1.0, 4, 4000), ("all", "hot", 1.0, 1, None), ("over", "hot", 1.0, 3, 10**6), (None, "hot", 1.0, 1, 1)]
    documents = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, source string, text string, tokens int")
    return documents, spark.createDataFrame(targets, "plan_name string, source string, target_ratio double, max_repeats int, target_total_tokens bigint")


def test_mix(spark):
    documents, targets = tables(spark)
    m = mixing.mix(documents, targets, block=16)
    shares = {(r["plan_name"], r["source"]): r for r in m.shares().collect()}
    assert shares["p", "rare"]["capped"] and shares["p", "rare"]["most_uses"] == 4
    assert shares["p", "rare"]["tokens_drawn"] == 4 * shares["p", "rare"]["tokens_available"]
    assert abs(shares["p", "hot"]["tokens_drawn"] - 4000 / 3) <= 16
    assert shares["p", "empty"]["tokens_drawn"] == 0
    assert shares["over", "hot"]["tokens_drawn"] == 3 * shares["over", "hot"]["tokens_available"]
    assert abs(shares["all", "hot"]["tokens_drawn"] - shares["all", "hot"]["tokens_available"]) <= 16
    for plan in ("p", "all", "over"):
        assert abs(sum(r["actual_share"] for k, r in shares.items() if k[0] == plan) - 1) < 1e-9
    docs = m.documents().collect()
    assert len({(r["plan_name"], r["source"], r["doc_id"]) for r in docs}) == len(docs)
    limits = {("p", "hot"): 2, ("p", "rare"): 4, ("all", "hot"): 1, ("over", "hot"): 3}
    assert all(r["uses"] <= limits[r["plan_name"], r["source"]] for r in docs)
    assert not {2000, 2001, 2002, 2003} & {r["doc_id"] for r in docs}
    slots = m.slots().groupBy("plan_name", "shard").agg(F.count("*").alias("n"), F.max("place").alias("top")).collect()
    assert all(r["n"] == r["top"] for r in slots)
    assert sorted(map(tuple, docs)) == sorted(map(tuple, mixing.mix(documents, targets, block=16).documents().collect()))


def test_blocks_hold_the_tokens(spark):
    """Each slot has the tokens of its block: those of the source's documents in order, cut every 16."""
    documents, targets = tables(spark)
    m = mixing.mix(documents, targets, block=16)
    stream = {}
    for r in encoding.encode(documents.where("source in ('hot', 'rare')"), keep="source").orderBy("doc_id").collect():
        stream.setdefault(r["source"], []).extend(r["ids"])
    rows = m.blocks().collect()
    assert sorted((r["plan_name"], r["shard"], r["place"], r["source"], r["block"]) for r in rows) == sorted(tuple(r)[:5] for r in m.slots().collect())
    assert all(r["ids"] == stream[r["source"]][16 * r["block"] : 16 * r["block"] + 16] for r in rows) and len(rows) > 100
    drawn = {(r["plan_name"], r["source"]): r["tokens_drawn"] for r in m.shares().where("tokens_drawn > 0").collect()}
    got = {}
    for r in rows:
        got[r["plan_name"], r["source"]] = got.get((r["plan_name"], r["source"]), 0) + len(r["ids"])
    assert got == drawn


def test_empty(spark):
    documents, targets = tables(spark)
    assert mixing.mix(documents.limit(0), targets).documents().count() == 0
    assert mixing.mix(documents, targets.limit(0)).shares().count() == 0
    assert mixing.mix(documents.limit(0), targets).blocks().count() == mixing.mix(documents, targets.limit(0)).blocks().count() == 0
