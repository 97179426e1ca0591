import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.operators import documents as dc
from strandmill.operators import evaluation as ev
from strandmill.operators import mixing, packing, sampling
from strandmill.ordinal import id_block, scan


def narrow(spark, sizes, lengths=None):
    rows = [(s, i, (lengths or {}).get(s, 10)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "source string, doc_ord bigint, n_tokens bigint")


def test_scan_ranks_and_sums_with_nulls_and_clashing_names(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(10**6) * 1000 + i, rng.choice([1, 5, None]), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint, _block string")
    found = scan(df, ["g"], id_block("o", 100_000_000), ["o"], "rank", {"run": "v"}, "n").collect()
    assert len(found) == 500
    for g in ("a", "b", None):
        mine = sorted((r["o"], r["rank"], r["run"], r["n"]) for r in found if r["g"] == g)
        total = 0
        for i, (o, rank, run, n) in enumerate(mine):
            total += next(r[2] for r in rows if r[1] == o) or 0
            assert (rank, run, n) == (i + 1, total, len(mine))
    assert scan(df.limit(0), ["g"], F.col("o"), ["o"]).count() == 0


def test_delimited_text(spark):
    df = spark.createDataFrame([(1, "a doc\r\n\r\nsecond doc\n\n \n\nthird doc"), (2, ""), (3, "no.*end")], "doc_ord bigint, text string")
    assert [r["text"] for r in dc.segment(df, "\n\n").orderBy("doc_ord", "piece").collect()] == ["a doc", "second doc", "third doc", "no.*end"]
    assert [r["text"] for r in dc.segment(df, ".*").where("doc_ord = 3").orderBy("piece").collect()] == ["no", "end"]


def test_caps_are_prefixes(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 1, 6), ("a", 2, 1), ("b", 0, 9), ("b", 1, 1)], "source string, doc_ord bigint, n_tokens bigint")
    assert sorted((r["source"], r["doc_ord"]) for r in dc.source_caps(df, None, 8).collect()) == [("a", 0)]
    assert sorted((r["source"], r["doc_ord"]) for r in dc.source_caps(df, 1, None).collect()) == [("a", 0), ("b", 0)]


def test_token_targets(spark):
    even = narrow(spark, {"a": 300, "b": 300})
    wanted = mixing.targets(even, {"a": 0.2, "b": 0.8}, total_tokens=1000)
    drawn = mixing.sample(even, wanted, 42).groupBy("source").agg(F.sum("n_tokens").alias("n"))
    assert dict(tuple(r) for r in drawn.collect()) == {"a": 200, "b": 800}
    uneven = narrow(spark, {"a": 300, "b": 300}, {"a": 10, "b": 100})
    wanted = mixing.targets(uneven, {"a": 0.25, "b": 0.75}, total_tokens=2000)
    drawn = mixing.sample(uneven, wanted, 42).groupBy("source").agg(F.sum("n_tokens").alias("n"))
    assert dict(tuple(r) for r in drawn.collect()) == {"a": 500, "b": 1500}


def test_sampling_sizes(spark):
    df = narrow(spark, {"a": 20, "b": 5, "c": 7})
    wanted = spark.createDataFrame([("a", 20, 8), ("b", 5, 12), ("c", 7, 7)], "source string, n_docs bigint, target bigint")
    rows = mixing.sample(df, wanted, 1).collect()
    by = {s: [r for r in rows if r["source"] == s] for s in "abc"}
    assert {s: len(r) for s, r in by.items()} == {"a": 8, "b": 12, "c": 7}
    assert len({r["doc_ord"] for r in by["a"]}) == 8
    assert sorted(r["draw"] for r in by["b"]) == list(range(12))
    assert [r["doc_ord"] for r in sorted(by["c"], key=lambda r: r["draw"])] == list(range(7))


def test_ratios():
    assert mixing.derive_ratios({"a": 1.0, "b": 1.0}, None) is None
    assert mixing.derive_ratios({"a": 1.0, "b": 3.0}, None) == {"a": 1.0, "b": 3.0}
    assert mixing.derive_ratios({"a": 1.0, "b": 1.0}, None, "tokens") == {"a": 1.0, "b": 1.0}
    assert mixing.derive_ratios({"a": 1.0}, {"b": 2.0}) == {"b": 2.0}
    with pytest.raises(ValueError):
        mixing.normalized_ratios({"a": 0.0})


@pytest.mark.parametrize("block", [1, 2, 5])
def test_interleaving_is_round_robin(spark, block):
    df = narrow(spark, {"a": 7, "b": 3, "c": 1}).withColumn("draw", F.col("doc_ord"))
    rows = mixing.interleave(mixing.with_source_order(df), 42, block).orderBy("mix_ord").collect()
    left, expected = {"a": 7, "b": 3, "c": 1}, []
    while any(left.values()):
        for s in "abc":
            n = min(block, left[s])
            expected += [s] * n
            left[s] -= n
    assert [r["source"] for r in rows] == expected
    assert [r["mix_ord"] for r in rows] == list(range(11))


@pytest.mark.parametrize("cut", [mixing.split_stratified, mixing.split_simple])
def test_splits_are_partitions(spark, cut):
    df = narrow(spark, {"a": 100, "b": 33})
    rows = cut(df, 42, 0.29, 0.5).collect()
    assert len({(r["source"], r["doc_ord"]) for r in rows}) == 133
    if cut is mixing.split_stratified:
        a = [r["split"] for r in rows if r["source"] == "a"]
        assert (a.count("train"), a.count("val"), a.count("test")) == (int(100 * 0.29), int(100 * (0.29 + 0.5)) - int(100 * 0.29), 100 - int(100 * (0.29 + 0.5)))


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 25), st.integers(0, 25))
def test_shard_fold(sizes, size, filled):
    buf, shard, expected = filled, 0, []
    for n in sizes:
        if buf and (buf >= size or buf + n > size):
            shard, buf = shard + 1, 0
        buf += n
        expected.append(shard)
    opens, _, left = packing.fill_shards(np.array(sizes, np.int64), size, filled)
    assert np.cumsum(opens).tolist() == expected
    assert left == buf


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 25))
def test_range_tables(sizes, size):
    """The table of a range gives what the fold gives, for every fill before it."""
    sizes = np.array(sizes, np.int64)
    bounds, opened, fill = packing.range_table(sizes, size)
    for before in range(1, 40):
        k = int(np.searchsorted(bounds, max(0, size - before), side="left"))
        found = (int(opened[k]), int(fill[k])) if k < len(bounds) else (0, before + int(sizes.sum()))
        assert found == packing.fill_shards(sizes, size, before)[1:]


def test_shards_of_ranges(spark):
    """The same shards whether a split is one range or many."""
    rng = random.Random(4)
    rows = [(g, 3 * i, rng.choice([0, 1, 5, 9, 30])) for g in ("a", "b", None) for i in range(400)]
    df = spark.createDataFrame(rows, "split string, mix_ord bigint, n_tokens bigint")
    expected = {}
    for g in ("a", "b", None):
        shard, filled = 0, 0
        for x, o, n in rows:
            if x == g:
                if filled and (filled >= 20 or filled + n > 20):
                    shard, filled = shard + 1, 0
                filled += n
                expected[g, o] = shard
    for docs in (None, 7, 100):
        assert {(r["split"], r["mix_ord"]): r["shard"] for r in packing.assign_shards(df, 20, range_docs=docs).collect()} == expected


def test_windows_put_the_stream_together(spark):
    rng, rows, at = random.Random(5), [], 0
    for i in range(60):
        n = rng.choice([0, 1, 3, 17, 40])
        rows.append(("s", i * 1000, list(range(at, at + n)), n))
        at += n
    df = spark.createDataFrame(rows, "source string, doc_ord bigint, tokens array<int>, n_tokens bigint")
    for offset in (0, 4):
        found = packing.windows(df, 8, ["source"], "doc_ord", offset).orderBy("window_id").collect()
        assert len(found) == (at - offset) // 9
        for r in found:
            a = r["window_id"] * 9 + offset
            assert (r["x"], r["y"]) == (list(range(a, a + 8)), list(range(a + 1, a + 9)))


def test_early_stopping(spark):
    series = {"a": [5.0, 4.0, 4.0, 3.95, 4.2, 1.0], "b": [1.0, 0.5], "c": [2.0, 2.0, 2.0, 2.0]}
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    found = {r["run"]: tuple(r)[1:] for r in ev.early_stopping(spark.createDataFrame(rows, "run string, step bigint, v double"), "run", "step", "v", 3, 0.1).collect()}
    assert found == {"a": (4.0, 4, 2), "b": (0.5, None, 2), "c": (2.0, 3, 1)}


def test_items(spark):
    hella = spark.createDataFrame([(0, "A", "b", ["x", "y"], "1", "7"), (1, "", "", ["x", "y"], "0", None), (2, "A", None, ["x"], "0", None), (3, "A", None, ["x", "y"], "bad", None), (4, "A", "", ["x", "y"], "2", None)], "n int, ctx_a string, ctx_b string, endings array<string>, label string, ind string")
    assert [(r["prompt"], r["answer_index"], r["example_id"]) for r in ev.hellaswag_items(hella, "n").collect()] == [("A b", 1, "7")]
    piqa = spark.createDataFrame([(0, " g ", "s", "t", 1, "a"), (1, "g", "", "t", 0, None), (2, "g", "s", "t", 2, None)], "n int, goal string, sol1 string, sol2 string, label int, id string")
    assert [(r["prompt"], r["choices"], r["answer_index"]) for r in ev.piqa_items(piqa, "n").collect()] == [("Question: g\nAnswer:", ["s", "t"], 1)]
    with pytest.raises(ValueError):
        ev.piqa_items(piqa, "n", "test")
    arc = spark.createDataFrame([(0, "q", (["x", "y"], ["A", "B"]), "B", "a"), (1, "q", (["x", "y"], ["A", "B"]), "2", "b"), (2, "q", (["x", "y"], ["1", "2"]), "2", "c"), (3, "q", (["x", "y"], ["A", "B"]), "E", "d"), (4, "", (["x", "y"], ["A", "B"]), "A", "e")], "n int, question string, choices struct<text:array<string>,label:array<string>>, answerKey string, id string")
    assert [(r["example_id"], r["answer_index"]) for r in ev.arc_items(arc, "n").orderBy("n").collect()] == [("a", 1), ("b", 1), ("c", 1)]


def test_parallel_pairs(spark):
    rows = [("e", {"es": "hola", "en": "hello"}, {"es": "adiós", "en": " "}), ("n", {"es": "uno"}, {"es": "dos", "en": "two"})]
    df = spark.createDataFrame(rows, "label string, premise map<string,string>, hypothesis map<string,string>")
    assert sorted(tuple(r) for r in ev.parallel_pairs(df, "es", "en").collect()) == [("e", "hola", "hello", "premise"), ("n", "dos", "two", "hypothesis")]


def test_sampling_ties(spark):
    rows = sampling.logits(spark.createDataFrame([(0, [1.0, 3.0, 3.0, 2.0])], "k bigint, v array<double>"), "k", "v")
    assert sampling.greedy(rows, "k").first()["token"] == 1
    assert sorted(r["token"] for r in sampling.top_k(rows, "k", 1).collect()) == [1, 2]
    assert sorted(r["token"] for r in sampling.top_p(rows, "k", 0.5).collect()) == [1, 2]
    context = spark.createDataFrame([(0, [3, 1, 1])], "k bigint, context array<int>")
    assert [r["logit"] for r in sampling.penalize(rows, context, "k", 2.0, 2).orderBy("token").collect()] == [1.0, 1.5, 3.0, 2.0]


def test_checkpoint_average(spark):
    losses = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0)], "checkpoint string, loss double")
    weights = ev.checkpoint_weights(losses)
    w = {r["checkpoint"]: r["weight"] for r in weights.collect()}
    assert abs(sum(w.values()) - 1) < 1e-12 and w["a"] == w["b"] > w["c"]
    values = spark.createDataFrame([("a", "p", [0.0, 2.0]), ("b", "p", [2.0, 4.0]), ("c", "p", [1.0, 3.0])], "checkpoint string, param string, values array<double>")
    assert [round(r["value"], 9) for r in ev.average_checkpoints(values, weights).orderBy("pos").collect()] == [1.0, 3.0]


def test_weighted_stages(spark):
    df = narrow(spark, {"a": 30, "b": 30}).withColumn("mix_ord", F.col("doc_ord") * 2 + F.when(F.col("source") == "b", 0).otherwise(1))
    stages = [{"name": "x", "source_weights": {"a": 3.0, "b": 1.0}}, {"name": "y", "num_docs": 5}, {"name": "z", "fraction": 0.0, "sources": ["a"]}]
    rows = mixing.by_rules(df, stages, "mix_ord").collect()
    x = sorted((r["mix_ord"], r["source"]) for r in rows if r["stage"] == "x")
    assert [s for _, s in x] == ["b"] * 15 + ["a"] * 45 and [m for m, _ in x] == list(range(60))
    assert [len([r for r in rows if r["stage"] == s]) for s in "yz"] == [5, 30]


def test_whole_number_parameters(spark):
    rows = [("a", 0, [1.0, 3.0], False), ("b", 0, [3.0, 5.0], False), ("a", 1, [7.0], True), ("b", 1, [9.0], True)]
    parameters = spark.createDataFrame(rows, "checkpoint string, param int, values array<double>, integral boolean")
    weights = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "checkpoint string, weight double")
    found = {(r["param"], r["pos"]): r["value"] for r in ev.average_checkpoints(parameters, weights).collect()}
    assert found == {(0, 0): 1.5, (0, 1): 3.5, (1, 0): 7.0}
    assert ev.average_checkpoints(parameters.drop("integral"), weights).where("param = 1").first()["value"] == 7.5


def test_pairs_file_and_kept_examples(spark, tmp_path):
    pairs = spark.createDataFrame([("uno\tdos", 'one "two"', 1, "premise"), ("", "x\ny", 0, "hypothesis")], "es string, en string, label int, kind string").coalesce(1)
    ev.write_pairs(pairs, str(tmp_path / "pairs"), ["es", "en", "label", "kind"])
    text = next((tmp_path / "pairs").glob("*.csv")).read_text()
    assert text == 'es\ten\tlabel\tkind\nuno dos\tone "two"\t1\tpremise\n\tx y\t0\thypothesis\n'
    made = []
    make = lambda: (made.append(1), spark.range(3).toDF("item_id"))[1]
    for _ in range(2):
        assert ev.kept_examples(spark, make, str(tmp_path), "piqa", "validation", 3).count() == 3
    assert len(made) == 1 and (tmp_path / "piqa__validation__3").is_dir()
    assert ev.kept_examples(spark, make, None, "piqa", "validation", None).count() == 3


def test_batches(spark):
    df = spark.createDataFrame([(g, i) for g in ("train", "val") for i in range(10)], "split string, window_id bigint")
    rows = packing.batches(df, 4, group=["split"]).where("split = 'val'").orderBy("window_id").collect()
    assert [(r["batch_id"], r["place"]) for r in rows] == [(i // 4, i % 4) for i in range(10)]
    mixed = packing.batches(df, 4, 7, group=["split"], drop_last=True).collect()
    assert len(mixed) == 16 and {(r["split"], r["batch_id"], r["place"]) for r in mixed} == {(g, b, p) for g in ("train", "val") for b in range(2) for p in range(4)}
