import json
import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmill import config as cf
from strandmill.plans import pipeline
from strandmill.sources import npy, readers, reports, paths
from strandmill.streaming import tail


def texts(df, column="text"):
    return [r[column] for r in df.orderBy("doc_ord").collect()]


def test_text_files(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"third\r\n\r\nfourth \xff\n\n\n")
    (tmp_path / "a.txt").write_text("first\n\n  \n\nsecond line\nsame")
    (tmp_path / "c.md").write_text("no")
    assert texts(readers.read_text(spark, str(tmp_path))) == ["first", "second line\nsame", "third", "fourth"]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"text": "one"}\n{"other": 1}\n{"text": ""}\n{"text": "two"}\n')
    assert texts(readers.read_jsonl(spark, str(path))) == ["one", "two"]
    path.write_text('{"text": "one"}\nbroken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(path)).collect()


def test_parquet_reads_one_column(spark, tmp_path):
    pd.DataFrame({"text": ["alpha", None, "", "beta"], "extra": [1, 2, 3, 4]}).to_parquet(tmp_path / "x.parquet")
    df = readers.read_parquet(spark, str(tmp_path))
    assert texts(df) == ["alpha", "beta"]
    assert "extra:" not in df._jdf.queryExecution().executedPlan().toString()
    assert texts(readers.read_parquet(spark, "hf://n/d", resolve=lambda p: str(tmp_path))) == ["alpha", "beta"]
    with pytest.raises(ValueError, match="resolver"):
        readers.read_parquet(spark, "hf://n/d")


def test_remote_paths():
    assert readers.parse_remote("hf://n/d") == {"dataset": "n/d", "config": None, "split": "train"}
    assert readers.parse_remote("hf://n/d/c/val") == {"dataset": "n/d", "config": "c", "split": "val"}
    with pytest.raises(ValueError):
        readers.parse_remote("hf://n")


def test_npy(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.array([1, 0, 2, 0, 3, 0, 0, 9], np.uint16))
    rows = readers.read_npy_documents(spark, str(tmp_path / "t.npy"), 5)
    assert texts(rows, "tokens") == [[1, 2, 3], [9]]
    assert texts(readers.read_npy_documents(spark, str(tmp_path / "t.npy"), 0, 100), "tokens") == [[1, 2, 3, 9]]
    np.save(tmp_path / "n.npy", np.array([1, -1], np.int32))
    with pytest.raises(Exception, match="not negative"):
        readers.read_npy_documents(spark, str(tmp_path / "n.npy")).collect()
    np.save(tmp_path / "b.npy", np.frombuffer("café ok".encode(), np.uint8))
    assert texts(readers.read_byte_text(spark, str(tmp_path / "b.npy"))) == ["café ok"]
    assert texts(readers.read_byte_text(spark, str(tmp_path / "b.npy"), 4)) == ["caf", " ok"]


def test_npy_sink(spark, tmp_path):
    rows = [("train", 0, 1, [1, 2]), ("train", 0, 0, [70_000]), ("train", 1, 2, [3]), ("val", 0, 3, [])]
    df = spark.createDataFrame(rows, "output string, shard bigint, o bigint, tokens array<int>")
    files = {r["file"]: r["n_tokens"] for r in npy.write_npy(df, str(tmp_path / "out"), ["output", "shard"], ["o"], "p").collect()}
    assert files == {"p_train_00000.npy": 3, "p_train_00001.npy": 1, "p_val_00000.npy": 0}
    first = np.load(tmp_path / "out" / "p_train_00000.npy", mmap_mode="r")
    assert first.tolist() == [70_000, 1, 2] and first.dtype == np.uint32
    assert np.load(tmp_path / "out" / "p_train_00001.npy").dtype == np.uint16


def test_shards_beyond_five_digits(spark, tmp_path):
    """Shards 10,000, 100,000 and 100,001 are three files."""
    rows = [("train", n, 0, [n % 1000]) for n in (10_000, 100_000, 100_001)]
    df = spark.createDataFrame(rows, "output string, shard bigint, o bigint, tokens array<int>")
    files = {r["file"]: r["n_tokens"] for r in npy.write_npy(df, str(tmp_path), ["output", "shard"], ["o"], "p").collect()}
    assert files == {"p_train_10000.npy": 1, "p_train_100000.npy": 1, "p_train_100001.npy": 1}
    assert sorted(f.name for f in tmp_path.iterdir()) == sorted(files)


def test_one_file_by_many_tasks(spark, tmp_path):
    rows = [(g, i, list(range(i, i + i % 7))) for g in ("train", "val") for i in range(200)] + [("val", 500, [70_000]), ("test", 1, [])]
    df = spark.createDataFrame(rows, "output string, o bigint, tokens array<int>").repartition(5)
    found = dict(npy.write_streams(df, str(tmp_path), "output", "o", "p", span=50))
    for g, kind in (("train", np.uint16), ("val", np.uint32), ("test", np.uint16)):
        expected = [t for x, _, ts in rows if x == g for t in ts]
        array = np.load(tmp_path / f"p_{g}.npy", mmap_mode="r")
        assert array.tolist() == expected and array.dtype == kind and found[f"p_{g}.npy"] == len(expected)
    assert len(list(tmp_path.iterdir())) == 3


def test_formats():
    with pytest.raises(ValueError, match="unknown format"):
        readers.reader("csv")


def test_braces(spark):
    assert readers.expand_braces("a{00..03}b") == ["a00b", "a01b", "a02b", "a03b"]
    assert readers.expand_braces("{x,y}{2..1}") == ["x2", "x1", "y2", "y1"]
    assert readers.expand_braces("{-1..1}") == ["-1", "0", "1"]
    df = spark.createDataFrame([(f"d/{s}-{i:02d}.txt",) for s in ("train", "test") for i in range(5)], "path string")
    assert sorted(r[0] for r in readers.select_paths(df, ["d/train-{01..03}.txt"], ["*02*"]).collect()) == ["d/train-01.txt", "d/train-03.txt"]


def test_locate(spark, tmp_path):
    for p in ("TinyStories/a.arrow", "tinystories-gpt4-clean/train.txt", ".git/tinystories.txt", "x/y/z/tinystories.txt", "other.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    found = [(r["path"].removeprefix(str(tmp_path) + "/"), r["score"]) for r in readers.locate(spark, [str(tmp_path)], 2).collect()]
    assert found == [("tinystories-gpt4-clean/train.txt", 125), ("TinyStories/a.arrow", -10)]


def test_reports(spark, tmp_path):
    (tmp_path / "loss_curve.csv").write_text("step,loss,perplexity,lr,grad_norm,tokens_per_sec,gpu_memory_mb,val_loss,test_loss\n1,2.0,7.4,0.1,1,10,5,,\n2,x,3,0.1,1,10,5,1.5,\n")
    last = reports.latest_metrics(reports.read_curves(spark, str(tmp_path / "loss_curve.csv"))).first()
    assert (last["step"], last["loss"], last["val_loss"]) == (2, None, 1.5)
    (tmp_path / "s1.json").write_text(json.dumps({"step": 5, "max_steps": 9, "done": False, "val_loss": None}, indent=1))
    (tmp_path / "s2.json").write_text("{broken")
    assert [r["step"] for r in reports.read_status(spark, str(tmp_path / "s*.json")).collect()] == [5]
    sizes = spark.createDataFrame([(1023,), (2047,), (5 * 1024**2,), (3 * 1024**5,)], "n bigint")
    assert [r[0] for r in sizes.select(reports.size_text(F.col("n"))).collect()] == ["1023.0 B", "1.0 KB", "5.0 MB", "3.0 PB"]
    assert [reports.parse_bytes(x) for x in ("1MT", "250kt", "100T", "2K", "7")] == [4_000_000, 1_000_000, 400, 2048, 7]
    assert [reports.parse_tokens(x) for x in ("2K", "5T", "1.5M")] == [2000, 5, 1_500_000]
    for f, x in ((reports.parse_bytes, "tenMT"), (reports.parse_tokens, "1MT")):
        with pytest.raises(ValueError):
            f(x)


def settings(tmp_path, **changes):
    (tmp_path / "a.txt").write_text("\n\n".join(f"document {i} of the first source" for i in range(12)))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"text": f"line {i}"}) for i in range(6)))
    np.save(tmp_path / "c.npy", np.arange(1, 31, dtype=np.uint16))
    raw = {
        "tokenizer": {"type": "char", "vocab_size": 256},
        "datasets": [
            {"name": "a", "path": str(tmp_path / "a.txt"), "min_length": 1},
            {"name": "b", "path": str(tmp_path / "b.jsonl"), "format": "jsonl", "min_length": 1},
            {"name": "c", "path": str(tmp_path / "c.npy"), "format": "npy", "chunk_size": 10, "min_length": 1},
            {"name": "off", "path": str(tmp_path / "a.txt"), "weight": 0.0},
        ],
        "splits": {"train": 0.5, "val": 0.25, "test": 0.25},
        "output": {"dir": str(tmp_path / "out"), "eos_token_id": 1},
    }
    for k, v in changes.items():
        raw.setdefault(k, {})
        raw[k] = raw[k] | v
    return cf.parse(raw)


@pytest.mark.parametrize(
    "changes",
    [
        {}, {"output": {"shard_size_tokens": 60, "eos_token_id": 1}}, {"splits": {"stratified": False}}, {"curriculum": {"enabled": True, "num_stages": 2, "output_mode": "both"}},
        {"curriculum": {"enabled": True, "type": "domain_progression"}}, {"curriculum": {"enabled": True, "type": "custom", "stages": [{"name": "all"}]}}, {"mixing": {"downsample_to_min": True}},
    ],
)
def test_pipeline(spark, tmp_path, changes):
    config = settings(tmp_path, **changes)
    manifest = pipeline.run(spark, config)
    out = tmp_path / "out"
    stats = json.loads((out / "prepared_stats.json").read_text())
    assert json.loads((out / "prepared_manifest.json").read_text())["output_shards"] == manifest["output_shards"]
    for name, files in manifest["output_shards"].items():
        tokens = np.concatenate([np.load(f) for f in files])
        eos = stats[name]["num_docs"] if config.output.eos_token_id >= 0 else 0
        assert len(tokens) == stats[name]["total_tokens"] + eos
    if not changes:
        assert {k: v["num_docs"] for k, v in stats.items()} == {"train": 10, "val": 5, "test": 6}
        assert set(stats["train"]["sources"]) == {"a", "b", "c"}
    if config.mixing.downsample_to_min:
        assert sum(s["num_docs"] for s in stats.values()) == 9


def test_stage_cache(spark, tmp_path):
    config = settings(tmp_path)
    pipeline.plan(spark, config, str(tmp_path / "cache"))
    report = reports.cache_report(spark, str(tmp_path / "cache")).collect()
    assert len(report) == 3 and all(r["complete"] for r in report)
    made = pipeline.plan(spark, config, str(tmp_path / "cache"))
    assert made.documents.count() == 21


@pytest.mark.parametrize(
    "change",
    [
        lambda c: setattr(c, "datasets", []), lambda c: setattr(c.splits, "train", 0.9), lambda c: setattr(c.datasets[0], "weight", -1.0),
        lambda c: (setattr(c.mixing, "upsample_to_max", True), setattr(c.mixing, "downsample_to_min", True)),
        lambda c: (setattr(c.mixing, "target_total_docs", 1), setattr(c.mixing, "target_total_tokens", 1)),
        lambda c: setattr(c.datasets[0], "max_docs", 0), lambda c: setattr(c.mixing, "weight_by", "tokens"), lambda c: setattr(c.output, "shard_size_tokens", -1),
        lambda c: setattr(c.datasets[0], "path", "/nowhere"), lambda c: setattr(c.mixing, "weight_by", "bytes"), lambda c: [setattr(s, "weight", 0.0) for s in c.datasets],
    ],
)
def test_config_checks(tmp_path, change):
    config = settings(tmp_path)
    cf.check(config)
    change(config)
    with pytest.raises(cf.ConfigError):
        cf.check(config)


def test_config_files(tmp_path):
    (tmp_path / "c.toml").write_text('[splits]\ntrain = 0.8\nval = 0.2\n[[datasets]]\nname = "a"\npath = "hf://n/d"\n')
    config = cf.check(cf.load(tmp_path / "c.toml"))
    assert (config.splits.train, config.datasets[0].delimiter, config.mixing.seed) == (0.8, "\n\n", 42)
    (tmp_path / "c.json").write_text('{"datasets": [{"name": "a", "path": "x", "nothing": 1}]}')
    with pytest.raises(cf.ConfigError, match="unknown fields nothing"):
        cf.load(tmp_path / "c.json")
    with pytest.raises(cf.ConfigError):
        cf.load(tmp_path / "c.yaml")
    assert cf.fingerprint(SimpleNamespace(a=1)) != cf.fingerprint(SimpleNamespace(a=2))


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"phase": "read", "event": "e", "timestamp": f"2024-01-01T00:{m:02d}:00", "rss_mb": m, "value": 1.0} for m in (0, 1, 6, 59)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    events = tail.follow(spark, str(tmp_path / "in"))
    for name, df in (("w", tail.windowed(events)), ("s", tail.sessions(events, "20 minutes"))):
        q = df.writeStream.outputMode("append" if name == "w" else "append").format("memory").queryName(f"tail_{name}").option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["n"] for r in spark.table("tail_w").collect()) == [1, 2]
    assert [r["n"] for r in spark.table("tail_s").collect()] == [3]


def test_subset_chain(spark, tmp_path):
    from strandmill.functions import tokenizers
    from strandmill.plans import subsets

    path = tmp_path / "w.txt"
    path.write_text(" = One = \n\nfirst @-@ part\n = Two = \nsecond\n = Three = \nthird é")
    lines = subsets.file_lines(spark, str(path)).orderBy("line_no").collect()
    assert sum(r["n_bytes"] for r in lines) == path.stat().st_size and [r["line_no"] for r in lines] == list(range(7))
    kept = subsets.extract_text(spark, str(path), "28", "wikitext").orderBy("line_no").collect()
    assert [r["line"] for r in kept] == [" = One = ", "", "first @-@ part", " = Two = ", "second"]
    assert subsets.extract_text(spark, str(path), "1", "wikitext").count() == 3
    assert [r["line"] for r in subsets.extract_text(spark, str(path), "10").orderBy("line_no").collect()] == [" = One = "]
    cleaned = {r["segment"]: r["text"] for r in subsets.clean_file(spark, str(path)).collect()}
    assert cleaned[1] == "= One =\n\nfirst-part"
    made = subsets.tokenize_file(spark, str(path), tokenizers.create("utf8"), str(tmp_path / "out"), "w_tokens").collect()
    assert [tuple(r) for r in made] == [("w_tokens.npy", path.stat().st_size)]
    assert bytes(np.load(tmp_path / "out" / "w_tokens.npy").astype(np.uint8)) == path.read_bytes()
    short = subsets.extract_token_file(spark, str(tmp_path / "out" / "w_tokens.npy"), "10", str(tmp_path / "out"), "w_short").collect()
    assert [r["n_tokens"] for r in short] == [10]
    assert np.load(tmp_path / "out" / "w_short.npy").tolist() == list(path.read_bytes()[:10])


def test_text_with_wide_line_ends(spark, tmp_path):
    """Files with line ends of two characters are cut by the scan as well; both kinds may lie in one folder."""
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\r\n\r\nthree\r\n\r\n\r\nfour")
    (tmp_path / "b.txt").write_bytes(b"five\n\nsix\r\n\r\nseven")
    rows = [r["text"] for r in readers.read_text(spark, str(tmp_path)).orderBy("doc_ord").collect()]
    assert rows == ["one\ntwo", "three", "four", "five", "six", "seven"]
    assert spark.read.option("lineSep", "\r\n\r\n").text(str(tmp_path / "a.txt")).count() == 3


def test_paths(spark, tmp_path):
    where = f"file://{tmp_path}/x/a.txt"
    paths.make_folder(spark, f"file://{tmp_path}/x")
    paths.write(spark, where, b"abcdef")
    assert paths.exists(spark, where) and paths.size(spark, where) == 6 and paths.head(spark, where, 3) == b"abc"
    assert [p.rpartition("/")[2] for p in paths.listing(spark, f"{tmp_path}/x", ".txt")] == ["a.txt"]
    paths.remove(spark, f"file://{tmp_path}/x")
    assert not paths.exists(spark, where)


def test_status_report(spark, tmp_path):
    for i, name in enumerate(("old", "new")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"step": 5, "max_steps": 20, "done": bool(i), "val_loss": None}))
        os.utime(tmp_path / f"{name}.json", (1_000_000 + i, 1_000_000 + i))
    (tmp_path / "curve.csv").write_text("step,loss,perplexity,lr,grad_norm,tokens_per_sec,gpu_memory_mb,val_loss,test_loss\n1,2.0,7.4,0.1,1,10,5,,\n")
    (tmp_path / "cache" / "a").mkdir(parents=True)
    totals = reports.token_totals(spark.createDataFrame([("a", 1_500_000), ("a", 500_000)], "source string, n_tokens bigint"))
    curves = reports.latest_metrics(reports.read_curves(spark, str(tmp_path / "curve.csv")))
    rows = reports.status_report(reports.cache_report(spark, str(tmp_path / "cache")), totals, curves, reports.read_status(spark, str(tmp_path / "*.json"))).collect()
    found = {(r["section"], r["place"]): (r["name"].rpartition("/")[2], r["detail"]) for r in rows}
    assert found["caches", 1] == ("a", "incomplete, 0.0 B") and found["sets", 1] == ("a", "2.0 M tokens, 2 documents")
    assert found["runs", 1][0] == "new.json" and json.loads(found["runs", 2][1])["percent"] == 25.0
    assert json.loads(found["curves", 1][1])["loss"] == 2.0 and len(found) == 5
