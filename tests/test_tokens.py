import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions import tokens as tk

TEXTS = ["", "abc", "€", "戦", "🙂 b", "naïve\n", None, "\U00010348x", "a\x00b", "אבג हिन्दी"]


def encoded(mode, text):
    if text is None:
        return None
    if mode == "utf8":
        return list(text.encode())
    if mode == "utf16":
        raw = text.encode("utf-16-le")
        return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]
    points = [ord(c) for c in text]
    return points if mode == "utf32" else [p for p in points if p < 128]


@pytest.mark.parametrize("mode", list(tk.MODES))
def test_modes(spark, mode):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(3)
    rows = df.select("i", tk.encode(F.col("t"), mode).alias("ids"), tk.count_tokens(F.col("t"), mode).alias("n"), tk.decode(tk.encode(F.col("t"), mode), mode).alias("back")).orderBy("i").collect()
    for r, t in zip(rows, TEXTS):
        expected = encoded(mode, t)
        assert r["ids"] == expected
        assert r["n"] == (None if t is None else len(expected))
        assert r["back"] == (t if t is None or mode != "codepoint" else "".join(c for c in t if ord(c) < 128))


def test_decoding_leaves_out_what_is_invalid(spark):
    df = spark.createDataFrame([([104, 300, 105, -1],), ([0xE2, 0x82],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in df.select(tk.decode(F.col("a"), "utf8")).collect()] == ["hi", "", "", None]
    assert [r[0] for r in spark.createDataFrame([([0xD800, 97, 0x110000],)], "a array<int>").select(tk.decode(F.col("a"), "utf32")).collect()] == ["a"]


def test_sizes_are_checked():
    assert tk.vocabulary_size("codepoint") == 128
    assert tk.vocabulary_size("utf8", 256) == 256
    for mode, size in (("utf8", 300), ("nothing", None), ("codepoint", 0)):
        with pytest.raises(ValueError):
            tk.vocabulary_size(mode, size)


UNKNOWN = [
    ([0, 1, 0, 2, 3], 0, 0.02, None), ([0] + [1] * 99, 0, 0.02, [1] * 99), ([0, 0], 0, 0.02, None), ([0] + [5] * 49, 0, 0.02, [5] * 49),
    ([0, 0] + [5] * 97, 0, 0.02, None), ([0, 1], -1, 0.02, [0, 1]), ([], 0, 0.02, []), ([0, 1, 2, 3], 0, 0.5, [1, 2, 3]),
]


@pytest.mark.parametrize(("ids", "unk", "rate", "expected"), UNKNOWN)
def test_unknown_filter(spark, ids, unk, rate, expected):
    assert spark.createDataFrame([(ids,)], "a array<int>").select(tk.filter_unknown(F.col("a"), unk, rate)).first()[0] == expected


def test_fit_window_against_plain_code(spark):
    def plain(p, c, w):
        if w <= 1:
            return p[-1:], c[:1]
        keep = max(0, w - len(c))
        return (p[len(p) - min(len(p), keep) :], c) if len(c) < w or len(p) + len(c) <= w else ([], c[-w:])

    rng = random.Random(3)
    for w in (0, 1, 2, 5, 9):
        rows = [(list(range(rng.randrange(7))), list(range(50, 50 + rng.randrange(8)))) for _ in range(30)] + [([1, 2, 3, 4], [5, 6, 7])]
        p, c = tk.fit_window(F.col("p"), F.col("c"), w)
        found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<int>, c array<int>").select("i", p.alias("a"), c.alias("b")).orderBy("i").collect()
        assert [(r["a"], r["b"]) for r in found] == [plain(*r, w) for r in rows]


def test_eos_and_truncation(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(tk.append_eos(F.col("a"), 9), tk.append_eos(F.col("a"), -1), tk.truncate(F.col("a"), 2), tk.truncate(F.col("a"), 0)).first()[:] == ([1, 2, 3, 9], [1, 2, 3], [1, 2], [1, 2, 3])


def test_registry(spark, tmp_path):
    from strandmill.functions import tokenizers as tz

    assert tz.names() == ["bpe", "char", "hf_bpe", "unigram", "utf8"]
    with pytest.raises(ValueError, match="registered"):
        tz.register("char", tz.character)
    for make in (lambda: tz.create("nothing"), lambda: tz.create("bpe"), lambda: tz.create("char", mode="utf8", vocab_size=5)):
        with pytest.raises(ValueError):
            make()
    assert tz.resolve("char", "gpt2_bpe", None, 512) == ("hf_bpe", {})
    assert tz.resolve("char", None, "codepoint", None) == ("char", {"mode": "codepoint", "vocab_size": 256})
    assert tz.configured("char", mode="utf16").name == "char_utf16"


@pytest.mark.parametrize(("kind", "file"), [("bpe", "byte_bpe_50k.tiktoken"), ("hf_bpe", "byte_bpe_50k.json"), ("unigram", "piece_bpe_32k.model")])
def test_library_vocabularies(spark, kind, file):
    import os

    from strandmill.functions import tokenizers as tz

    path = f"/opt/tokenizers/{file}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    t = tz.create(kind, path=path)
    df = spark.createDataFrame([(0, "hello world, naïve"), (1, ""), (2, None)], "i int, t string")
    rows = df.select("i", t.encode(F.col("t")).alias("ids"), t.decode(t.encode(F.col("t"))).alias("back")).orderBy("i").collect()
    assert rows[0]["back"] == "hello world, naïve" and len(rows[0]["ids"]) > 3
    assert rows[1]["ids"] == [] and rows[2]["ids"] is None


def test_every_experiment_has_its_tokenizer(spark, tmp_path):
    import itertools

    from strandmill import catalogue
    from strandmill.functions import tokenizers

    settings = list(itertools.product(["gpt2_bpe", "unigram", "char", "", None], ["bytes", "codepoint", "", None], [1, tokenizers.LEAST_RANKED - 1, tokenizers.LEAST_RANKED, None]))
    rows = [(f"e{i}", *settings[i % len(settings)]) for i in range(10_050)]
    spark.createDataFrame(rows, "experiment string, tokenizer_backend string, tokenizer_mode string, vocab_size int").write.parquet(f"{tmp_path}/experiment_config.parquet")
    found = {r[0]: (r[1], r[2]) for r in catalogue.queries()["tok_configured"](spark, str(tmp_path)).select("experiment", "tokenizer", "mode").collect()}
    assert found == {e: (name, s.get("mode")) for e, *given in rows for name, s in [tokenizers.resolve("char", *given)]}
