import base64
import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import encoding

FOLDER = encoding.TOKENIZERS
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabulary files")
PIECES = [" ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "1", "22", ".", "!!", "'s", "'ll", "\x1c", "\x85", "日本", "Ω", "🙂", "​", "é", "the", "ing", " the", "ation", "\r\n", "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoder():
    with open(os.path.join(FOLDER, encoding.BYTE_BPE_50K), "rb") as f:
        return encoding.Encoder(encoding.Tables(f.read()), kept=5000)


@pytest.fixture(scope="module")
def texts(small):
    import pandas as pd

    rng = random.Random(1)
    out = pd.read_parquet(f"{small}/documents.parquet")["text"].tolist() + [None, "", " ", "\n\n"]
    out += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    return out + ["".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randrange(1, 25))) for _ in range(3000)]


def encode(encoder, texts):
    out = []
    for i in range(0, len(texts), 500):
        flat, offsets = encoder.encode(texts[i : i + 500])
        out += [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    return out


def test_same_as_rank_library(encoder, texts):
    import tiktoken

    with open(os.path.join(FOLDER, encoding.BYTE_BPE_50K), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert encode(encoder, texts) == [other.encode_ordinary(t) if t else [] for t in texts]
    assert 0 < encoder.exact < encoder.seen


def test_same_as_merge_library(encoder, texts):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert encode(encoder, texts) == [e.ids for e in other.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def plainly(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        if (best := min(found)) == 1 << 40:
            break
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abc"), min_size=1, max_size=30), st.permutations(["aa", "ab", "bc", "ca", "aaa", "abc", "aab", "bca", "abab", "cc"]))
def test_merging(word, order):
    ranks = {t.encode(): i for i, t in enumerate(["a", "b", "c", *order])}
    assert encoding.merge_exactly(word.encode(), ranks, 4) == plainly(word.encode(), ranks)


def test_long_words(encoder):
    """A page without spaces: 100,000 characters in about a second, and nothing of it is kept."""
    import tiktoken

    rng = random.Random(7)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(100_000))
    with open(os.path.join(FOLDER, encoding.BYTE_BPE_50K), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = len(encoder.ids)
    began = time.process_time()
    found = encode(encoder, [text, "x" * 100_000])
    assert time.process_time() - began < 10 and len(encoder.ids) <= kept
    assert found[0][:2000] == other.encode_ordinary(text[:3000])[:2000]
    assert found[1] == other.encode_ordinary("x" * 100_000)


def test_tables(spark):
    rows = [(1, "some text", 0), (2, None, 0), (3, "", 0), (4, " ", 0), (1, "some text", 0), (5, "word " * 20_000, 0), (None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    found = encoding.encode(df).collect()
    assert len(found) == 7
    by = {r["doc_id"]: r["ids"] for r in found}
    assert by[2] == by[3] == [] and len(by[4]) == 1 and len(by[5]) == 20_001 and by[1]
    counts = {r["doc_id"]: r["n_tokens"] for r in encoding.token_counts(df, ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in by.items()}
    assert encoding.encode(df.limit(0)).count() == 0
