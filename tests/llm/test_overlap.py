import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import folding, overlap


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


words = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 6))
def test_edit_distance(a, b, most):
    assert overlap.edit_distance(a, b, most) == min(most + 1, levenshtein(a, b))


numbers = st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(numbers, st.lists(st.integers(0, 5), min_size=1, max_size=6))
def test_backward_search(texts, pattern):
    """Rows of a pattern are those of the suffixes that start with it, wherever texts begin and end; the texts can be read back."""
    index = overlap.WordIndex([np.array(t, np.uint64) for t in texts])
    whole = [0, *(x for t in texts for x in (*t, 0))]
    symbol = {0: 0} | {w: int(index.symbols(np.array([w], np.uint64))[0]) for w in range(1, 6)}
    low, high = np.array([0]), np.array([index.n])
    for w in reversed(pattern):
        low, high = index.step(np.array([symbol[w]]), low, high)
    found = index.locate(np.arange(low[0], high[0]))
    # No text is empty, so no pattern with two separators in a row stands in the texts.
    expected = [i for i in range(len(whole) - len(pattern) + 1) if whole[i : i + len(pattern)] == pattern]
    if [0, 0] not in [pattern[i : i + 2] for i in range(len(pattern))]:
        assert sorted(found.tolist()) == expected
    at = list(range(len(texts)))[::-1]
    assert [index.vocabulary[t - 1].tolist() for t in index.texts(np.array(at))] == [texts[i] for i in at]


def test_long_texts_are_read_in_lanes():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 9, n).astype(np.uint64) for n in (1, overlap.LANE - 1, overlap.LANE, 3 * overlap.LANE + 5)]
    index = overlap.WordIndex(texts)
    assert all((index.vocabulary[a - 1] == b).all() for a, b in zip(index.texts(np.arange(4)), texts))
    size = sum(x.nbytes for x in (index.low, index.first, index.places, index.marks, index.before))
    assert size < 5 * index.n + 200


@settings(max_examples=100, deadline=None)
@given(numbers, st.lists(st.integers(1, 5), min_size=1, max_size=15), st.integers(0, 3))
def test_windows_are_as_many_as_can_be(texts, pattern, most):
    """Windows have no word in common and at most so many occurrences, and no other cut gives more of them."""
    index = overlap.WordIndex([np.array(t, np.uint64) for t in texts])
    whole = [0, *(x for t in texts for x in (*t, 0))]
    flat = index.symbols(np.array(pattern, np.uint64))
    count = lambda a, b: sum(whole[i : i + b - a] == pattern[a:b] for i in range(len(whole)))
    text, start, end, low, high = overlap.windows(index, flat, np.array([0]), np.array([len(flat)]), np.array([0]), most)
    assert (high - low).tolist() == [count(a, b) for a, b in zip(start, end)] and all(high - low <= most)
    assert all(a >= d for a, d in zip(start, end[1:]))
    best = [0] * (len(pattern) + 1)
    for b in range(1, len(pattern) + 1):
        best[b] = max([best[b - 1], *(best[a] + 1 for a in range(b) if count(a, b) <= most)])
    assert len(start) == best[-1]


def test_spans():
    a, b = np.array([1, 2, 3, 9, 5, 6, 7]), np.array([1, 2, 3, 8, 8, 5, 6, 7])
    assert overlap.spans(a, b, np.array([1, 5, 4]), np.array([2, 6, 6]), np.array([0, 1, 1])) == (6, 2)


def edited(ws, n, rng):
    out = list(ws)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(out) + 1)
        if kind == 0:
            out.insert(at, f"new{rng.randrange(1000)}")
        elif out:
            at %= len(out)
            if kind == 1:
                out[at] = f"other{rng.randrange(1000)}"
            else:
                del out[at]
    return out


def test_no_overlap_is_lost():
    """Every text meets its edited copies, whatever its length, among many texts of the same words."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    hashed = lambda ws: np.array([overlap.xxhash.xxh64_intdigest(w) for w in ws], np.uint64)
    train, evals = [], []
    for n in [*range(1, 120), 255, 256, 300, 700, 2500]:
        for _ in range(2):
            a = [rng.choice(vocabulary) for _ in range(n)]
            train.append(a)
            evals += [b for k in (0, n // 10, rng.randrange(n // 9 + 1)) if (b := edited(a, k, rng))]
    shard = overlap.Shard(list(range(len(evals))), [hashed(b) for b in evals])
    flat, n = np.concatenate([hashed(a) for a in train]), np.array([len(a) for a in train])
    found = {(i, e): (longer, covered, d) for i, e, longer, covered, _, d in shard.search(shard.index.symbols(flat), n, overlap.sketches(flat, n))}
    expected = {}
    for i, a in enumerate(train):
        for e, b in enumerate(evals):
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) <= longer // 10 and (d := overlap.edit_distance(a, b, longer // 10)) <= longer // 10:
                expected[i, e] = (longer, d)
    assert {k: (v[0], v[2]) for k, v in found.items()} == expected and len(expected) > 500
    assert all(covered <= len(train[i]) for (i, _), (_, covered, _) in found.items())
    assert all(covered == longer for longer, covered, d in found.values() if d == 0)


def test_bands():
    assert overlap.length_bands([(1, 3, 3), (2, 5, 10), (4, 9, 36), (5, 1, 5)], 15) == [(1, 0, 1), (2, 0, 1), (4, 1, 3), (5, 4, 1)]
    assert overlap.length_bands([]) == []


def fixture(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(200)]
    rows, number = [], 0
    for n in (3, 9, 10, 11, 19, 20, 27, 28, 40, 75, 120, 300):
        for _ in range(4):
            a = [rng.choice(vocabulary) for _ in range(n)]
            for split, k in (("train", 0), ("val", n // 10), ("test", n // 10 + 1), ("train", rng.randrange(n // 10 + 1))):
                number += 1
                text = " ".join(edited(a, k, rng))
                rows.append((number, rng.choice(["s", None]), split, text.upper() if number % 3 else text.replace(" ", ",\n")))
    hot = " ".join(vocabulary[:30])
    rows += [(1000 + i, "hot", "train" if i % 4 else "val", hot) for i in range(40)]
    rows += [(2000, "s", "train", None), (2001, "s", "val", None), (2002, "s", "train", " "), (2003, "s", "val", " "), (2004, "s", "train", "!!"), (2005, "s", "val", "!!"), (None, "s", "train", hot)]
    rows += [rows[0], rows[5]]
    return spark.createDataFrame([(*r, 1) for r in rows], "record_id bigint, source string, split string, text string, key int")


def brute(df):
    texts = {r["record_id"]: (r["split"], folding.words(r["text"])) for r in df.collect() if r["record_id"] is not None}
    out = set()
    for t, (s, a) in texts.items():
        for e, (q, b) in texts.items():
            if s == "train" and q != "train" and a and b and levenshtein(a, b) <= max(len(a), len(b)) // 10:
                out.add((min(t, e), max(t, e)))
    return out


def test_pairs_and_report(spark):
    df = fixture(spark)
    expected = brute(df)
    found = [tuple(r) for r in overlap.as_pairs(overlap.overlaps(df)).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    for sizes in ((200, 400), (1, 1)):
        assert {tuple(r) for r in overlap.as_pairs(overlap.overlaps(df, shard_words=sizes[0], pass_words=sizes[1] if sizes[0] > 1 else 10**6)).collect()} == expected
    rows = overlap.overlapping_texts(df)[0].collect()
    assert all(r["edits"] <= r["words"] // 10 and r["covered"] <= r["words"] and r["matches"] > 0 for r in rows)
    report = overlap.overlap_report(df).collect()
    hot = next(r for r in report if r["source"] == "hot")
    assert (hot["split"], hot["n_records"], hot["n_overlapping"], hot["share"]) == ("val", 10, 10, 1.0)


def test_classes(spark):
    df = fixture(spark)
    pairs = brute(df)
    side = {r["record_id"]: r["split"] for r in df.where("record_id is not null").collect()}
    text = {r["record_id"]: tuple(folding.words(r["text"])) for r in df.where("record_id is not null").collect()}
    rows = overlap.overlap_classes(df).collect()
    assert {r["record_id"] for r in rows} == {i for i, t in text.items() if t} and len(rows) == len({r["record_id"] for r in rows})
    for r in rows:
        same = {i for i, t in text.items() if t == text[r["record_id"]]}
        assert r["class_id"] == min(same) and (r["side"] == "train") == (side[r["record_id"]] == "train")
        copies = [text[y] for a, b in pairs for x, y in ((a, b), (b, a)) if x in same and (side[x] == "train") == (r["side"] == "train")]
        assert r["n_links"] == len(set(copies))


def test_copies_are_paired_in_full(spark):
    """Two classes with more than 10,000 pairs give all of them: 1,100 x 10 and, for a near copy, 1,100 x 2 and 3 x 10."""
    ws = [f"word{i}" for i in range(20)]
    near = [*ws[:9], "other", *ws[10:]]
    texts = [("train", ws)] * 1100 + [("val", ws)] * 10 + [("test", near)] * 2 + [("train", near)] * 3 + [("val", ws[:15])]
    rows = [(i, "s", s, " ".join(x).upper() if i % 2 else ", ".join(x)) for i, (s, x) in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id bigint, source string, split string, text string")
    expected = {(t[0], e[0]) for t in rows for e in rows if t[2] == "train" and e[2] != "train" and e[0] != len(rows) - 1}
    assert len(expected) == 1103 * 12
    for block in (overlap.BLOCK, 7):
        found = [tuple(r) for r in overlap.overlaps(df, block=block).select("train_id", "eval_id").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_shared_passage(spark):
    """A passage that all records share brings no pairs together: windows beside it are taken; the pairs stay the same."""
    rng = random.Random(8)
    passage, rows = [f"rights{i}" for i in range(25)], []
    for i in range(60):
        own = [f"word{rng.randrange(400)}" for _ in range(60)]
        rows.append((2 * i, "s", "train", " ".join(passage + own)))
        rows.append((2 * i + 1, "s", rng.choice(["val", "test"]), " ".join(edited(passage + own, rng.randrange(12), rng))))
    df = spark.createDataFrame(rows, "record_id bigint, source string, split string, text string")
    expected = brute(df)
    found = overlap.overlapping_texts(df)[0].collect()
    assert {(min(r["train_id"], r["eval_id"]), max(r["train_id"], r["eval_id"])) for r in found} == expected and len(expected) > 20
    texts = [[np.array([overlap.xxhash.xxh64_intdigest(w) for w in folding.words(r[3])], np.uint64) for r in rows if (r[2] == "train") == side] for side in (True, False)]
    shard = overlap.Shard(list(range(60)), texts[1])
    flat, n, located = np.concatenate(texts[0]), np.array([len(t) for t in texts[0]]), []
    inner = shard.index.locate
    shard.index.locate = lambda row: (located.append(len(row)), inner(row))[1]
    list(shard.search(shard.index.symbols(flat), n, overlap.sketches(flat, n)))
    assert sum(located) < 60 * 60


def test_empty(spark):
    df = fixture(spark).limit(0)
    assert overlap.overlaps(df).count() == overlap.overlap_report(df).count() == overlap.overlap_classes(df).count() == 0
    for only in ("train", "val"):
        part = fixture(spark).where(f"split = '{only}'")
        assert overlap.overlaps(part).count() == 0
