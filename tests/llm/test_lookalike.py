import itertools
import random

import pytest

from strandmill.llm import blocks, folding, lookalike

SAME = [
    ("abc", "ａｂｃ"), ("a b", "a b"), ("a b", "a b"), ("a　b", "a b"), ("no", "n​o"), ("no", "n­o﻿"), ("café", "café"),
    ("office", "oﬃce"), ("the paper", "thе рареr"), ("Tom", "Тоm"), ("x\ny", "x\r\ny"), ("й", "й"), ("ë", "ё"),
]
DIFFERENT = [("abc", "Abc"), ("cafe", "café"), ("a1", "a2"), ("a.", "a,"), ("a  b", "a b"), ("one two", "one too"), ("x2", "x²"), ("👩‍🔬", "👩🔬")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_form(a, b):
    assert folding.canonical(a) == folding.canonical(b)
    assert folding.words(a) == folding.words(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_other_form(a, b):
    assert folding.canonical(a) != folding.canonical(b)


def test_forms_are_stable():
    rng = random.Random(1)
    parts = [c for pair in SAME + DIFFERENT for x in pair for c in x] + ["\x00", "\t", "ß", "İ", "ﬀ", "ǆ", "각", "각"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        once = folding.canonical(t)
        assert folding.canonical(once) == once


def records(spark):
    rows = [(1, "abc x"), (2, "ａbc x"), (3, "abc x"), (3, "abc x"), (4, "abc x"), (5, "ABC x"), (6, None), (7, ""), (8, " ​"), (9, " "), (10, "long " * 9000), (11, "lоng " * 9000), (None, "abc x")]
    return spark.createDataFrame([(i, t, "s", b"k") for i, t in rows], "record_id bigint, text string, source string, form_key binary")


def brute(rows):
    texts = {}
    for r in rows:
        if r["record_id"] is not None and r["text"] and folding.canonical(r["text"]).strip():
            texts[r["record_id"]] = r["text"]
    return {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] != texts[b] and folding.canonical(texts[a]) == folding.canonical(texts[b])}


def test_pairs(spark):
    df = records(spark)
    found = [tuple(r) for r in lookalike.look_alike_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(df.collect()) == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (10, 11)}


def test_large_classes_keep_every_link(spark):
    found = {tuple(r) for r in lookalike.look_alike_pairs(records(spark), expand=2).collect()}
    assert found <= brute(records(spark).collect())
    linked = {1}
    for _ in range(5):
        linked |= {x for p in found if linked & set(p) for x in p}
    assert linked == {1, 2, 3, 4}


def test_large_classes_are_paired_in_full(spark):
    """A class above the default bound (here 1,108 records) has every pair of different texts, at any size of blocks."""
    kinds = [("abc x", 1001), ("ａbc x", 60), ("аbc x", 40), ("abc  x", 3), ("abc\u2003x", 7)]
    texts = [t for t, n in kinds for _ in range(n)]
    random.Random(3).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, text string")
    expected = brute(df.collect())
    assert len(expected) == 1001 * 107 + 60 * 47 + 40 * 7
    for expand in (lookalike.EXPAND, 50, 500):
        found = [tuple(r) for r in lookalike.look_alike_pairs(df, expand=expand).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_small_blocks_change_nothing(spark):
    df = records(spark)
    for expand in (1, 2, 3):
        assert {tuple(r) for r in lookalike.look_alike_pairs(df, expand=expand).collect()} == brute(df.collect())


def test_classes_and_forms(spark):
    df = records(spark)
    rows = {r["record_id"]: r for r in lookalike.look_alike_classes(df).collect()}
    assert {k: rows[k]["class_id"] for k in (1, 2, 3, 4, 5)} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert rows[1]["n_records"] == 4 and rows[1]["n_texts"] == 3 and not {6, 7, 8, 9} & rows.keys()
    forms = lookalike.canonical_forms(df).collect()
    assert len(forms) == df.count() and {r["form"] for r in forms if r["record_id"] == 2} == {"abc x"}


def test_empty(spark):
    df = records(spark).limit(0)
    assert lookalike.look_alike_pairs(df).count() == lookalike.look_alike_classes(df).count() == lookalike.canonical_forms(df).count() == 0


def test_more_look_alikes(spark):
    """Letters of other scripts by the public confusables data; what only resembles a letter stays."""
    more = lookalike.look_alikes(spark)
    table = folding.spelling(more)
    for a, b in (("ꓮ", "A"), ("Ꭺ", "A"), ("Ꮪ", "S"), ("ᴄ", "c"), ("ⲟ", "o"), ("𐐬", "o"), ("Ⲓ", "I"), ("о", "o")):
        assert folding.canonical(f"x{a}y é", table) == f"x{b}y é"
    for c in "σαγɪƍאاß":
        assert folding.canonical(c, table) == c
    assert all(len(v) == 1 and v.isascii() and v.isalpha() for v in more.values()) and len(more) > 100
    rng = random.Random(2)
    for _ in range(1000):
        t = "".join(rng.choice([*more, "́", "a", " ", "ａ"]) for _ in range(rng.randrange(6)))
        assert folding.canonical(folding.canonical(t, table), table) == folding.canonical(t, table)


def test_attach(spark):
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(k)], "k int, i int")
    groups = spark.createDataFrame([(k, k, f"v{k}") for k in range(1, 6)], "k int, n int, v string")
    expected = sorted((k, i, k, f"v{k}") for k in range(6) for i in range(k))
    for most in (1, 3, 100):
        assert sorted(tuple(r) for r in blocks.attach(rows, groups, ["k"], "n", most).collect()) == expected
