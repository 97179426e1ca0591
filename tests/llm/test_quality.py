import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import quality

COMMON = {"en": {"the", "a", "and", "of", "to", "was", "in", "it", "is", "that"}, "de": {"der", "die", "und", "das", "ist", "nicht", "ein", "in"}}
PROSE = [
    "The old mill was repaired in the spring. It is said that the owner was happy.",
    "The wagon\nstood in the yard and\nit was late.\n\nA dog barked in the night, and the child was awake.",
    "HEADING\n\nThe report is short and to the point. It was written in a day.\n\n- one\n- two",
    '"It is late," said Tom. "The shop is closed."',
    "Die Mühle ist alt und der Müller ist nicht da. Das ist ein Problem.",
    "Ｔｈｅ　ｏｌｄ　ｍｉｌｌ　ｗａｓ　ｒｅｐａｉｒｅｄ　ｉｎ　ｔｈｅ　ｓｐｒｉｎｇ．",
    "Старая мельница была починена весной. Хозяин был очень доволен.",
]
JUNK = [
    "- apple\n- pear\n- plum\n- fig\n- nut", "1. apple.\n2. pear tree.\n3. plum.\n4. fig.", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "seed = 3\nrate = 0.1\nmode = true\nname = x",
    "[12:00:01] step=3 loss=1.2\n[12:00:02] step=4 loss=1.1", "<div class=\"a1\"></div>\n<p class=\"b2\"></p>", "bohu zale kimu. dapu reto wexu nima. pola vigu hane.",
    "41ffde641afe3439 e166f065ae1f3001 57527710b946b503", "½ €¡Ââ¾¾Ð€¼ ¾¡ÃÅ©½©Å Å¼ ¾¾", "The mill was old.\n\n" + "data/run/train_1.npy\n" * 20, "Checkpoint ..... 50\nManifest ..... 20\nStage ..... 7",
]


STATES = ("table", "list", "junk")


@pytest.fixture(scope="module")
def common():
    return quality.CommonWords(COMMON)


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws] + [(None, "x"), ("en", None)], "lang string, word string")


def values(text, common):
    found = quality.statistics(["other text, 1.\n- x", quality._plain(text), "the end"], common)
    return {k: v[1] for k, v in found.items()}


def test_values(common):
    found = values("The cat is 12.\nxy zz\n", common)
    assert (found["language"], found["n_words"], found["n_lines"]) == ("en", 5, 2)
    assert found["common_share"] == 0.4 and found["punctuated_lines"] == 0.5
    assert abs(found["digit_ratio"] - 2 / 15) < 1e-9 and found["mean_word_length"] == 12 / 5 and found["longest_token"] == np.log2(3)
    assert found["words_per_sentence"] == np.log2(6) and found["words_per_line"] == 2.5
    assert values("12 34", common)["language"] == "und"
    assert values("- a\n 12. b\n3) c\nd", common)["item_lines"] == 0.75
    assert values("a,b,c\n1;2;3\na | b | c\none, two, three", common)["cell_lines"] == 0.75
    assert np.isnan(values("Старая мельница.", common)["common_share"]) and values("щит the mill", common)["common_share"] == 1 / 3
    assert values("x<|endoftext|>the end", common)["longest_token"] == np.log2(3)


def plainly(text, common):
    """The same by plain code, a text at a time."""
    text = quality._plain(text).lower()
    words = re.findall(r"(?<![^\W])[^\W\d_]+(?![^\W])", text)
    lines = [x for x in text.split("\n") if x.strip()]
    tokens = text.split()
    solid = sum(map(len, tokens))
    per = {k: sum(w in ws for w in words) for k, ws in common.items()}
    ends = len(re.findall(r"[.!?…](?=[\"'”’»)\]]*\s)", text + "\n"))
    letters = sum(map(len, words))
    digits = sum(c.isdecimal() for c in text)
    return {
        "n_words": len(words), "n_lines": len(lines), "common_share": max(per.values()) / len(words) if words else 0.0,
        "letters_share": letters / solid, "digit_ratio": digits / solid, "symbol_ratio": max(0, solid - letters - digits) / solid,
        "mean_word_length": letters / len(words) if words else 0.0, "distinct_words": len(set(words)) / len(words) if words else 0.0,
        "longest_token": np.log2(max(map(len, tokens))), "words_per_line": len(words) / len(lines), "words_per_sentence": np.log2((len(words) + 1) / max(1, ends)),
        "punctuated_lines": sum(x.rstrip(" \t\"'”’»)]")[-1:] in tuple(".!?…;:,") for x in lines) / len(lines),
    }


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("the and\n.,;:!?\"')]12_-|aé ß"), min_size=1, max_size=80))
def test_against_plain_code(text):
    if not quality._plain(text).strip():
        return
    common = {"en": {"the", "a", "and"}, "fr": {"é", "t"}}
    found, expected = values(text, quality.CommonWords(common)), plainly(text, common)
    assert {k: round(float(found[k]), 9) for k in expected} == {k: round(float(v), 9) for k, v in expected.items()}


def test_prose_and_junk_in_a_corpus(spark, small):
    """Planted among the documents of the smallest tables; in texts of a few words chance is too large to tell."""
    words = spark.read.parquet(f"{small}/common_word.parquet")
    corpus = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    salad = "it was that in is of the and to a in that was it of and is the to it a that of in was and the is " * 4
    rows = [(100_000 + i, t) for i, t in enumerate(PROSE)] + [(200_000 + i, t) for i, t in enumerate([*((t + "\n") * (1 + 300 // len(t)) for t in JUNK), salad])]
    found = quality.assess(corpus.union(spark.createDataFrame(rows, corpus.schema)), words).where("doc_id >= 100000").collect()
    kinds = {r["doc_id"]: (r["kind"], r["distance"]) for r in found}
    assert not {k: v for k, v in kinds.items() if k < 200_000 and v[0] in STATES}
    assert not {k: v for k, v in kinds.items() if k >= 200_000 and v[0] not in STATES}
    assert kinds[200_002][0] == "table" and kinds[200_001][0] == "list"


def test_tables(spark, listed):
    rows = [(i, PROSE[i % 2]) for i in range(120)] + [(1000 + i, t) for i, t in enumerate(JUNK)] + [(2000, None), (2001, ""), (2002, " \n"), (None, JUNK[0]), (1000, JUNK[0]), (3000, PROSE[0] * 3000)]
    df = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id bigint, text string, lang string, tails int")
    found = quality.assess(df, listed).collect()
    assert len(found) == len(rows)
    kinds = {r["doc_id"]: r["kind"] for r in found}
    assert {kinds[k] for k in (2000, 2001, 2002)} == {"blank"} and all(r["tails"] is None for r in found if r["kind"] == "blank")
    assert all(kinds[i] not in STATES for i in range(120))
    junk = sorted(r[0] for r in quality.junk(df, listed).collect())
    assert junk == sorted({r["doc_id"] for r in found if r["kind"] in STATES and r["doc_id"] is not None}) and len(junk) >= len(JUNK) - 2
    assert quality.assess(df.limit(0), listed).count() == 0
    assert quality.assess(df, listed.limit(0)).count() == len(rows)


def test_scores_of_a_small_language(spark, listed):
    """A language with 3 texts is held against these, as it is with 90 of the same."""
    few = ["Der Hund ist nicht da.", "Die Kinder und das Pferd sind nicht in der Scheune, das ist ein Problem.", "Das Haus ist alt und die Mauer ist ein wenig schief, und der Garten ist nicht klein."]
    found = []
    for copies in (1, 30):
        rows = [(i, PROSE[0]) for i in range(60)] + [(1000 + 10 * c + i, t) for c in range(copies) for i, t in enumerate(few)]
        scored = quality.assess(spark.createDataFrame(rows, "doc_id bigint, text string"), listed).where("doc_id >= 1000 and doc_id < 1003").orderBy("doc_id").collect()
        found.append([(r["language"], r["tails"], *(round(r[f"z_{k}"], 9) for k in quality.STATISTICS)) for r in scored])
    assert found[0] == found[1] and {r[0] for r in found[0]} == {"de"}


def test_the_distribution_decides(spark, listed):
    """The same table is far out among prose, and the usual case where most texts of its language are tables."""
    table = "| the | 12 |\n|---|---|\n| of | 34 |"
    kinds = []
    for k in (20, 2):
        df = spark.createDataFrame([(i, table if i % k == 0 else PROSE[i % 2]) for i in range(41)] + [(100 + i, table) for i in range(0 if k == 20 else 60)], "doc_id bigint, text string")
        rows = quality.assess(df, listed).collect()
        kinds.append({r["kind"] for r in rows if r["doc_id"] == 0})
        groups = {r["group"]: r["n"] for r in quality.distributions(quality.document_statistics(df, listed)).collect()}
        assert groups == {"en": len(rows), None: len(rows)}
    assert kinds[0] == {"table"} and not kinds[1] & set(STATES)
