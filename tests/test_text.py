import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from strandmill.functions import text as tx


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


STRINGS = ["", "  a b ", "\x1c\xa0x \n", "plain", "a\x00b\x07c\n\t", "ａｂｃ", "café", "é", None, "​z​", "\r\nq\r"]


def test_strip_is_pythons(spark):
    assert column(spark, STRINGS, tx.strip) == [None if s is None else s.strip() for s in STRINGS]


def test_normalize(spark):
    def plain(s):
        return "".join(c for c in unicodedata.normalize("NFKC", s) if unicodedata.category(c) != "Cc" or c in "\n\r\t")

    once = column(spark, STRINGS, tx.normalize)
    assert once == [None if s is None else plain(s) for s in STRINGS]
    assert column(spark, once, tx.normalize) == once
    assert once[4] == "abc\n\t" and once[5] == "abc"


@pytest.mark.parametrize(
    ("line", "dataset", "expected"),
    [
        (" = Title = ", "wikitext", True), (" = = Section = = ", "wikitext", False), ("text", "wikitext", False), ("<|endoftext|>", "tinystories", True),
        ("  <|endoftext|> ", "tinystories", True), ("", "tinystories", True), ("story", "tinystories", False), ("   ", "blank_line", True), ("x", "blank_line", False),
        ("anything", None, False),
    ],
)
def test_boundaries(spark, line, dataset, expected):
    assert column(spark, [line], lambda c: tx.boundary(c, dataset)) == [expected]


def test_boundary_pattern_wins_and_unknown_names_raise(spark):
    assert column(spark, ["## x", " ## x"], lambda c: tx.boundary(c, "wikitext", "##")) == [True, False]
    with pytest.raises(ValueError, match="unknown data set"):
        tx.boundary(F.lit("x"), "nothing")


CLEANED = [
    ("a @-@ b 1 @.@ 5 @,@ c@d", "a-b 1.5, cd"),
    ("a @-@b c@-@ d", "a -b c- d"),
    ("a\n\n\n\nb", "a\n\nb"),
    ("= = Career = =", "== Career =="),
    (" = Title = ", "= Title ="),
    ("= = = Deep part = = =", "=== Deep part ==="),
    ("Hello , world ! Is it ( so ) ?", "Hello, world! Is it (so)?"),
    ("Victoria ' s crown", "Victoria's crown"),
    ("he ’ s here", "he's here"),
    ("the players ’ having", "the players' having"),
    ("the ' 90s", "the '90s"),
    ('said " Craig " today', 'said "Craig" today'),
    ("it cost $ 22 or € 5", "it cost $22 or €5"),
    ("from 30 – 40 or 5 — 6", "from 30–40 or 5—6"),
    ("too   many\t\tblanks", "too many blanks"),
    ("   lead\ntrail   ", "lead\ntrail"),
]


@pytest.mark.parametrize(("before", "after"), CLEANED)
def test_clean_wikitext(spark, before, after):
    assert column(spark, [before], tx.clean_wikitext) == [after]


LINES = ['say " hello', "it ' s", 'word"word', "two  blanks", "= = Career = =", "fine line", "x =  y", '"a  b"', "   "]


def test_lint_patterns(spark):
    for kind, pattern in tx.LINT.items():
        found = column(spark, LINES, lambda c, p=pattern: c.rlike("(?U)" + p))
        assert found == [re.search(pattern, x) is not None for x in LINES], kind


def test_first_samples_of_each_kind(spark):
    from strandmill.operators import lint

    rows = [(d, n, k, f"{k} {d} {n}") for d in range(40, 0, -1) for n in (2, 1) for k in ("a", "b")] + [(5, 1, "c", "c 5 1")]
    found = spark.createDataFrame(rows, "doc_ord bigint, line_no int, kind string, sample string").repartition(5)
    for samples in (1, 3):
        got = {r["kind"]: r for r in lint.issue_summary(found, samples=samples).collect()}
        expected = {k: [r[3] for r in sorted(rows) if r[2] == k][:samples] for k in "abc"}
        assert {k: [x["sample"] for x in r["samples"]] for k, r in got.items()} == expected
        assert {k: (r["n"], r["first_sample"]) for k, r in got.items()} == {k: (1 if k == "c" else 80, v[0]) for k, v in expected.items()}
