"""Text functions on columns: stripping, normalisation, boundaries, cleaning, lint."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what Python's str.strip() removes, as a Java class.
_BLANK = r"[\s\x1c-\x1f]"
# Fixed value: category Cc without line feed, carriage return and tab.
_CONTROLS = r"[\p{Cc}&&[^\n\r\t]]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends (`trim` only knows the space)."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_controls(text: Column) -> Column:
    """Without control characters other than line feed, carriage return and tab."""
    return F.regexp_replace(text, _CONTROLS, "")


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no such function, so texts pass an Arrow UDF, ASCII ones untouched."""
    return _nfkc(text)


def normalize(text: Column) -> Column:
    """Compatibility composition, then no control characters; idempotent."""
    return strip_controls(nfkc(text))


# ---------------------------------------------------------------- boundaries

# What opens a new document in the known data sets.
BOUNDARIES = {
    "wikitext": r"^(?U)\s*=\s+[^=]+\s+=\s*$",
    "tinystories": "<|endoftext|>",
    "blank_line": "",
}


def boundary(line: Column, dataset: str | None = None, pattern: str | None = None) -> Column:
    """Whether a line opens a new document: an explicit pattern wins over a data set's name; neither means never."""
    if pattern is not None:
        return line.rlike(f"^(?:{pattern})")
    if dataset is None:
        return F.lit(False)
    if dataset not in BOUNDARIES:
        raise ValueError(f"unknown data set {dataset!r}; known: {', '.join(sorted(BOUNDARIES))}")
    if dataset == "wikitext":
        return line.rlike(BOUNDARIES[dataset])
    bare = strip(line)
    return (bare == "") | (bare == BOUNDARIES[dataset])


# ---------------------------------------------------------------- cleaning of wiki text


def _header(line: Column) -> Column:
    """A line of equals signs around a title gets as many at both sides as it has, spaced or not, at the left."""
    bare = strip(line)
    # Spaces between equals signs close up, one pass for each sign: signs and spaces in front and behind.
    tight = F.regexp_replace(bare, " *= *", "=")
    level = F.regexp_extract(tight, "^(=+)", 1)
    title = strip(F.regexp_replace(tight, "^=+|=+$", ""))
    heading = F.concat(level, F.lit(" "), title, F.lit(" "), level)
    return F.when(bare.rlike("^=") & bare.rlike("=$") & tight.rlike("[^=]"), heading).otherwise(line)


def _chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def clean_wikitext(text: Column) -> Column:
    """Tidies tokenised wiki text: @-marks, blank lines, headers, and spaces at punctuation, quotes, currency and dashes."""
    text = _chain(text, [(" @-@ |@-@", "-"), (r" @\.@ |@\.@", "."), ("@", ""), ("\n{3,}", "\n\n")])
    text = F.array_join(F.transform(F.split(text, "\n"), _header), "\n")
    return _chain(
        text,
        [
            (r"[ \t]+([,.!?;:)\]}])", "$1"),
            (r"([(\[{])[ \t]+", "$1"),
            (r"(?iU)(\w)[ \t]+[’'][ \t]*([a-z]{1,3})\b", "$1'$2"),
            (r"(?iU)(\b\w+s)[ \t]+[’'][ \t]+([a-z]\w*)", "$1' $2"),
            (r"'[ \t]+(\d)", "'$1"),
            (r"(?U)\"[\s&&[^\n]]*([^\"\n]*?)[\s&&[^\n]]*\"", '"$1"'),
            (r"(?U)(^|[\s(\[{])\"[ \t]+", '$1"'),
            (r"(?Ud)(\S)[ \t]+\"(?=$|[ \t]*[,.!?;:)\]}])", '$1"'),
            (r"(?U)(?<!\w)'[\s&&[^\n]]*([^'\n]*?)[\s&&[^\n]]*'(?!\w)", "'$1'"),
            (r"(?U)([$£€¥])\s+", "$1"),
            (r"[ \t]+([–—])[ \t]+", "$1"),
            (r"[ \t]{2,}", " "),
            (r"(?md)^[ \t]+", ""),
            (r"(?md)[ \t]+$", ""),
        ],
    )


# The issues that the linter reports, with a pattern that finds each in a line.
LINT = {
    "quote_spacing": r"\"[ \t]+\w|\w[ \t]+\"",
    "apostrophe_spacing": r"\w[ \t]+'[ \t]+",
    "word_quote_missing_space": r"\w\"[a-z]|\"[a-z]\"[a-z]",
    "multiple_spaces": "(?<!\")  +(?!\")",
    "malformed_headers": r"^[ \t]*=[ \t]+=|=[ \t]+[a-z].*=[ \t]=",
}
