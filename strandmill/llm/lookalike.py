"""Problem 1: texts that look the same but are stored in different characters.

Every text gets its canonical form (`folding.canonical`: compatibility normalisation in composed form, mapped
whitespace, no default-ignorable characters, look-alike letters mapped). Look-alikes beyond those listed for Greek,
Cyrillic and Armenian come from the public data on confusable characters that Spark's ICU library holds. As case must stay
visible, the full case folding of the form is given beside it but decides nothing. Forms are computed once per
distinct text of a batch. Only 128-bit hashes of forms and texts are shuffled.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, small, spread
from . import blocks, folding

#: Members of a class up to this number are paired by one join; larger classes in blocks of so many.
EXPAND = 1000
#: Scripts whose look-alikes are listed in `folding`, as many others of their letters are only loosely alike, or that run
#: from right to left.
LISTED = {"LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "ARABIC", "HEBREW", "NKO"}
#: Latin small capitals are drawn like small letters where these have the shape of the capital.
SAME_SHAPE = "cosuvwxz"


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts, and small capitals, that are drawn like one letter of the basic Latin alphabet.

    Two letters are alike if their skeletons by the public confusables data are equal. Letters that have a
    compatibility form are left to normalisation; of I and l, which share a skeleton, the one of the same case is taken.
    """
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = [chr(c) for a in "aA" for c in range(ord(a), ord(a) + 26)]
    drawn: dict[str, list[str]] = {}
    for letter, skeleton in zip(latin, checker.getSkeleton("\n".join(latin)).split("\n")):
        drawn.setdefault(skeleton, []).append(letter)
    letters = [ch for c in range(0x250, 0x20000) if (ch := chr(c)).isalpha() and ud.normalize("NFKD", ch) == ch]
    out = {}
    for ch, skeleton in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")):
        name, found = ud.name(ch, ""), drawn.get(skeleton)
        if found and (name.split(" ")[0] not in LISTED or name.startswith("LATIN LETTER SMALL CAPITAL") and found[0] in SAME_SHAPE):
            out[ch] = found[-1] if not ch.islower() else found[0]
    return out


def _forms(batches: Iterator[pa.RecordBatch], keep: bool, more: dict[str, str]) -> Iterator[pa.RecordBatch]:
    table = folding.spelling(more)
    for batch in batches:
        coded = pc.dictionary_encode(batch.column(1))
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        forms, folded, ids = [], [], []
        for text in coded.dictionary.to_pylist():
            form = folding.canonical(text, table)
            if keep:
                forms.append(form)
                folded.append(form.casefold())
            else:
                same = form is text or form == text
                key = xxhash.xxh3_128_digest(form.encode("utf-8", "replace"))
                ids.append(None if not form.strip() else (key, key if same else xxhash.xxh3_128_digest(text.encode("utf-8", "replace"))))
        at = coded.indices
        cols = [batch.column(0)]
        if keep:
            cols += [pc.take(pa.array(forms, pa.string()), at), pc.take(pa.array(folded, pa.string()), at)]
            names = ["record_id", "form", "folded"]
        else:
            cols += [pc.take(pa.array([x and x[k] for x in ids], pa.binary()), at) for k in range(2)]
            names = ["record_id", "form_key", "text_key"]
        yield pa.RecordBatch.from_arrays(cols, names)


def _texts(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(text_col).cast("string").alias("text")))


def canonical_forms(records: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `record_id`, `form` (canonical) and `folded` (its full case folding); null stays null."""
    more = look_alikes(records.sparkSession)
    return _texts(records, id_col, text_col).mapInArrow(lambda it: _forms(it, True, more), "record_id bigint, form string, folded string")


def form_keys(records: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """Distinct (`record_id`, `form_key`, `text_key`) of records with an id and a non-blank text.

    A record delivered again with the same text counts once.
    """
    more = look_alikes(records.sparkSession)
    keys = _texts(records, id_col, text_col).mapInArrow(lambda it: _forms(it, False, more), "record_id bigint, form_key binary, text_key binary")
    return keys.where("form_key is not null and record_id is not null").distinct()


def _classes(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (`form_key`, `text_key`, `n`, `least`) and classes (`form_key`, `n_records`, `n_texts`, `class_id`)."""
    texts = keys.groupBy("form_key", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("least"))
    return texts, texts.groupBy("form_key").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_texts"), F.min("least").alias("class_id"))


def look_alike_classes(records: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """Every record of a class of texts that look the same: `record_id`, `class_id` (its least record), `n_records`, `n_texts`.

    Null and blank texts are in no class. A class may have one record. Sizes are computed from pre-aggregated
    counts, so that a form that a third of all rows share is no large task.
    """
    keys = checkpoint(form_keys(records, id_col, text_col))
    return blocks.attach(keys, checkpoint(_classes(keys)[1]), ["form_key"], "n_records").select("record_id", "class_id", "n_records", "n_texts")


def look_alike_pairs(records: DataFrame, id_col: str = "record_id", text_col: str = "text", expand: int = EXPAND) -> DataFrame:
    """Pairs (`record_id_1` < `record_id_2`) of records whose texts differ in characters but look the same.

    Every such pair comes out, whatever the size of its class. A class of up to `expand` records is paired by one join,
    a larger one in blocks of so many records: copies of a text with more records have blocks of their own and aren't
    compared with each other, the others share blocks. Null and blank texts, and equal texts, are no pairs; an empty
    table has none; other columns, whatever their names, are ignored.
    """
    keys = checkpoint(form_keys(records, id_col, text_col))
    texts, classes = _classes(keys)
    classes = checkpoint(classes.where("n_texts > 1").drop("class_id"))
    members = checkpoint(blocks.attach(keys, classes, ["form_key"], "n_records"))
    few = members.where(F.col("n_records") <= expand).select("form_key", "text_key", "record_id")
    left, right = few.alias("l"), few.alias("r")
    same = (F.col("l.form_key") == F.col("r.form_key")) & (F.col("l.record_id") < F.col("r.record_id")) & (F.col("l.text_key") != F.col("r.text_key"))
    full = left.join(right, same).select(F.col("l.record_id").alias("record_id_1"), F.col("r.record_id").alias("record_id_2"))
    if classes.where(F.col("n_records") > expand).isEmpty():
        return full.distinct()
    # Blocks of larger classes: `own` is the text that has blocks of its own, or empty where texts share them.
    rows = members.where(F.col("n_records") > expand).select("form_key", "text_key", "record_id")
    sized = texts.join(classes.where(F.col("n_records") > expand).select("form_key"), "form_key", "left_semi")
    own = checkpoint(sized.where(F.col("n") > expand).select("form_key", "text_key", "n"))
    parts = sized.groupBy("form_key", F.when(F.col("n") > expand, F.col("text_key")).otherwise(F.lit(b"")).alias("own")).agg(F.sum("n").alias("n"))
    parts = checkpoint(parts.withColumn("parts", F.ceil(F.col("n") / expand)))
    # Texts with so many copies are few beside the records: at most one for each `expand` of them.
    known = small(own.select(F.col("form_key").alias("_form"), F.col("text_key").alias("_text")))
    rows = rows.join(known, (F.col("form_key") == F.col("_form")) & (F.col("text_key") == F.col("_text")), "left").withColumn("own", F.coalesce("_text", F.lit(b"")))
    block = lambda o, part: F.struct("form_key", F.col(o).alias("own"), F.col(part).cast("bigint").alias("part"))
    placed = blocks.attach(rows.select("form_key", "own", "text_key", "record_id"), parts, ["form_key", "own"], "n")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("record_id"), "parts")).select(block("own", "part").alias("block"), "record_id", "text_key")
    first, second = (parts.select("form_key", F.col("own").alias(f"own_{i}"), F.col("parts").alias(f"parts_{i}")) for i in (1, 2))
    pairs = first.join(second, "form_key").where("own_1 < own_2 or own_1 = own_2 and own_1 = X''")
    for i in (1, 2):
        pairs = pairs.withColumn(f"part_{i}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"parts_{i}") - 1)))
    pairs = pairs.where("own_1 < own_2 or part_1 <= part_2").select(block("own_1", "part_1").alias("block_1"), block("own_2", "part_2").alias("block_2"))
    one, two = (placed.select(F.col("block").alias(f"block_{i}"), F.col("record_id").alias(f"id_{i}"), F.col("text_key").alias(f"text_{i}")) for i in (1, 2))
    large = blocks.cross(pairs, one, two).where("text_1 != text_2 and id_1 != id_2 and (block_1 != block_2 or id_1 < id_2)")
    return full.unionByName(large.select(F.least("id_1", "id_2").alias("record_id_1"), F.greatest("id_1", "id_2").alias("record_id_2"))).distinct()
