"""The queries of the core over the data folder's tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, schedule, tokenizers
from .functions import text as tx
from .functions import tokens as tk
from .operators import documents as dc
from .operators import evaluation as ev
from .operators import lint, mixing, packing, sampling
from .ordinal import id_block, scan
from .session import checkpoint, ship, spread, table
from .streaming import tail

SEED = 42
RATIOS = {"webmirror": 2.0, "crawl_edu": 1.0, "run_notes": 1.0, "fr_presse": 0.5}
STAGES = [
    {"name": "short", "max_length": 800, "fraction": 0.2},
    {"name": "middle", "min_length": 400, "max_length": 2000, "num_docs": 150},
    {"name": "stories", "sources": ["tiny_tales", "young_reader"]},
]

_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        _REGISTRY[name or f.__name__] = (f, sql)
        return f

    return add


# ---------------------------------------------------------------- shared parts

# Usable documents; documents prepared without compatibility composition, which the SQL engine lacks.
_D = "d AS (SELECT source, doc_id AS doc_ord, text FROM documents WHERE text IS NOT NULL AND text <> '' AND source IS NOT NULL)"
_CLEAN = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]', '', 'g')"
_P = f"""{_D}, p AS (SELECT source, doc_ord, strlen(t)::BIGINT AS n_tokens
  FROM (SELECT source, doc_ord, {_CLEAN} AS t FROM d) WHERE length(t) >= 10 AND strlen(t) >= 10)"""
_KEY = "md5(concat_ws('|', '42', source, CAST(doc_ord AS VARCHAR)))"
_SPLIT = f"""{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_KEY}, doc_ord) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS c FROM p),
  s AS (SELECT source, doc_ord, n_tokens, CASE WHEN i < floor(c * 0.8::DOUBLE) THEN 'train'
    WHEN i < floor(c * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return dc.usable(_documents(spark, d))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return dc.prepared(_documents(spark, d), normalize=False)


def _narrow(spark: SparkSession, d: str) -> DataFrame:
    """The prepared rows, written once to the shared folder: ranks read their input twice, and these are a few bytes a document."""
    return checkpoint(_prepared(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return mixing.split_stratified(_narrow(spark, d), SEED, 0.8, 0.1)


# ---------------------------------------------------------------- preparation

_STATS = """SELECT split, source, count(*) AS num_docs, CAST(sum(n_tokens) AS BIGINT) AS total_tokens, round(avg(n_tokens), 6) AS mean_len,
  median(n_tokens) AS median_len, min(n_tokens) AS min_len, max(n_tokens) AS max_len FROM s GROUP BY split, source"""


@query(f"WITH {_SPLIT} {_STATS}")
def prep_stats_by_split_source(spark, d):
    return packing.statistics(_split(spark, d)).withColumn("mean_len", F.round("mean_len", 6))


@query()
def prep_stats_normalized(spark, d):
    rows = checkpoint(dc.prepared(_documents(spark, d)))
    return packing.statistics(mixing.split_stratified(rows, SEED, 0.8, 0.1)).withColumn("mean_len", F.round("mean_len", 6))


@query(f"WITH {_P} SELECT source, doc_ord, n_tokens FROM p")
def prep_documents(spark, d):
    return _prepared(spark, d)


@query(f"SELECT doc_id, CAST(length({_CLEAN}) AS BIGINT) AS n_chars_clean FROM documents WHERE text IS NOT NULL")
def text_strip_controls(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", F.char_length(tx.strip_controls(F.col("text"))).cast("bigint").alias("n_chars_clean"))


@query()
def text_normalized(spark, d):
    return _documents(spark, d).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query()
def text_clean_wikitext(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", tx.clean_wikitext(F.col("text")).alias("text"))


# ---------------------------------------------------------------- tokenizers

_TEXTS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''"
_POINTS = f"c AS (SELECT doc_id, list(unicode(ch)::BIGINT ORDER BY i) AS l FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM ({_TEXTS})) GROUP BY doc_id)"
_SUMMARY = """SELECT doc_id, len(l)::BIGINT AS n, list_sum(l)::BIGINT AS total, list_sum(list_transform(l, lambda x, i: x * i))::BIGINT AS weighted,
  list_min(l)::BIGINT AS least, list_max(l)::BIGINT AS most FROM t WHERE len(l) > 0"""


def _summary(spark, d, mode, vocab_size=None):
    rows = _documents(spark, d).where("text is not null and text != ''").select("doc_id", tk.encode(F.col("text"), mode, vocab_size).alias("l"))
    return rows.where(F.size("l") > 0).select("doc_id", *tk.summary(F.col("l")))


@query(f"WITH {_POINTS}, t AS (SELECT doc_id, list_filter(l, lambda x: x < 128) AS l FROM c) {_SUMMARY}")
def tok_codepoint(spark, d):
    return _summary(spark, d, "codepoint")


@query(f"WITH {_POINTS}, t AS (SELECT * FROM c) {_SUMMARY}")
def tok_utf32(spark, d):
    return _summary(spark, d, "utf32")


@query(
    f"""WITH {_POINTS}, t AS (SELECT doc_id, flatten(list_transform(l, lambda x: CASE WHEN x < 65536 THEN [x]
      ELSE [55296 + (x - 65536) // 1024, 56320 + (x - 65536) % 1024] END)) AS l FROM c) {_SUMMARY}"""
)
def tok_utf16(spark, d):
    return _summary(spark, d, "utf16")


@query(
    f"""WITH {_POINTS}, t AS (SELECT doc_id, flatten(list_transform(l, lambda x: CASE WHEN x < 128 THEN [x]
      WHEN x < 2048 THEN [192 + x // 64, 128 + x % 64]
      WHEN x < 65536 THEN [224 + x // 4096, 128 + x // 64 % 64, 128 + x % 64]
      ELSE [240 + x // 262144, 128 + x // 4096 % 64, 128 + x // 64 % 64, 128 + x % 64] END)) AS l FROM c) {_SUMMARY}"""
)
def tok_utf8(spark, d):
    return _summary(spark, d, "utf8")


@query(
    f"""WITH {_POINTS} SELECT doc_id, list_sum(list_transform(l, lambda x: CASE WHEN x < 128 THEN 1 ELSE 0 END))::BIGINT AS n_codepoint,
      list_sum(list_transform(l, lambda x: CASE WHEN x < 128 THEN 1 WHEN x < 2048 THEN 2 WHEN x < 65536 THEN 3 ELSE 4 END))::BIGINT AS n_utf8,
      list_sum(list_transform(l, lambda x: CASE WHEN x < 65536 THEN 1 ELSE 2 END))::BIGINT AS n_utf16, len(l)::BIGINT AS n_utf32 FROM c"""
)
def tok_counts_by_mode(spark, d):
    rows = _documents(spark, d).where("text is not null and text != ''")
    return rows.select("doc_id", *[tk.count_tokens(F.col("text"), m).alias(f"n_{m}") for m in tk.MODES])


@query("SELECT count(*) AS n_texts, CAST(0 AS BIGINT) AS changed FROM documents WHERE text IS NOT NULL")
def tok_roundtrip(spark, d):
    rows = _documents(spark, d).where("text is not null").select("text", *[tk.decode(tk.encode(F.col("text"), m), m).alias(m) for m in ("utf8", "utf16", "utf32")])
    changed = F.when((F.col("utf8") != F.col("text")) | (F.col("utf16") != F.col("text")) | (F.col("utf32") != F.col("text")), 1).otherwise(0)
    return rows.agg(F.count(F.lit(1)).alias("n_texts"), F.sum(changed).cast("bigint").alias("changed"))


@query(
    f"""WITH {_POINTS}, k AS (SELECT unnest(l) AS t FROM c), a AS (SELECT count(*) AS n, count(DISTINCT t) AS u FROM k),
      b AS (SELECT CAST(sum(length(text)) AS BIGINT) AS ch FROM documents WHERE text IS NOT NULL AND text <> '')
      SELECT ch AS num_chars, n AS num_tokens, u AS unique_tokens, round(ch / n, 9) AS chars_per_token, round(u / n, 9) AS unique_ratio FROM a, b"""
)
def tok_benchmark(spark, d):
    rows = _documents(spark, d).where("text is not null and text != ''").select("doc_id", "text")
    out = lint.tokenizer_metrics(dc.tokenize(rows, "utf32"), rows)
    return out.withColumns({c: F.round(c, 9) for c in ("chars_per_token", "unique_ratio")})


@query(
    r"""WITH c AS (SELECT doc_id, length(text) AS n, length(text) - length(replace(text, chr(10), '')) AS u FROM documents WHERE text IS NOT NULL AND text <> '')
      SELECT doc_id, CAST(n - u AS BIGINT) AS n_tokens FROM c WHERE u / n::DOUBLE <= 0.02 AND n > u"""
)
def unk_filter(spark, d):
    rows = dc.tokenize(_documents(spark, d).where("text is not null and text != ''").select("doc_id", "text"), "utf32")
    return dc.unknown_filter(rows, unk_id=10).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


@query("SELECT doc_id, CAST(least(500, length(text)) AS BIGINT) AS n_tokens FROM documents WHERE length(text) >= 100")
def length_filter(spark, d):
    rows = dc.tokenize(_documents(spark, d).where("text is not null").select("doc_id", "text"), "utf32")
    return dc.length_filter(rows, 100, 500).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(
    f"""WITH {_P}, r AS (SELECT *, row_number() OVER w AS i, sum(n_tokens) OVER w AS u FROM p WINDOW w AS (PARTITION BY source ORDER BY doc_ord ROWS UNBOUNDED PRECEDING))
      SELECT source, doc_ord, n_tokens FROM r WHERE i <= 20 AND u <= 30000"""
)
def source_caps(spark, d):
    return dc.source_caps(_narrow(spark, d), 20, 30_000)


# ---------------------------------------------------------------- sampling and mixing

_C = f"{_P}, n AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens_all FROM p GROUP BY source)"
_R = "ratio AS (SELECT * FROM (VALUES ('webmirror', 2.0::DOUBLE / 4.5::DOUBLE), ('crawl_edu', 1.0::DOUBLE / 4.5::DOUBLE), ('run_notes', 1.0::DOUBLE / 4.5::DOUBLE), ('fr_presse', 0.5::DOUBLE / 4.5::DOUBLE)) v(s, ratio))"
_LEFT = f"{_C}, {_R}, m AS (SELECT count(*) AS missing FROM n WHERE source NOT IN (SELECT s FROM ratio)), j AS (SELECT n.*, coalesce(ratio, greatest(0.0, 1 - (SELECT sum(ratio) FROM ratio)) / greatest(missing, 1)) AS ratio FROM n LEFT JOIN ratio ON source = s, m)"


@query(f"WITH {_R} SELECT s AS source, ratio AS share, CAST(floor(100000::DOUBLE * ratio) AS BIGINT) AS planned FROM ratio")
def mix_plan(spark, d):
    rows = [(s, r) for s, r in mixing.normalized_ratios(mixing.derive_ratios(RATIOS, None)).items()]
    return spark.createDataFrame(rows, "source string, share double").withColumn("planned", F.floor(F.col("share") * 100_000.0))


@query(f"WITH {_LEFT} SELECT source, n_docs, CAST(CASE WHEN ratio < 1e-9 THEN 0 ELSE floor(700::DOUBLE * ratio) END AS BIGINT) AS target FROM j")
def target_by_docs(spark, d):
    return mixing.targets(_narrow(spark, d), RATIOS, total_docs=700)


@query(
    f"""WITH {_LEFT}, w AS (SELECT *, CASE WHEN ratio < 1e-9 THEN 0 ELSE floor(900000::DOUBLE * ratio) END AS want FROM j)
      SELECT source, n_docs, CAST(CASE WHEN want <= 0 THEN 0 ELSE greatest(1, floor(want / greatest(1.0, n_tokens_all / n_docs))) END AS BIGINT) AS target FROM w"""
)
def target_by_tokens(spark, d):
    return mixing.targets(_narrow(spark, d), RATIOS, total_tokens=900_000)


@query(f"WITH {_C} SELECT source, n_docs, (SELECT max(n_docs) FROM n) AS target FROM n")
def target_balance_max(spark, d):
    return mixing.targets(_narrow(spark, d), balance="max")


_DRAWN = f"""{_C}, q AS (SELECT *, {{target}} AS target FROM n),
  k AS (SELECT p.*, n_docs, target, row_number() OVER (PARTITION BY p.source ORDER BY md5(concat_ws('|', '42', p.source, CAST(doc_ord AS VARCHAR))), doc_ord) - 1 AS place,
    row_number() OVER (PARTITION BY p.source ORDER BY doc_ord) - 1 AS own FROM p JOIN q USING (source)),
  u AS (SELECT source, n_docs, unnest(range(target)) AS draw FROM q WHERE target > n_docs),
  x AS (SELECT source, draw, CAST(('0x' || substr(md5(concat_ws('|', '42', source, CAST(draw AS VARCHAR))), 1, 8)) AS BIGINT) % n_docs AS place FROM u),
  drawn AS (SELECT source, doc_ord, n_tokens, place AS draw FROM k WHERE target < n_docs AND place < target
    UNION ALL SELECT source, doc_ord, n_tokens, own FROM k WHERE target = n_docs
    UNION ALL SELECT k.source, k.doc_ord, k.n_tokens, x.draw FROM x JOIN k USING (source, place))"""
_TARGETS = {"sample_down": "least(15, n_docs)", "sample_up": "(n_docs * 2 + 3)", "balance_max": "(SELECT max(n_docs) FROM n)", "balance_min": "(SELECT min(n_docs) FROM n)"}


def _wanted(spark, d, kind):
    rows = _narrow(spark, d)
    sizes = mixing.counts(rows).select("source", "n_docs")
    if kind == "sample_down":
        return rows, sizes.withColumn("target", F.least(F.lit(15), F.col("n_docs")))
    if kind == "sample_up":
        return rows, sizes.withColumn("target", F.col("n_docs") * 2 + 3)
    return rows, mixing.targets(rows, balance=kind.removeprefix("balance_"))


def _register_samples():
    for kind, target in _TARGETS.items():
        sql = f"WITH {_DRAWN.replace("{target}", target)} SELECT source, doc_ord, n_tokens, CAST(draw AS BIGINT) AS draw FROM drawn"
        query(sql, kind)(lambda spark, d, kind=kind: mixing.sample(*_wanted(spark, d, kind), SEED))


_register_samples()
_DOWN = _DRAWN.replace("{target}", _TARGETS["sample_down"]) + ", o AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS source_ord FROM n), b AS (SELECT drawn.*, source_ord FROM drawn JOIN o USING (source))"


def _drawn(spark, d):
    return mixing.with_source_order(checkpoint(mixing.sample(*_wanted(spark, d, "sample_down"), SEED)))


@query(f"WITH {_DOWN} SELECT source, doc_ord, CAST(row_number() OVER (ORDER BY source_ord, draw) - 1 AS BIGINT) AS mix_ord FROM b")
def mix_concat(spark, d):
    return mixing.concatenate(_drawn(spark, d)).select("source", "doc_ord", "mix_ord")


def _interleave_sql(block: int) -> str:
    return f"""WITH {_DOWN}, z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '42', source, CAST(draw AS VARCHAR))), draw) - 1 AS i FROM b)
      SELECT source, doc_ord, CAST(row_number() OVER (ORDER BY i // {block}, source_ord, i) - 1 AS BIGINT) AS mix_ord FROM z"""


@query(_interleave_sql(1))
def mix_interleave_b1(spark, d):
    return mixing.interleave(_drawn(spark, d), SEED, 1).select("source", "doc_ord", "mix_ord")


@query(_interleave_sql(3))
def mix_interleave_b3(spark, d):
    return mixing.interleave(_drawn(spark, d), SEED, 3).select("source", "doc_ord", "mix_ord")


@query(
    f"""WITH {_SPLIT}, i AS (SELECT *, row_number() OVER (PARTITION BY split, source ORDER BY doc_ord) - 1 AS i FROM s),
      k AS (SELECT split, source, md5(concat_ws('|', CAST(42 + CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS VARCHAR), split, source, CAST(i AS VARCHAR))) AS key FROM i),
      o AS (SELECT split, source, row_number() OVER (PARTITION BY split ORDER BY key, source) - 1 AS slot FROM k),
      j AS (SELECT *, row_number() OVER (PARTITION BY split, source ORDER BY slot) - 1 AS i FROM o)
      SELECT split, source, i.doc_ord, CAST(j.slot AS BIGINT) AS write_ord FROM i JOIN j USING (split, source, i)"""
)
def mix_schedule(spark, d):
    rows = checkpoint(_split(spark, d).withColumn("draw", F.col("doc_ord")))
    return mixing.schedule(rows, SEED).select("split", "source", "doc_ord", "write_ord")


# ---------------------------------------------------------------- curriculum

_LENGTH = f"""{_P}, r AS (SELECT *, row_number() OVER (ORDER BY n_tokens, doc_ord) - 1 AS i, count(*) OVER () AS c FROM p),
  g AS (SELECT *, CAST(least(i // greatest(1, c // 3), 2) AS BIGINT) AS stage_ord FROM r),
  e AS (SELECT source, doc_ord, n_tokens, stage_ord, 'stage' || stage_ord || '_len' || min(n_tokens) OVER (PARTITION BY stage_ord) || '-' || max(n_tokens) OVER (PARTITION BY stage_ord) AS stage FROM g)"""


@query(f"WITH {_LENGTH} SELECT source, doc_ord, stage_ord, stage FROM e")
def curriculum_length(spark, d):
    return mixing.by_length(_narrow(spark, d), 3).select("source", "doc_ord", "stage_ord", "stage")


@query(
    f"""WITH {_P}, f AS (SELECT source, row_number() OVER (ORDER BY min(doc_ord), source) - 1 AS o FROM p GROUP BY source)
      SELECT source, doc_ord, o AS stage_ord, 'stage' || o || '_' || source AS stage FROM p JOIN f USING (source)"""
)
def curriculum_domain(spark, d):
    return mixing.by_domain(_narrow(spark, d), "doc_ord").select("source", "doc_ord", "stage_ord", "stage")


@query(
    f"""WITH {_P}, a AS (SELECT count(*) AS c FROM p),
      m AS (SELECT 0 AS stage_ord, 'short' AS stage, floor(c * 0.2::DOUBLE) AS cap, p.* FROM p, a WHERE n_tokens <= 800
        UNION ALL SELECT 1, 'middle', 150, p.* FROM p WHERE n_tokens BETWEEN 400 AND 2000
        UNION ALL SELECT 2, 'stories', NULL, p.* FROM p WHERE source IN ('tiny_tales', 'young_reader')),
      r AS (SELECT *, row_number() OVER (PARTITION BY stage_ord ORDER BY doc_ord) AS i FROM m)
      SELECT CAST(stage_ord AS BIGINT) AS stage_ord, stage, source, doc_ord FROM r WHERE cap IS NULL OR i <= cap"""
)
def curriculum_custom(spark, d):
    return mixing.by_rules(_narrow(spark, d), STAGES, "doc_ord").select("stage_ord", "stage", "source", "doc_ord")


@query(f"WITH {_LENGTH}, b AS (SELECT stage AS output, * FROM e UNION ALL SELECT 'merged', * FROM e) SELECT output, count(*) AS num_docs, CAST(sum(n_tokens) AS BIGINT) AS total_tokens FROM b GROUP BY output")
def curriculum_both_modes(spark, d):
    out = mixing.curriculum_outputs(mixing.by_length(_narrow(spark, d), 3), "both")
    return out.groupBy("output").agg(F.count(F.lit(1)).alias("num_docs"), F.sum("n_tokens").alias("total_tokens"))


# ---------------------------------------------------------------- splits


@query(f"WITH {_SPLIT} SELECT source, doc_ord, split FROM s")
def split_stratified(spark, d):
    return _split(spark, d).select("source", "doc_ord", "split")


@query(
    f"""WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY {_KEY}, doc_ord, source) - 1 AS i, count(*) OVER () AS c FROM p)
      SELECT source, doc_ord, CASE WHEN i < floor(c * 0.29::DOUBLE) THEN 'train' WHEN i < floor(c * (0.29::DOUBLE + 0.5::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def split_simple(spark, d):
    return mixing.split_simple(_narrow(spark, d), SEED, 0.29, 0.5).select("source", "doc_ord", "split")


@query(
    f"""WITH {_P}, n AS (SELECT CAST(sum(n_tokens) AS BIGINT) // 129 AS s FROM p), w AS (SELECT unnest(range(s)) AS window_id, s FROM n)
      SELECT CASE WHEN window_id < floor(s * (1 - 0.05::DOUBLE)) THEN 'train' ELSE 'val' END AS split, count(*) AS n_windows FROM w GROUP BY 1"""
)
def split_windows(spark, d):
    total = _narrow(spark, d).agg(F.floor(F.sum("n_tokens") / 129).alias("s"))
    w = total.select("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s") - 1)).alias("window_id"))
    return w.groupBy(F.when(F.col("window_id") < F.floor(F.col("s") * (1 - 0.05)), "train").otherwise("val").alias("split")).agg(F.count(F.lit(1)).alias("n_windows"))


# ---------------------------------------------------------------- packing


@query(f"WITH {_SPLIT} SELECT split, count(*) AS num_docs, CAST(sum(n_tokens) AS BIGINT) AS total_tokens, CAST(sum(n_tokens) + count(*) AS BIGINT) AS written_tokens FROM s GROUP BY split")
def pack_eos_totals(spark, d):
    return packing.split_totals(_split(spark, d), eos=1)


_SHARDS = f"""WITH RECURSIVE {_SPLIT}, o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_ord) AS i FROM s),
  f AS (SELECT split, source, doc_ord, n_tokens, i, CAST(0 AS BIGINT) AS shard, CAST(n_tokens AS BIGINT) AS fill FROM o WHERE i = 1
    UNION ALL SELECT o.split, o.source, o.doc_ord, o.n_tokens, o.i, CASE WHEN f.fill >= 20000 OR f.fill + o.n_tokens > 20000 THEN f.shard + 1 ELSE f.shard END,
      CASE WHEN f.fill >= 20000 OR f.fill + o.n_tokens > 20000 THEN o.n_tokens ELSE f.fill + o.n_tokens END FROM f JOIN o ON o.split = f.split AND o.i = f.i + 1)"""


@query(f"{_SHARDS} SELECT split, source, doc_ord, shard FROM f")
def shard_assign(spark, d):
    return packing.assign_shards(checkpoint(_split(spark, d)), 20_000, "doc_ord").select("split", "source", "doc_ord", "shard")


@query(f"{_SHARDS} SELECT split, shard, count(*) AS num_docs, CAST(sum(n_tokens) AS BIGINT) AS num_tokens FROM f GROUP BY split, shard")
def shard_summary(spark, d):
    return packing.shard_summary(packing.assign_shards(checkpoint(_split(spark, d)), 20_000, "doc_ord"))


def _stream(spark, d):
    rows = dc.tokenize(_usable(spark, d), "utf32")
    return rows.withColumn("n_tokens", F.size("tokens").cast("bigint")).select("source", "doc_ord", "tokens", "n_tokens")


# A stream of code points by source: sums of the tokens of each window and of their places tell windows apart.
_STREAM = f"""WITH {_D}, k AS (SELECT source, doc_ord, i, unicode(ch)::BIGINT AS t FROM (SELECT source, doc_ord, unnest(regexp_extract_all(text, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM d)),
  r AS (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY doc_ord, i) - 1 - {{offset}} AS pos FROM k),
  w AS (SELECT source, pos // 129 AS window_id, pos % 129 AS j, t FROM r WHERE pos >= 0),
  v AS (SELECT source, window_id, CAST(sum(t) FILTER (j < 128) AS BIGINT) AS x_total, CAST(sum(t * (j + 1)) FILTER (j < 128) AS BIGINT) AS x_weighted,
    CAST(sum(t) FILTER (j > 0) AS BIGINT) AS y_total FROM w GROUP BY source, window_id HAVING count(*) = 129)"""


def _window_sums(spark, d, offset):
    out = packing.windows(_stream(spark, d), 128, ["source"], "doc_ord", offset)
    x, y = tk.summary(F.col("x")), tk.summary(F.col("y"))
    return out.select("source", "window_id", x[1].alias("x_total"), x[2].alias("x_weighted"), y[1].alias("y_total"))


@query(f"{_STREAM.replace("{offset}", "0")} SELECT source, window_id, x_total, x_weighted, y_total FROM v")
def windows_fixed(spark, d):
    return _window_sums(spark, d, 0)


@query(f"{_STREAM.replace("{offset}", "37")} SELECT source, window_id, x_total, x_weighted, y_total FROM v")
def windows_offset(spark, d):
    return _window_sums(spark, d, 37)


@query(
    f"""WITH {_P}, r AS (SELECT doc_ord, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(doc_ord AS VARCHAR))), doc_ord) - 1 AS i FROM p)
      SELECT doc_ord, CAST(i % 4 AS BIGINT) AS rank, CAST(i // 4 AS BIGINT) AS turn FROM r"""
)
def rank_shards(spark, d):
    return packing.rank_shards(_narrow(spark, d).select("doc_ord"), 4, SEED, "doc_ord")


_LINES = f"""{_D}, q AS (SELECT doc_ord, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM d),
  l AS (SELECT row_number() OVER (ORDER BY doc_ord, j) - 1 AS line_no, line, CAST(strlen(line) + 1 AS BIGINT) AS bytes FROM q)"""


def _lines(spark, d):
    rows = lint.lines(_usable(spark, d))
    out = scan(rows, [], F.struct(id_block("doc_ord", 4096).alias("a")), ["doc_ord", "line_no"], "_n").withColumn("line_no", F.col("_n") - 1)
    return out.select("line_no", "line", (F.octet_length("line") + 1).cast("bigint").alias("bytes"))


# Fixed value: white space of both ends, as a pattern of the SQL engine.
_BARE = r"regexp_replace(line, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"


def _segments_sql(condition: str) -> str:
    return f"""WITH {_LINES}, b AS (SELECT *, CASE WHEN {condition} THEN 1 ELSE 0 END AS b FROM l),
      g AS (SELECT *, CAST(sum(b) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM b)"""


_BLANK = _segments_sql(f"{_BARE} = ''")
_WIKI = _segments_sql(r"regexp_matches(line, '^\s*=\s+[^=]+\s+=\s*$')")
_PER_SEGMENT = "SELECT segment, count(*) AS n_lines, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM g GROUP BY segment"


def _per_segment(rows):
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("bytes").alias("n_bytes"))


@query(f"{_BLANK} {_PER_SEGMENT}")
def segment_blank(spark, d):
    return _per_segment(dc.segment_lines(_lines(spark, d), tx.boundary(F.col("line"), "blank_line"), "line_no"))


@query(f"{_WIKI} {_PER_SEGMENT}")
def segment_pattern(spark, d):
    return _per_segment(dc.segment_lines(_lines(spark, d), tx.boundary(F.col("line"), "wikitext"), "line_no"))


@query(
    f"""WITH {_D}, q AS (SELECT doc_ord, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10)), 1) - 1 AS piece FROM d)
      SELECT doc_ord, CAST(piece AS BIGINT) AS piece, CAST(length({_BARE}) AS BIGINT) AS n_chars FROM q WHERE {_BARE} <> ''"""
)
def segment_delimiter(spark, d):
    out = dc.segment(_usable(spark, d), "\n\n")
    return out.select("doc_ord", F.col("piece").cast("bigint").alias("piece"), F.char_length("text").cast("bigint").alias("n_chars"))


@query(
    f"""{_BLANK}, t AS (SELECT segment, min(line_no) AS first_line, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM g GROUP BY segment),
      u AS (SELECT *, sum(n_bytes) OVER (ORDER BY segment ROWS UNBOUNDED PRECEDING) AS upto FROM t) SELECT segment, first_line, n_bytes FROM u WHERE upto - n_bytes < 200000"""
)
def extract_docs_budget(spark, d):
    rows = dc.segment_lines(_lines(spark, d), tx.boundary(F.col("line"), "blank_line"), "line_no")
    segments = rows.groupBy("segment").agg(F.min("line_no").alias("first_line"), F.sum("bytes").alias("n_bytes"))
    return packing.within_budget(segments, 200_000, "n_bytes", "segment")


@query(
    f"""{_BLANK}, t AS (SELECT segment, count(*) AS n_lines, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM g GROUP BY segment),
      u AS (SELECT *, sum(n_bytes) OVER (ORDER BY segment ROWS UNBOUNDED PRECEDING) AS upto FROM t), k AS (SELECT * FROM u WHERE upto - n_bytes < 200000)
      SELECT count(*) AS n_docs, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(n_bytes) // 4 AS BIGINT) AS est_tokens,
        round(greatest(0, sum(n_bytes) - 200000) * 100 / 200000, 6) AS overage_percent FROM k"""
)
def extract_stats(spark, d):
    rows = dc.segment_lines(_lines(spark, d), tx.boundary(F.col("line"), "blank_line"), "line_no")
    kept = packing.within_budget(_per_segment(rows), 200_000, "n_bytes", "segment")
    return packing.subset_statistics(kept, 200_000).withColumn("overage_percent", F.round("overage_percent", 6))


@query(f"WITH {_LINES}, u AS (SELECT *, sum(bytes) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS upto FROM l) SELECT line_no, bytes FROM u WHERE upto - bytes < 200000")
def extract_lines_budget(spark, d):
    return packing.within_budget(_lines(spark, d), 200_000, "bytes", "line_no").select("line_no", "bytes")


@query(
    f"""WITH {_D}, u AS (SELECT doc_ord, length(text)::BIGINT AS n, sum(length(text)) OVER (ORDER BY doc_ord ROWS UNBOUNDED PRECEDING) AS upto FROM d)
      SELECT doc_ord, CAST(least(n, 300000 - (upto - n)) AS BIGINT) AS n_tokens FROM u WHERE upto - n < 300000"""
)
def extract_tokens(spark, d):
    return packing.token_prefix(_stream(spark, d), 300_000, "doc_ord").select("doc_ord", "n_tokens")


@query(
    f"""WITH {_D}, u AS (SELECT doc_ord, text, length(text)::BIGINT AS n, sum(length(text)) OVER (ORDER BY doc_ord ROWS UNBOUNDED PRECEDING) AS upto FROM d)
      SELECT doc_ord, md5(substring(text, 1, CAST(least(n, 250000 - (upto - n)) AS BIGINT))) AS digest FROM u WHERE upto - n < 250000"""
)
def corpus_prefix(spark, d):
    return packing.corpus_prefix(_usable(spark, d), 250_000, ["doc_ord"]).select("doc_ord", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- lint

_ISSUES = rf"""WITH {_D}, q AS (SELECT doc_ord, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
  i AS (SELECT doc_ord, line_no, 'quote_spacing' AS kind, line FROM q WHERE regexp_matches(line, '"[ \t]+[\pL\pN_]|[\pL\pN_][ \t]+"')
    UNION ALL SELECT doc_ord, line_no, 'apostrophe_spacing', line FROM q WHERE regexp_matches(line, '[\pL\pN_][ \t]+''[ \t]+')
    UNION ALL SELECT doc_ord, line_no, 'word_quote_missing_space', line FROM q WHERE regexp_matches(line, '[\pL\pN_]"[a-z]|"[a-z]"[a-z]')
    UNION ALL SELECT doc_ord, line_no, 'multiple_spaces', line FROM q WHERE regexp_matches(line, '(^|[^"])  +([^"]|$)')
    UNION ALL SELECT doc_ord, line_no, 'malformed_headers', line FROM q WHERE regexp_matches(line, '^[ \t]*=[ \t]+=|=[ \t]+[a-z].*=[ \t]=')),
  f AS (SELECT doc_ord, CAST(line_no AS BIGINT) AS line_no, kind, substring(line, 1, 50) AS sample FROM i WHERE {_BARE} <> '')"""


@query(f"{_ISSUES} SELECT * FROM f")
def line_lint(spark, d):
    return lint.issues(lint.lines(_usable(spark, d))).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    f"""{_ISSUES}, r AS (SELECT *, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY doc_ord, line_no) AS i FROM f)
      SELECT kind, n, doc_ord AS first_doc, line_no AS first_line, sample AS first_sample FROM r WHERE i = 1"""
)
def lint_summary(spark, d):
    return lint.issue_summary(lint.issues(lint.lines(_usable(spark, d)))).withColumn("first_line", F.col("first_line").cast("bigint")).drop("samples")


@query(
    f"""{_ISSUES}, r AS (SELECT *, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY doc_ord, line_no) AS i FROM f)
      SELECT kind, n, i AS sample_no, doc_ord, line_no, sample FROM r WHERE i <= 3"""
)
def lint_samples(spark, d):
    found = lint.issue_summary(lint.issues(lint.lines(_usable(spark, d))))
    return found.select("kind", "n", F.inline("samples").alias("sample_no", "doc_ord", "line_no", "sample")).withColumns({c: F.col(c).cast("bigint") for c in ("sample_no", "line_no")})


# ---------------------------------------------------------------- evaluation

# Scores by a unigram model of the characters of all prompts stand for a network's log-probabilities.
_UNIGRAM = """k AS (SELECT unicode(ch) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(prompt, '(?s).')) AS ch FROM mcq_example) GROUP BY 1),
  lp AS (SELECT token, ln(n / (SELECT sum(n) FROM k)::DOUBLE) AS logprob FROM k),
  c AS (SELECT item_id, task, answer_index, unnest(choices) AS choice, generate_subscripts(choices, 1) - 1 AS i FROM mcq_example),
  t AS (SELECT item_id, i, unicode(unnest(regexp_extract_all(choice, '(?s).'))) AS token FROM c),
  sc AS (SELECT item_id, i, round(sum(coalesce(logprob, '-inf'::DOUBLE)) / count(*), 9) AS score FROM t LEFT JOIN lp USING (token) GROUP BY item_id, i)"""


def _choice_scores(spark, d):
    items = table(spark, d, "mcq_example")
    prompts = items.select(F.explode(tk.encode(F.col("prompt"), "utf32")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = prompts.agg(F.sum("n").alias("_all"))
    model = prompts.join(F.broadcast(total)).select("token", F.log(F.col("n") / F.col("_all")).alias("logprob"))
    choices = items.select("item_id", F.posexplode("choices").alias("choice", "text"))
    each = choices.select("item_id", "choice", F.explode(tk.encode(F.col("text"), "utf32")).alias("token"))
    return ev.choice_scores(each, model, ["item_id", "choice"], normalize=True).withColumn("score", F.round("score", 9))


@query(f"WITH {_UNIGRAM} SELECT item_id, CAST(i AS BIGINT) AS choice, round(score, 6) AS score FROM sc")
def eval_choice_scores(spark, d):
    return _choice_scores(spark, d).select("item_id", F.col("choice").cast("bigint").alias("choice"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_UNIGRAM}, b AS (SELECT item_id, i, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) AS r FROM sc),
      a AS (SELECT m.task, CASE WHEN b.i = m.answer_index THEN 1 ELSE 0 END AS ok FROM b JOIN mcq_example m USING (item_id) WHERE r = 1)
      SELECT task, count(*) AS num_examples, CAST(sum(ok) AS BIGINT) AS num_correct, round(sum(ok) / count(*), 9) AS accuracy FROM a GROUP BY ROLLUP (task)"""
)
def eval_accuracy(spark, d):
    best = ev.predictions(_choice_scores(spark, d))
    results = best.join(table(spark, d, "mcq_example").select("item_id", "task", "answer_index"), "item_id").withColumn("correct", F.col("predicted") == F.col("answer_index"))
    return ev.accuracy(results).withColumn("accuracy", F.round("accuracy", 9))


@query(
    """WITH c AS (SELECT item_id, generate_subscripts(choices, 1) - 1 AS i, length(prompt) AS p, length(unnest(choices)) AS c FROM mcq_example)
      SELECT item_id, CAST(i AS BIGINT) AS choice, CAST(CASE WHEN p + c <= 160 THEN p ELSE greatest(0, 160 - c) END AS BIGINT) AS n_prompt, CAST(CASE WHEN p + c <= 160 OR c < 160 THEN c ELSE 160 END AS BIGINT) AS n_choice FROM c"""
)
def eval_fit_window(spark, d):
    rows = table(spark, d, "mcq_example").select("item_id", "prompt", F.posexplode("choices").alias("choice", "text"))
    p, c = tk.fit_window(tk.encode(F.col("prompt"), "utf32"), tk.encode(F.col("text"), "utf32"), 160)
    return rows.select("item_id", F.col("choice").cast("bigint").alias("choice"), F.size(p).cast("bigint").alias("n_prompt"), F.size(c).cast("bigint").alias("n_choice"))


# Events stand for training logs: the type is the run, the id the step, the value the loss.


@query(
    """SELECT event_type, round(sum(value * (event_id % 97 + 1)) / sum(event_id % 97 + 1), 6) AS mean_loss, round(exp(sum(value / 1000 * (event_id % 97 + 1)) / sum(event_id % 97 + 1)), 6) AS perplexity
      FROM events GROUP BY event_type"""
)
def weighted_loss_ppl(spark, d):
    rows = table(spark, d, "events").withColumn("tokens", F.col("event_id") % 97 + 1)
    mean = ev.weighted_loss(rows, ["event_type"], "value").select("event_type", F.round("mean_loss", 6).alias("mean_loss"))
    small = ev.weighted_loss(rows.withColumn("value", F.col("value") / 1000), ["event_type"], "value").select("event_type", F.round("perplexity", 6).alias("perplexity"))
    return mean.join(small, "event_type")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id AS s, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value) AS i FROM events WHERE value IS NOT NULL),
      f AS (SELECT user_id, i, s, v AS best, 0 AS wait, 1 AS n, CAST(NULL AS BIGINT) AS stop FROM o WHERE i = 1
        UNION ALL SELECT o.user_id, o.i, o.s, CASE WHEN o.v < f.best - 0.5 THEN o.v ELSE f.best END, CASE WHEN o.v < f.best - 0.5 THEN 0 ELSE f.wait + 1 END,
          f.n + CASE WHEN o.v < f.best - 0.5 THEN 1 ELSE 0 END, CASE WHEN o.v >= f.best - 0.5 AND f.wait + 1 >= 8 THEN o.s END
        FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1 WHERE f.stop IS NULL),
      l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS z FROM f)
      SELECT user_id, best, stop AS stop_step, CAST(n AS BIGINT) AS improvements FROM l WHERE z = 1"""
)
def early_stop(spark, d):
    return ev.early_stopping(table(spark, d, "events"), "user_id", "event_id", "value", 8, 0.5)


@query(
    """WITH m AS (SELECT user_id, event_id, coalesce(value > 50, true) AS bad FROM events),
      g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, bad ORDER BY event_id) AS z FROM m)
      SELECT user_id, min(event_id) AS first_step, max(event_id) AS last_step, count(*) AS length, count(*) >= 3 AS aborts FROM g WHERE bad GROUP BY user_id, z"""
)
def bad_step_runs(spark, d):
    return ev.bad_step_runs(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 50)


@query(
    """WITH a AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s, sum(value) AS v FROM events GROUP BY user_id)
      SELECT user_id, n AS n_steps, round(s, 6) AS seconds, round(CASE WHEN s > 0 THEN v / s END, 9) AS per_second, round(s / n * greatest(0, 200 - n), 3) AS eta_s FROM a"""
)
def throughput_eta(spark, d):
    out = ev.throughput(table(spark, d, "events"), "user_id", "ts", "value", 200)
    return out.withColumns({"seconds": F.round("seconds", 6), "per_second": F.round("per_second", 9), "eta_s": F.round("eta_s", 3)})


@query("SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def mean_over_ranks(spark, d):
    return ev.mean_over_ranks(table(spark, d, "events"), ["event_type"], "value").withColumn("mean_value", F.round("mean_value", 6))


@query(
    """SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value
      FROM events GROUP BY 1, 2"""
)
def stream_event_windows(spark, d):
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    events = events.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("phase"), "value", F.col("value").alias("rss_mb"))
    out = tail.drain(tail.windowed(events, window="6 hours"))
    return out.select(
        F.col("phase").alias("event_type"), F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean_value", 6).alias("mean_value"), F.round("max_rss_mb", 6).alias("max_value")
    )


# ---------------------------------------------------------------- sampling filters (embeddings as logits)

_LOGITS = "l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings)"


def _logits(spark, d):
    return sampling.logits(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"WITH {_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS i FROM l) SELECT vec_id, CAST(token AS BIGINT) AS token FROM r WHERE i = 1")
def sampler_greedy(spark, d):
    return sampling.greedy(_logits(spark, d), "vec_id").withColumn("token", F.col("token").cast("bigint"))


@query(f"WITH {_LOGITS}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit / 0.7 DESC) AS i FROM l) SELECT vec_id, CAST(token AS BIGINT) AS token FROM r WHERE i <= 5")
def sampler_topk(spark, d):
    return sampling.top_k(sampling.temper(_logits(spark, d), 0.7), "vec_id", 5).select("vec_id", F.col("token").cast("bigint").alias("token"))


@query(
    f"""WITH {_LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
      r AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q)
      SELECT vec_id, CAST(token AS BIGINT) AS token FROM r WHERE b <= 0.9"""
)
def sampler_topp(spark, d):
    return sampling.top_p(_logits(spark, d), "vec_id", 0.9).select("vec_id", F.col("token").cast("bigint").alias("token"))


@query(f"WITH {_LOGITS} SELECT vec_id, CAST(token AS BIGINT) AS token, round(CASE WHEN token IN (vec_id % 64, (vec_id + 7) % 64) THEN logit / 1.3 ELSE logit END, 9) AS logit FROM l")
def sampler_penalty(spark, d):
    contexts = table(spark, d, "embeddings").select("vec_id", F.array((F.col("vec_id") + 30) % 64, F.col("vec_id") % 64, (F.col("vec_id") + 7) % 64, F.col("vec_id") % 64).alias("context"))
    out = sampling.penalize(_logits(spark, d), contexts, "vec_id", 1.3, 3)
    return out.select("vec_id", F.col("token").cast("bigint").alias("token"), F.round("logit", 9).alias("logit"))


@query(
    f"""WITH {_LOGITS}, g AS (SELECT vec_id, token, logit - ln(-ln((CAST('0x' || substr(md5(concat_ws('|', '42', CAST(vec_id AS VARCHAR), CAST(token AS VARCHAR))), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0)) AS g FROM l),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, token) AS i FROM g) SELECT vec_id, CAST(token AS BIGINT) AS token FROM r WHERE i = 1"""
)
def sampler_draw(spark, d):
    return sampling.draw(_logits(spark, d), "vec_id", SEED).withColumn("token", F.col("token").cast("bigint"))


# ---------------------------------------------------------------- schedules

_STEPS = 1200


def _schedule(name, column, sql):
    query(f"SELECT CAST(step AS BIGINT) AS step, round({sql}, 9) AS ratio FROM (SELECT unnest(range({_STEPS})) AS step)", name)(
        lambda spark, d: spark.range(_STEPS).select(F.col("id").alias("step"), F.round(column(F.col("id")), 9).alias("ratio"))
    )


_schedule("lr_cosine", lambda s: schedule.cosine(s, 100, 1000, 0.1), "CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (step - 100) / 900.0::DOUBLE))) END")
_WSD = "CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN step < 800 THEN 1.0 WHEN step < 1000 THEN 0.05 + 0.95 * {shape} ELSE 0.05 END"
_AT = "((step - 800) / 200.0::DOUBLE)"
for _shape, _sql in (("linear", f"(1 - {_AT})"), ("sqrt", f"sqrt(greatest(0.0, 1 - {_AT}))"), ("lowered_linear", f"(1 - pow(greatest(0.0, {_AT}), 0.7))")):
    _schedule(f"lr_wsd_{_shape.removesuffix('_linear')}", lambda s, shape=_shape: schedule.wsd(s, 100, 1000, 0.7, 0.2, shape, 0.05), _WSD.format(shape=_sql))
_schedule(
    "lr_resume",
    lambda s: schedule.resumed(s, 1100, 0.4, 50, 50, stable=0.7, decay=0.2, shape="linear", floor=0.1),
    "CASE WHEN step < 50 THEN 0.4 WHEN step < 100 THEN 0.4 + 0.6 * least(1.0, (step - 49) / 50.0::DOUBLE) WHEN step < 800 THEN 1.0 WHEN step < 1000 THEN 0.1 + 0.9 * (1 - (step - 800) / 200.0::DOUBLE) ELSE 0.1 END",
)
_schedule(
    "lr_sgdr",
    lambda s: schedule.restarts(s, 1000, 4, 0.05, 0.8),
    "0.05 + (pow(0.8, least(step // 250, 3)) - 0.05) * 0.5 * (1 + cos(pi() * least(1.0, (step - least(step // 250, 3) * 250) / 250.0::DOUBLE)))",
)


@query(f"SELECT CAST(step AS BIGINT) AS step, CASE WHEN step < 200 THEN 'fp32' WHEN step < 900 THEN 'bf16' ELSE 'fp8' END AS precision FROM (SELECT unnest(range({_STEPS})) AS step)")
def precision_schedule(spark, d):
    return spark.range(_STEPS).select(F.col("id").alias("step"), schedule.precision_at(F.col("id"), [(0, 200, "fp32"), (200, 900, "bf16"), (900, -1, "fp8")]).alias("precision"))


@query("SELECT experiment, CAST(max_length AS BIGINT) * 16 * 10 AS tokens_per_step FROM experiment_config")
def effective_batch(spark, d):
    return table(spark, d, "experiment_config").select("experiment", (F.col("max_length").cast("bigint") * schedule.effective_batch(16, 10)).alias("tokens_per_step"))


@query(
    """SELECT experiment, CASE WHEN tokenizer_backend = 'gpt2_bpe' THEN CASE WHEN vocab_size < 10000 THEN 'hf_bpe' ELSE 'bpe' END WHEN tokenizer_backend = 'unigram' THEN 'unigram' ELSE 'char' END AS tokenizer,
      CASE WHEN tokenizer_backend IN ('gpt2_bpe', 'unigram') THEN NULL ELSE tokenizer_mode END AS mode FROM experiment_config"""
)
def tok_configured(spark, d):
    name, mode = tokenizers.resolved("char", F.col("tokenizer_backend"), F.col("tokenizer_mode"), F.col("vocab_size"))
    return table(spark, d, "experiment_config").select("experiment", name.alias("tokenizer"), mode.alias("mode"))


# ---------------------------------------------------------------- checkpoints (labels of embeddings as checkpoints)

_WEIGHTS = """ls AS (SELECT label, avg(abs(list_sum(embedding)))::DOUBLE AS loss FROM embeddings GROUP BY label),
  e AS (SELECT label, loss, exp(-loss / 2.0 - max(-loss / 2.0) OVER ()) AS e FROM ls), w AS (SELECT label, loss, e / sum(e) OVER () AS weight FROM e)"""


def _weights(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return ev.checkpoint_weights(table(spark, d, "embeddings").groupBy("label").agg(F.avg(F.abs(total)).alias("loss")), temperature=2.0)


@query(f"WITH {_WEIGHTS} SELECT label, round(loss, 6) AS loss, round(weight, 6) AS weight FROM w")
def ckpt_weights(spark, d):
    return _weights(spark, d).select("label", F.round("loss", 6).alias("loss"), F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {_WEIGHTS}, a AS (SELECT label, vec_id // 10 AS param, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
      SELECT param, CAST(pos AS BIGINT) AS pos, round(sum(weight * v) / sum(weight), 6) AS value FROM a JOIN w USING (label) GROUP BY param, pos"""
)
def ckpt_average(spark, d):
    parameters = table(spark, d, "embeddings").select("label", F.floor(F.col("vec_id") / 10).alias("param"), F.col("embedding").alias("values"))
    out = ev.average_checkpoints(parameters, _weights(spark, d), "label")
    return out.select("param", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- closed forms on arrays


def _array_query(name, column, sql):
    query(
        f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), o AS (SELECT vec_id, {sql} AS o FROM v) SELECT vec_id, round(list_sum(o), 6) AS total, round(list_sum(list_transform(o, lambda x, i: x * i)), 6) AS weighted FROM o",
        name,
    )(lambda spark, d: _array_sums(table(spark, d, "embeddings").select("vec_id", column(F.col("embedding")).alias("o"))))


def _array_sums(rows):
    zero = F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("s"))
    weighted = F.aggregate("o", zero, lambda a, x: F.struct((a["i"] + 1.0).alias("i"), (a["s"] + (a["i"] + 1.0) * x).alias("s")), lambda a: a["s"])
    total = F.aggregate("o", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(total, 6).alias("total"), F.round(weighted, 6).alias("weighted"))


_array_query("norm_rms", arrays.rms_norm, "list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)) / len(e) + 1e-6))")
_array_query("norm_dyt", arrays.dynamic_tanh, "list_transform(e, lambda x: (exp(x) - 1) / (exp(x) + 1))")
_array_query("act_relu2", arrays.relu_squared, "list_transform(e, lambda x: greatest(x, 0.0) * greatest(x, 0.0))")
_array_query("act_xielu", arrays.xielu, "list_transform(e, lambda x: CASE WHEN x > 0 THEN 0.8 * x * x + 0.5 * x ELSE 0.8 * (exp(x) - 1 - x) + 0.5 * x END)")


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
      n AS (SELECT *, ln(list_sum(list_transform(e, lambda x: exp(x)))) AS z FROM v)
      SELECT vec_id, round(0.9 * (z - e[label + 1]) + 0.1 * (z - list_sum(e) / len(e)), 6) AS loss FROM n"""
)
def cross_entropy_smoothed(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(arrays.smoothed_cross_entropy(F.col("embedding"), F.col("label"), 0.1), 6).alias("loss"))


_array_query(
    "norm_crms",
    lambda e: F.transform(arrays.centered_rms_norm(e), lambda x: x + 1.0),
    "list_transform(list_transform(e, lambda x: x - list_sum(e) / len(e)), lambda x: 1 + x / sqrt(list_sum(list_transform(e, lambda y: (y - list_sum(e) / len(e)) * (y - list_sum(e) / len(e)))) / len(e) + 1e-6))",
)
_array_query("norm_flash", arrays.flash_norm, "list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)) / len(e) + 1e-6))")
_array_query("act_gelu", arrays.gelu, "list_transform(e, lambda x: x / (1 + exp(-2 * sqrt(2 / pi()) * (x + 0.044715 * x * x * x))))")
_array_query("act_swiglu", lambda e: arrays.swiglu(F.slice(e, 1, 32), F.slice(e, 33, 32)), "list_transform(e[1:32], lambda x, i: x / (1 + exp(-x)) * e[32 + i])")


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
      o AS (SELECT vec_id, list_transform(e, lambda x, i: x * cos((vec_id % 100) / pow(10000, 2.0 * ((i - 1) % 32) / 64))
        + CASE WHEN i <= 32 THEN -e[i + 32] ELSE e[i - 32] END * sin((vec_id % 100) / pow(10000, 2.0 * ((i - 1) % 32) / 64))) AS o FROM v)
      SELECT vec_id, round(list_sum(o), 6) AS total, round(list_sum(list_transform(o, lambda x, i: x * i)), 6) AS weighted FROM o"""
)
def position_rope(spark, d):
    return _array_sums(table(spark, d, "embeddings").select("vec_id", arrays.rope(F.col("embedding"), F.col("vec_id") % 100).alias("o")))


@query("SELECT h AS head, i, j, round(0 - pow(2, -8.0 * (h + 1) / 4) * greatest(0, j - i), 9) AS bias FROM range(4) a(h), range(40) b(i), range(40) c(j)")
def position_alibi(spark, d):
    return arrays.alibi_bias(spark, 4, 40).withColumn("bias", F.round("bias", 9)).withColumn("head", F.col("head").cast("bigint"))


@query("SELECT i, j, CAST(least(greatest(i - j, 0), 15) AS INTEGER) AS bucket FROM range(50) b(i), range(50) c(j)")
def position_relative(spark, d):
    return arrays.relative_buckets(spark, 50, 16)


# ---------------------------------------------------------------- vocabularies of libraries

#: Where the vocabulary files lie.
VOCABULARIES = "/opt/tokenizers"


def _roundtrip(spark, d, kind, file):
    """Texts that come back changed from the ids of a byte-level vocabulary: none should."""
    used = tokenizers.create(kind, path=f"{VOCABULARIES}/{file}")
    rows = _documents(spark, d).where("text is not null").withColumn("ids", used.encode(F.col("text")))
    rows = rows.select("text", "ids", used.decode(F.col("ids")).alias("back"))
    return rows.agg(F.count(F.lit(1)).alias("n_texts"), F.sum((F.col("back") != F.col("text")).cast("int")).cast("bigint").alias("changed"), F.sum((F.size("ids") > F.octet_length("text")).cast("int")).cast("bigint").alias("longer"))


@query("SELECT count(*) AS n_texts, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS longer FROM documents WHERE text IS NOT NULL")
def tok_ranked_roundtrip(spark, d):
    return _roundtrip(spark, d, "bpe", "byte_bpe_50k.tiktoken")


@query("SELECT count(*) AS n_texts, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS longer FROM documents WHERE text IS NOT NULL")
def tok_json_roundtrip(spark, d):
    return _roundtrip(spark, d, "hf_bpe", "byte_bpe_50k.json")


# ---------------------------------------------------------------- multiple-choice items


@query(
    """SELECT item_id, item_id AS n, CAST(item_id AS VARCHAR) AS example_id, trim(coalesce(prompt, '') || ' ' || 'next') AS prompt, len(choices) AS n_choices, answer_index
      FROM mcq_example WHERE len(choices) >= 2 AND answer_index >= 0 AND answer_index < len(choices)"""
)
def eval_items_endings(spark, d):
    rows = table(spark, d, "mcq_example").select("item_id", F.col("prompt").alias("ctx_a"), F.lit("next").alias("ctx_b"), F.col("choices").alias("endings"), F.col("answer_index").cast("string").alias("label"), F.col("item_id").alias("ind"))
    items = ev.hellaswag_items(rows, "item_id")
    return items.select("item_id", F.col("item_id").alias("n"), "example_id", "prompt", F.size("choices").cast("bigint").alias("n_choices"), "answer_index")


@query(
    """SELECT item_id, CAST(item_id AS VARCHAR) AS example_id, 'Question: ' || trim(prompt) || chr(10) || 'Answer:' AS prompt, trim(choices[1]) AS one, trim(choices[2]) AS two, answer_index
      FROM mcq_example WHERE trim(prompt) <> '' AND trim(choices[1]) <> '' AND trim(choices[2]) <> '' AND answer_index IN (0, 1)"""
)
def eval_items_goals(spark, d):
    rows = table(spark, d, "mcq_example").select("item_id", F.col("prompt").alias("goal"), F.get("choices", F.lit(0)).alias("sol1"), F.get("choices", F.lit(1)).alias("sol2"), F.col("answer_index").alias("label"), F.col("item_id").alias("id"))
    items = ev.piqa_items(rows, "item_id")
    return items.select("item_id", "example_id", "prompt", F.col("choices")[0].alias("one"), F.col("choices")[1].alias("two"), "answer_index")


@query(
    """SELECT item_id, CAST(item_id AS VARCHAR) AS example_id, 'Question: ' || trim(prompt) || chr(10) || 'Answer:' AS prompt, len(choices) AS n_choices, answer_index
      FROM mcq_example WHERE trim(prompt) <> '' AND len(choices) BETWEEN 2 AND 5 AND answer_index >= 0 AND answer_index < len(choices)"""
)
def eval_items_letters(spark, d):
    """Keys are letters for items with even numbers, and numbers for the others."""
    rows = table(spark, d, "mcq_example").where(F.size("choices") <= 5)
    letters = F.slice(F.array(*[F.lit(x) for x in ev.ANSWER_LETTERS]), 1, F.size("choices"))
    key = F.when(F.col("item_id") % 2 == 0, F.get(F.array(*[F.lit(x) for x in ev.ANSWER_LETTERS]), F.col("answer_index"))).otherwise((F.col("answer_index") + 1).cast("string"))
    rows = rows.select("item_id", F.col("prompt").alias("question"), F.struct(F.col("choices").alias("text"), letters.alias("label")).alias("choices"), F.when(F.col("answer_index") >= 0, key).alias("answerKey"), F.col("item_id").alias("id"))
    return ev.arc_items(rows, "item_id").select("item_id", "example_id", "prompt", F.size("choices").cast("bigint").alias("n_choices"), "answer_index")


# ---------------------------------------------------------------- batches, boundaries, merged checkpoints


@query(
    """WITH r AS (SELECT split, record_id, row_number() OVER (PARTITION BY split ORDER BY record_id) - 1 AS i FROM (SELECT DISTINCT split, record_id FROM split_record WHERE split IS NOT NULL AND record_id IS NOT NULL))
      SELECT split, record_id, CAST(floor(i / 32) AS BIGINT) AS batch_id, CAST(i % 32 AS BIGINT) AS place FROM r"""
)
def batches_in_order(spark, d):
    rows = table(spark, d, "split_record").where("split is not null and record_id is not null").select("split", "record_id").distinct()
    return packing.batches(rows, 32, None, "record_id", ["split"]).select("split", "record_id", "batch_id", F.col("place").cast("bigint").alias("place"))


@query(
    """WITH r AS (SELECT split, record_id, row_number() OVER (PARTITION BY split ORDER BY md5('42|' || record_id::VARCHAR), record_id) - 1 AS i, count(*) OVER (PARTITION BY split) AS c
        FROM (SELECT DISTINCT split, record_id FROM split_record WHERE split IS NOT NULL AND record_id IS NOT NULL))
      SELECT split, record_id, CAST(floor(i / 32) AS BIGINT) AS batch_id, CAST(i % 32 AS BIGINT) AS place FROM r WHERE i < floor(c / 32) * 32"""
)
def batches_shuffled(spark, d):
    rows = table(spark, d, "split_record").where("split is not null and record_id is not null").select("split", "record_id").distinct()
    return packing.batches(rows, 32, SEED, "record_id", ["split"], drop_last=True).select("split", "record_id", "batch_id", F.col("place").cast("bigint").alias("place"))


def _doc_lines(spark, d):
    lines = F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line_no", "line")
    return _documents(spark, d).where("text is not null").select("doc_id", lines)


_DOC_LINES = r"WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


@query(_DOC_LINES + rf" SELECT doc_id, CAST(sum(CASE WHEN regexp_full_match(line, '{_WHITE}(<\|endoftext\|>)?{_WHITE}') THEN 1 ELSE 0 END) AS BIGINT) AS boundaries FROM l GROUP BY doc_id")
def boundary_stories(spark, d):
    return _doc_lines(spark, d).groupBy("doc_id").agg(F.sum(tx.boundary(F.col("line"), "tinystories").cast("int")).cast("bigint").alias("boundaries"))


@query(_DOC_LINES + r" SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(line, '^\s*=\s+[^=]+\s+=\s*$') THEN 1 ELSE 0 END) AS BIGINT) AS boundaries FROM l GROUP BY doc_id")
def boundary_headers(spark, d):
    return _doc_lines(spark, d).groupBy("doc_id").agg(F.sum(tx.boundary(F.col("line"), "wikitext").cast("int")).cast("bigint").alias("boundaries"))


@query(
    """WITH p AS (SELECT floor(vec_id / 10) AS param, label, (label + 1)::DOUBLE / 55 AS weight, unnest(list_transform(embedding, lambda x: CAST(floor(x * 10) AS BIGINT))) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
      SELECT CAST(param AS BIGINT) AS param, CAST(pos AS BIGINT) AS pos, CAST(arg_max(v, label) AS DOUBLE) AS value FROM (SELECT param, label, pos, min(v) AS v FROM p GROUP BY param, label, pos) GROUP BY param, pos"""
)
def ckpt_integers(spark, d):
    """Whole-number parameters: those of the heaviest checkpoint."""
    e = table(spark, d, "embeddings")
    rows = e.select("label", F.floor(F.col("vec_id") / 10).alias("param"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 10)).alias("values"), F.lit(True).alias("integral"))
    weights = e.select("label").distinct().withColumn("weight", (F.col("label") + 1) / 55.0)
    least = rows.select("label", "param", "integral", F.posexplode("values").alias("pos", "v")).groupBy("label", "param", "integral", "pos").agg(F.min("v").alias("v"))
    one = least.groupBy("label", "param", "integral").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))
    return ev.average_checkpoints(one, weights, "label").select("param", F.col("pos").cast("bigint").alias("pos"), "value")


# ---------------------------------------------------------------- access


def _shipped(f):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return f(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _REGISTRY.items() if sql is not None}
