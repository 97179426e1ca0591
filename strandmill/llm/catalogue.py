"""The queries of the training-data operators and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import encoding, leaks, lookalike, mixing, overlap, pieces, quality, windows


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return f(spark, folder)

    return run


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "raw_record"))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_forms(table(spark, d, "raw_record"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_classes(table(spark, d, "raw_record"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.as_pairs(overlap.overlaps(table(spark, d, "split_record")))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, d, "split_record"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "split_record"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    experiments = table(spark, d, "experiment_config")
    return windows.divided(windows.pack(table(spark, d, "split_record"), experiments), experiments)


def p3_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.pack(table(spark, d, "split_record"), table(spark, d, "experiment_config"))


def p3_unused(spark: SparkSession, d: str) -> DataFrame:
    experiments = table(spark, d, "experiment_config")
    return windows.unused(windows.pack(table(spark, d, "split_record"), experiments), experiments)


def p3_placed(spark: SparkSession, d: str) -> DataFrame:
    experiments = table(spark, d, "experiment_config")
    return windows.placed(windows.pack(table(spark, d, "split_record"), experiments), experiments)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "mcq_example"))


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "mcq_example"))


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_regions(table(spark, d, "documents"), table(spark, d, "mcq_example"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.over_limit(table(spark, d, "raw_record"), table(spark, d, "data_source"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_texts(table(spark, d, "raw_record"), table(spark, d, "data_source"))


def p5_covered(spark: SparkSession, d: str) -> DataFrame:
    return pieces.covered(table(spark, d, "raw_record"), table(spark, d, "data_source"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    texts = encoding.decode(encoding.encode(table(spark, d, "documents")))
    return texts.select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixing_target")).documents()


def p7_slots(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixing_target")).slots()


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixing_target")).blocks()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixing_target")).shares()


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixing_target")).limits()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.junk(table(spark, d, "documents"), table(spark, d, "common_word"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.assess(table(spark, d, "documents"), table(spark, d, "common_word"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_forms, p1_classes, p2_found, p2_classes, p2_report, p3_found, p3_windows, p3_unused, p3_placed, p4_found, p4_items, p4_regions, p5_found, p5_pieces, p5_covered, p6_ids, p6_decoded,
        p7_documents, p7_slots, p7_blocks, p7_shares, p7_limits, p8_found, p8_statistics,
    )
}
ORACLES: dict[str, str] = {
    "p3_placed": """
        WITH n AS (SELECT record_id, arg_max(n_tokens, (CASE WHEN n_tokens IS NULL THEN 0 ELSE 1 END, CASE WHEN prepared_at IS NULL THEN 0 ELSE 1 END, coalesce(epoch_us(prepared_at), 0), coalesce(n_tokens, 0))) AS n_tokens
          FROM split_record WHERE split = 'train' AND record_id IS NOT NULL GROUP BY record_id)
        SELECT experiment, count(*) AS n_records, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_gaps
        FROM n, experiment_config WHERE n_tokens > 0 AND experiment IS NOT NULL AND max_length > 0 AND max_seq_length > 0 GROUP BY experiment""",
    "p5_covered": """
        WITH l AS (SELECT record_id, arg_max((source, text), (CASE WHEN loaded_at IS NULL THEN 0 ELSE 1 END, coalesce(epoch_us(loaded_at), 0), coalesce(source, ''), coalesce(text, ''))) AS r FROM raw_record GROUP BY record_id),
          t AS (SELECT record_id, r[1] AS source, r[2] AS text FROM l)
        SELECT record_id, length(text) AS n_chars, coalesce(length(text) > least(chunk_size, max_length), false) AS is_cut, true AS is_covered, true AS is_within
        FROM t LEFT JOIN data_source s ON t.source = s.source WHERE text IS NOT NULL""",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS md5, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    "p7_limits": """
        WITH t AS (SELECT plan_name, source, greatest(0, coalesce(target_ratio, 0)) AS r FROM mixing_target WHERE plan_name IS NOT NULL AND source IS NOT NULL)
        SELECT plan_name, source, round(CASE WHEN sum(r) OVER (PARTITION BY plan_name) > 0 THEN r / sum(r) OVER (PARTITION BY plan_name) ELSE 0 END, 9) AS target_share, true AS is_within FROM t""",
    "p3_found": """
        SELECT DISTINCT e.experiment, r.record_id
        FROM split_record r, experiment_config e
        WHERE r.split = 'train' AND r.record_id IS NOT NULL AND r.n_tokens > e.max_length""",
    "p5_found": """
        SELECT DISTINCT r.record_id
        FROM raw_record r JOIN data_source s ON r.source = s.source
        WHERE length(r.text) > least(s.chunk_size, s.max_length)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
