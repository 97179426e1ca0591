"""The preparation pipeline: a config becomes one lazy plan from raw sources to shards, statistics and a manifest."""

from __future__ import annotations

import json
import os
from types import SimpleNamespace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cf
from ..functions import text as tx
from ..functions import tokenizers
from ..functions import tokens as tk
from ..operators import documents as dc
from ..operators import mixing, packing
from ..ordinal import id_block, scan
from ..session import checkpoint, checkpoint_dir
from ..sources import npy, paths, readers
from . import diagnostics


def encoder(settings: SimpleNamespace):
    """The column function of a config's tokenizer; vocabularies of libraries need a `model_path`."""
    try:
        if settings.type == "char":
            return tokenizers.create("char", mode="codepoint", vocab_size=settings.vocab_size).encode
        if settings.type == "utf8":
            return tokenizers.create("utf8").encode
        return tokenizers.create(settings.type, path=settings.model_path).encode
    except ValueError as e:
        raise cf.ConfigError(str(e)) from e


def read_source(spark: SparkSession, source: SimpleNamespace, ordinal: int, encode, resolve=None) -> DataFrame:
    """`source`, `source_ord`, `doc_ord`, `tokens`, `n_tokens` of one source after all its filters and caps."""
    raw = readers.reader(source.format)(spark, source, resolve)
    if source.format == "npy":
        rows = raw
    else:
        rows = raw.withColumn("text", tx.normalize(F.col("text")))
        if source.format in ("text", "parquet"):
            rows = rows.where(F.char_length("text") >= source.min_length)
        rows = dc.unknown_filter(rows.withColumn("tokens", encode(F.col("text"))))
        if source.format == "utf8_tokens":
            size = source.chunk_size or 512
            starts = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / size).cast("int"))
            rows = rows.select("doc_ord", F.posexplode(F.transform(starts, lambda i: F.slice("tokens", i * size + 1, size))).alias("_c", "tokens"))
            rows = scan(rows, [], id_block("doc_ord", 16), ["doc_ord", "_c"], "_r").withColumn("doc_ord", F.col("_r") - 1)
        rows = dc.length_filter(rows, source.min_length, None if source.format == "utf8_tokens" else source.max_length, characters=False)
    rows = rows.select(F.lit(source.name).alias("source"), F.lit(ordinal).cast("bigint").alias("source_ord"), "doc_ord", "tokens", F.size("tokens").cast("bigint").alias("n_tokens"))
    return dc.source_caps(rows, source.max_docs, source.max_tokens)


def stage_cache(spark: SparkSession, rows, folder: str, name: str, key: str) -> DataFrame:
    """The stored rows of a source; written first if there is none of this key. The key covers all settings."""
    path = os.path.join(folder, f"{name}-{key}")
    if not paths.exists(spark, os.path.join(path, "_SUCCESS")):
        rows().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plan(spark: SparkSession, config: SimpleNamespace, cache: str | None = None, resolve=None) -> SimpleNamespace:
    """Tables of a checked config: `documents` (with tokens) and `selected` (narrow, with `output`, `split`, `write_ord`), and `scratch`, the folder to remove afterwards, if any.

    Tokens are written once per source (to `cache`, or to the shared folder for checkpoints) and read again only by the
    sink. What lies between is a few bytes per document and is checkpointed after each stage, as ranks read their
    input twice.
    """
    encode = encoder(config.tokenizer)
    active = [(i, s) for i, s in enumerate(config.datasets) if s.weight > 0]
    folder = cache or os.path.join(checkpoint_dir(spark), f"tokens-{uuid4().hex}")
    read = []
    for i, s in active:
        make = lambda i=i, s=s: read_source(spark, s, i, encode, resolve)
        read.append(stage_cache(spark, make, folder, s.name, cf.fingerprint(vars(s), vars(config.tokenizer))))
    documents = read[0]
    for more in read[1:]:
        documents = documents.unionByName(more)
    narrow = documents.select("source", "source_ord", "doc_ord", "n_tokens")
    mix, split, seed = config.mixing, config.splits, config.mixing.seed
    ratios = mixing.derive_ratios({s.name: s.weight for _, s in active}, mix.source_ratios, mix.weight_by)
    balance = "max" if mix.upsample_to_max else "min" if mix.downsample_to_min else None
    sample = lambda rows: mixing.sample(rows, mixing.targets(rows, ratios, mix.target_total_docs, mix.target_total_tokens, balance), seed)
    drawn = checkpoint(mixing.with_source_order(sample(narrow.drop("source_ord")), [s.name for s in config.datasets]))
    if not config.curriculum.enabled and split.stratified:
        # Splits are cut from the draws of each source, and the order is a schedule of sources.
        cut = checkpoint(mixing.split_stratified(drawn, split.seed, split.train, split.val, "draw", split.shuffle))
        selected = checkpoint(mixing.schedule(cut, split.seed).withColumn("output", F.col("split")))
        return SimpleNamespace(documents=documents, selected=selected, scratch=None if cache else folder)
    if mix.strategy not in mixing.MIXERS:
        raise cf.ConfigError(f"unknown mixing strategy {mix.strategy!r}")
    mixed = checkpoint(mixing.MIXERS[mix.strategy](drawn, seed, mix.block_size))
    staged = mixed.withColumns({"stage_ord": F.lit(0).cast("bigint"), "stage": F.lit("default")})
    if config.curriculum.enabled:
        kinds = {
            "length_based": lambda: mixing.by_length(mixed, config.curriculum.num_stages, "mix_ord"),
            "domain_progression": lambda: mixing.by_domain(mixed, "mix_ord"),
            "custom": lambda: mixing.by_rules(mixed, config.curriculum.stages, "mix_ord"),
        }
        if config.curriculum.type not in kinds:
            raise cf.ConfigError(f"unknown curriculum {config.curriculum.type!r}")
        staged = kinds[config.curriculum.type]()
    outputs = mixing.curriculum_outputs(checkpoint(staged), config.curriculum.output_mode if config.curriculum.enabled else "merged")
    keyed = checkpoint(scan(outputs, [], F.struct("stage_ord", id_block("mix_ord")), ["stage_ord", "mix_ord"], "_unit"))
    cutter = mixing.split_stratified if split.stratified else mixing.split_simple
    merged = not config.curriculum.enabled or config.curriculum.output_mode == "merged"
    # Stages are few: their names come from the config or from the lengths of equal parts.
    names = ["merged"] if merged else sorted(r[0] for r in outputs.select("output").distinct().collect())
    parts = [cutter(keyed.where(F.col("output") == o), split.seed, split.train, split.val, "_unit", split.shuffle) for o in names]
    selected = parts[0]
    for p in parts[1:]:
        selected = selected.unionByName(p)
    name = F.col("split") if merged else F.concat_ws("_", "output", "split")
    return SimpleNamespace(documents=documents, selected=checkpoint(selected.withColumn("write_ord", F.col("_unit")).withColumn("output", name).drop("_unit")), scratch=None if cache else folder)


def run(spark: SparkSession, config: SimpleNamespace, cache: str | None = None, resolve=None) -> dict:
    """Writes token files, statistics and the manifest of a config; gives the manifest."""
    cf.check(config)
    out = config.output
    os.makedirs(out.dir, exist_ok=True)
    diagnostics.emit(out.dir, out.prefix, "start", datasets=len(config.datasets))
    made = plan(spark, config, cache, resolve)
    diagnostics.emit(out.dir, out.prefix, "selected")
    sharded = packing.assign_shards(made.selected, out.shard_size_tokens, "write_ord", "output", out.eos_token_id)
    rows = sharded.join(made.documents.select("source", "doc_ord", "tokens"), ["source", "doc_ord"])
    rows = rows.withColumn("tokens", tk.append_eos(F.col("tokens"), out.eos_token_id))
    if out.shard_size_tokens:
        written = [(r["file"], r["n_tokens"]) for r in npy.write_npy(rows, out.dir, ["output", "shard"], ["write_ord"], out.prefix).collect()]
    else:
        written = npy.write_streams(rows, out.dir, "output", "write_ord", out.prefix)
    files = sorted(written, key=lambda f: (len(f[0]), f[0]))
    diagnostics.emit(out.dir, out.prefix, "written", files=len(files), tokens=sum(n for _, n in files))
    stats: dict = {}
    for r in packing.statistics(made.selected, ("output", "source")).collect():
        stats.setdefault(r["output"], {"sources": {}})["sources"][r["source"]] = {k: r[k] for k in ("num_docs", "total_tokens", "mean_len", "median_len", "min_len", "max_len")}
    for s in stats.values():
        s |= {k: sum(x[k] for x in s["sources"].values()) for k in ("num_docs", "total_tokens")}
    shards: dict[str, list[str]] = {}
    for file, _ in files:
        output = file.removeprefix(f"{out.prefix}_").removesuffix(".npy")
        shards.setdefault(output.rpartition("_")[0] if out.shard_size_tokens else output, []).append(os.path.join(out.dir, file))
    manifest = {
        "tokenizer_path": config.tokenizer.model_path,
        "output_paths": {k: v[0] for k, v in shards.items()},
        "output_shards": shards,
        "shard_size_tokens": out.shard_size_tokens,
        "total_tokens": sum(n for _, n in files),
    }
    for wanted, content, kind in ((out.save_stats, stats, "stats"), (out.save_manifest, manifest, "manifest")):
        if wanted:
            with open(os.path.join(out.dir, f"{out.prefix}_{kind}.json"), "w", encoding="utf-8") as f:
                json.dump(content, f, indent=2, sort_keys=True)
    if made.scratch:
        paths.remove(spark, made.scratch)
    return manifest
