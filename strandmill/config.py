"""The preparation config: sections and fields with defaults, read from JSON or TOML, checked before anything runs."""

from __future__ import annotations

import hashlib
import json
import tomllib
from pathlib import Path
from types import SimpleNamespace

# The sections of a config file, their fields and defaults. Fields marked in UNUSED are accepted, kept
# and read by nothing.
TOKENIZER = {"type": "unigram", "vocab_size": 8192, "character_coverage": 0.9995, "min_frequency": 2, "max_corpus_mb": None, "model_path": None}
DATASET = {
    "name": ..., "path": ..., "format": "text", "weight": 1.0, "delimiter": "\n\n", "chunk_size": 1024, "text_field": "text", "min_length": 10,
    "max_length": None, "max_docs": None, "max_tokens": None, "curriculum_stage": None,
}
MIXING = {
    "strategy": "interleave", "block_size": 1, "temperature": 1.0, "upsample_to_max": False, "downsample_to_min": False,
    "target_total_docs": None, "target_total_tokens": None, "source_ratios": None, "weight_by": "docs", "seed": 42,
}
STAGE = {"name": ..., "min_length": None, "max_length": None, "sources": None, "source_weights": None, "num_docs": None, "num_tokens": None, "fraction": None}
CURRICULUM = {"enabled": False, "type": "length_based", "num_stages": 3, "length_bins": None, "stages": (), "output_mode": "merged"}
SPLITS = {"train": 0.9, "val": 0.1, "test": 0.0, "shuffle": True, "stratified": True, "seed": 42}
OUTPUT = {"dir": "data/fast", "prefix": "prepared", "save_stats": True, "save_manifest": True, "eos_token_id": -1, "shard_size_tokens": 0}
UNUSED = {"tokenizer.min_frequency", "datasets.curriculum_stage", "mixing.temperature", "curriculum.length_bins", "curriculum.stages.num_tokens"}

#: Formats whose path may be a remote URI.
REMOTE = "hf://"


class ConfigError(ValueError):
    """What is wrong with a config."""


def _section(name: str, spec: dict, given: dict) -> SimpleNamespace:
    if not isinstance(given, dict):
        raise ConfigError(f"{name} must be a table")
    if unknown := sorted(given.keys() - spec.keys()):
        raise ConfigError(f"{name}: unknown fields {', '.join(unknown)}")
    if missing := sorted(k for k, v in spec.items() if v is ... and k not in given):
        raise ConfigError(f"{name}: missing fields {', '.join(missing)}")
    return SimpleNamespace(**{k: given.get(k, v) for k, v in spec.items()})


def parse(raw: dict) -> SimpleNamespace:
    """A config from nested tables; unknown fields are errors."""
    known = {"tokenizer": TOKENIZER, "mixing": MIXING, "curriculum": CURRICULUM, "splits": SPLITS, "output": OUTPUT}
    if unknown := sorted(raw.keys() - known.keys() - {"datasets"}):
        raise ConfigError(f"unknown sections {', '.join(unknown)}")
    config = SimpleNamespace(**{k: _section(k, spec, raw.get(k, {})) for k, spec in known.items()})
    config.datasets = [_section("datasets", DATASET, x) for x in raw.get("datasets", [])]
    config.curriculum.stages = [vars(_section("curriculum.stages", STAGE, x)) for x in config.curriculum.stages]
    return config


def load(path: str | Path) -> SimpleNamespace:
    """A config file, by its suffix .json or .toml."""
    path = Path(path)
    readers = {".json": json.loads, ".toml": tomllib.loads}
    if path.suffix.lower() not in readers:
        raise ConfigError(f"a config is .json or .toml, not {path.suffix!r}")
    raw = readers[path.suffix.lower()](path.read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ConfigError("the config must be a table")
    return parse(raw)


def check(config: SimpleNamespace, exists=lambda p: Path(p).exists()) -> SimpleNamespace:
    """The config itself if it is consistent; else a ConfigError that lists all that is wrong."""
    wrong = []
    sources, mixing, splits = config.datasets, config.mixing, config.splits
    if abs(splits.train + splits.val + splits.test - 1.0) >= 1e-6:
        wrong.append(f"splits add up to {splits.train + splits.val + splits.test}")
    if not sources:
        wrong.append("no datasets")
    for s in sources:
        if not str(s.path).startswith(REMOTE) and not exists(s.path):
            wrong.append(f"{s.name}: {s.path} doesn't exist")
        if s.weight < 0:
            wrong.append(f"{s.name}: negative weight")
        wrong += [f"{s.name}: {k} must be positive" for k in ("max_docs", "max_tokens") if getattr(s, k) is not None and getattr(s, k) <= 0]
    if sources and sum(s.weight for s in sources) <= 0:
        wrong.append("all weights are zero")
    if config.output.shard_size_tokens < 0:
        wrong.append("shard_size_tokens is negative")
    if mixing.upsample_to_max and mixing.downsample_to_min:
        wrong.append("upsample_to_max and downsample_to_min exclude each other")
    if mixing.target_total_docs and mixing.target_total_tokens:
        wrong.append("target_total_docs and target_total_tokens exclude each other")
    if mixing.weight_by not in ("docs", "tokens"):
        wrong.append(f"weight_by is {mixing.weight_by!r}")
    active = [s for s in sources if s.weight > 0]
    if mixing.weight_by == "tokens" and len(active) > 1 and mixing.target_total_tokens is None and any(s.max_tokens is None for s in active):
        wrong.append("weighting several datasets by tokens needs target_total_tokens or max_tokens for each")
    if wrong:
        raise ConfigError("; ".join(wrong))
    return config


def fingerprint(*parts) -> str:
    """A key for cached stages: it changes with any setting, unlike a source's name alone."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=vars).encode()).hexdigest()[:16]
