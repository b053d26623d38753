"""JSON scans and sinks, configuration files and file hashes."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.times import parse_instant
from brinewell.operators.classify import KINDS, ScoringConfig
from brinewell.operators.screening import ScreeningConfig
from brinewell.sources.schemas import POST


def read_posts_json(spark: SparkSession, path: str) -> DataFrame:
    """Typed posts of a document with a ``posts`` list."""
    fields = ", ".join(x.strip().replace(" ", ": ", 1) for x in POST.replace("timestamp", "string").split(","))
    rows = spark.read.schema(f"posts array<struct<{fields}>>").json(path, multiLine=True)
    flat = rows.select(F.inline("posts"))
    return flat.withColumns({c: parse_instant(F.col(c)) for c in ("created_at", "fetched_at")})


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, committed by Spark; nulls are kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_json_document(data: object, path: str | Path) -> None:
    """One small document, written beside its place and renamed, so that readers see the old or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(data, f, ensure_ascii=False, indent=2)
            f.write("\n")
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def file_hash(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of the files under a path that Spark can read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _load_yaml(path: str | Path) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configuration needs PyYAML") from e
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(data, dict):
        raise ValueError(f"{path} is no mapping")
    return data


def load_screening_config(path: str | Path) -> ScreeningConfig:
    part = _load_yaml(path)["stage_a"]
    hard, signals, floor = part["hard_exclude"], part["engagement"]["signals"], part["engagement"]["absolute_floor"]
    config = ScreeningConfig(
        frozenset(map(str, hard["removed_states"])), bool(hard["obvious_spam"]), bool(hard["giveaways"]), bool(hard["routine_stickies_or_megathreads"]),
        float(signals["score_weight"]), float(signals["comment_count_weight"]), int(floor["min_score"]), int(floor["min_comment_count"]),
    )
    if config.score_weight < 0 or config.comment_weight < 0 or config.score_weight + config.comment_weight <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    return config


def load_scoring_config(path: str | Path) -> ScoringConfig:
    part = _load_yaml(path)["stage_b"]
    own, score = part["classifier"], part["preliminary_score"]
    if tuple(own["kinds"]) != KINDS:
        raise ValueError("the kinds differ from those that are known")
    config = ScoringConfig(int(own["batch_size"]), int(own["body_excerpt_chars"]), (int(own["relevance"]["min"]), int(own["relevance"]["max"])), (int(own["value"]["min"]), int(own["value"]["max"])), float(score["engagement_weight"]), float(score["llm_weight"]))
    if config.batch_size <= 0 or config.excerpt_chars <= 0:
        raise ValueError("batch size and excerpt length must be positive")
    if config.engagement_weight < 0 or config.label_weight < 0 or config.engagement_weight + config.label_weight <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    return config


def load_communities(path: str | Path, expected: int | None = None) -> list[str]:
    names = [str(c["name"]) for c in _load_yaml(path)["profile"]["communities"]]
    if expected is not None and len(names) != expected:
        raise ValueError(f"{len(names)} communities, not {expected}")
    return names


def load_notes(path: str | Path) -> dict[str, str]:
    """Notes by case-folded community name."""
    return {str(c["name"]).casefold(): str(c["note"]).strip() for c in _load_yaml(path)["profile"]["communities"] if str(c.get("note") or "").strip()}
