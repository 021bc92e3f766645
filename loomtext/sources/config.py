"""Settings with typed defaults, from the environment or a ``.env`` file, overridden by ``spark.loomtext.*``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    llm_provider: str = "auto"  # offline, chat, responses; auto: by llm_base_url
    llm_model: str = ""
    llm_base_url: str = ""
    llm_force_json: bool = False
    llm_request_delay: float = 2.0
    llm_retry_wait: float = 20.0
    llm_max_tokens: int = 4096
    llm_attempts: int = 5
    embedding_model: str = "hashed"  # or module:factory of an object with encode(texts)
    embedding_batch: int = 64
    kmedoids_k: int = 100
    gmm_k: int = 100
    gmm_covariance_type: str = "tied"
    reduction: str = "none"
    pca_dims: int = 50
    k0: int = 300
    k_min: int = 5
    k_max: int = 50
    k_method: str = "silhouette"
    cluster_method: str = "kmedoids"
    label_chunk: int = 30
    classify_batch: int = 20
    hybrid_p: float = 0.1
    hybrid_k_max: int = 50
    graph_knn: int = 15
    graph_min_similarity: float = 0.3
    graph_resolution: float = 1.0
    seed: int = 42


def _typed(kind: str, raw: str):
    if kind == "bool":
        return raw.strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float}.get(kind, str)(raw)


def read_env_file(path: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if os.path.exists(path):
        for line in open(path, encoding="utf-8"):
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("\"'")
    return found


def load(spark: SparkSession | None = None, env_file: str = ".env") -> Settings:
    """Later wins: defaults, the file, the environment, the session."""
    file = read_env_file(env_file)
    values = {}
    for f in fields(Settings):
        raw = os.environ.get(f.name.upper(), file.get(f.name.upper()))
        if spark is not None:
            raw = spark.conf.get(f"spark.loomtext.{f.name}", raw)
        if raw is not None:
            values[f.name] = _typed(f.type, raw)
    return Settings(**values)
