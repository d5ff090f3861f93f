"""The registry of models and datasets, the resolved settings of a run, and saved calibrations."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Registry:
    """Models and datasets by id, from a JSON file with ``schema_version``, ``models`` and ``datasets``."""

    schema_version: int
    models: dict[str, dict]
    datasets: dict[str, dict]

    @classmethod
    def load(cls, path: str | Path) -> Registry:
        if Path(path).suffix.lower() != ".json":
            raise ValueError(f"Unsupported catalog format: {Path(path).suffix or 'none'}")
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(int(data["schema_version"]), {m["id"]: m for m in data.get("models", [])}, {d["id"]: d for d in data.get("datasets", [])})

    def model(self, key: str) -> dict:
        if key not in self.models:
            raise KeyError(f"Unknown model: {key}")
        return self.models[key]

    def dataset(self, key: str) -> dict:
        if key not in self.datasets:
            raise KeyError(f"Unknown dataset: {key}")
        return self.datasets[key]

    def enabled(self, kind: str) -> list[str]:
        return [k for k, v in getattr(self, kind).items() if v.get("enabled_by_default")]

    def frame(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = [(k, v.get("name"), v.get("task") or v.get("type"), bool(v.get("enabled_by_default"))) for k, v in getattr(self, kind).items()]
        return spark.createDataFrame(rows, "id string, name string, task string, enabled_by_default boolean")


@dataclass(frozen=True)
class RunConfig:
    """Settings of a scan; ``resolve`` checks the ids against a registry and applies a calibration before a given threshold."""

    embedding_model_id: str | None = None
    reranker_model_id: str | None = None
    language: str | None = None
    enabled_dataset_ids: tuple[str, ...] = ()
    baseline_lexical_threshold: float = 0.5
    semantic_similarity_threshold: float = 0.72
    semantic_top_k: int = 5
    calibration_profile_id: str | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def resolve(cls, registry: Registry, calibration: dict | None = None, min_score: float | None = None, **given) -> RunConfig:
        for key in ("embedding_model_id", "reranker_model_id"):
            if given.get(key):
                registry.model(given[key])
        datasets = tuple(given.pop("enabled_dataset_ids", None) or registry.enabled("datasets"))
        for key in datasets:
            registry.dataset(key)
        chosen = calibration["selected_threshold"] if calibration else min_score
        extra = {} if chosen is None else {"baseline_lexical_threshold": float(chosen)}
        return cls(enabled_dataset_ids=datasets, **(given | extra))

    def to_dict(self) -> dict:
        return asdict(self) | {"enabled_dataset_ids": list(self.enabled_dataset_ids)}


def save_calibration(profile: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(profile, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def load_calibration(path: str | Path) -> dict:
    profile = json.loads(Path(path).read_text(encoding="utf-8"))
    for key in ("dataset_id", "detector_id", "selected_threshold", "selection_metric", "scores"):
        if key not in profile:
            raise ValueError(f"Calibration profile lacks {key}")
    return profile
