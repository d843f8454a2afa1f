"""Job configuration: merging, validation, safe names, input policies."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import SparkSession

from lumirank.sources.files import read_text

_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def validate_identifier(name: str, what: str = "identifier") -> str:
    """Output names may not leave their folder."""
    if not isinstance(name, str) or not _SAFE.fullmatch(name) or ".." in name:
        raise ValueError(f"invalid {what}: {name!r}")
    return name


def load_config(spark: SparkSession, path: str, dataset_id: str | None = None) -> dict:
    """JSON (or YAML where available). `datasets` entries are merged under the chosen id."""
    text = read_text(spark, path)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML configs need pyyaml; use JSON instead") from e
        cfg = yaml.safe_load(text)
    else:
        cfg = json.loads(text)
    if dataset_id:
        if dataset_id not in cfg.get("datasets", {}):
            raise KeyError(f"unknown dataset {dataset_id!r}")
        cfg = {**{k: v for k, v in cfg.items() if k != "datasets"}, **cfg["datasets"][dataset_id], "dataset_id": dataset_id}
    return cfg


def validate_config(cfg: dict, required=("dataset_id", "label_col", "item_id_col", "impression_id_col", "feature_cols")) -> dict:
    missing = [k for k in required if not cfg.get(k)]
    if missing:
        raise ValueError(f"config lacks: {missing}")
    return cfg


def split_paths(cfg: dict, processed: bool = False) -> dict[str, str]:
    """Path of each split under the raw or processed root, unless named outright."""
    root = cfg.get("processed_root" if processed else "data_root", "")
    fmt = "parquet" if processed else cfg.get("data_format", "csv")
    return {s: cfg.get(f"{s}_data") or os.path.join(root, f"{s}.{fmt}") for s in ("train", "valid", "test")}


def negative_config(params: dict) -> dict:
    """Negatives per positive and whether training keeps the full rows."""
    n = max(int(params.get("num_negatives", 0) or 0), int(params.get("diversity_num_negatives", 0) or 0))
    hybrid = bool(params.get("hybrid", False))
    return {"num_negatives": n, "hybrid": hybrid, "full_rows": hybrid or n == 0}


def vocab_scan_splits(available: set[str]) -> tuple[str, ...]:
    """Vocabularies are read from train rows only: the positive table when it exists, else train."""
    for name in ("train_positive", "train"):
        if name in available:
            return (name,)
    raise ValueError("no train table to scan; holdout tables are never scanned")
