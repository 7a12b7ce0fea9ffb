"""Fitted artifacts as small tables: what one job fits, another one scores with."""

from __future__ import annotations

from dataclasses import fields
from typing import Any, TypeVar

import numpy as np
from pyspark.sql import SparkSession

A = TypeVar("A")

_SCHEMA = "part string, field string, shape array<long>, numbers array<double>, kind string"


def save_artifact(spark: SparkSession, path: str, version: int, **parts: Any) -> None:
    """Write the parts of an artifact (scaler, model, threshold) together under one version.

    A part is a dataclass of numbers and arrays, or a number or array itself. A version is written once: a second
    attempt to write it fails instead of changing what other jobs may have read.
    """
    rows = []
    for name, part in parts.items():
        inside = {f.name: getattr(part, f.name) for f in fields(part)} if hasattr(part, "__dataclass_fields__") else {"": part}
        for field, value in inside.items():
            numbers = np.asarray(value, dtype=float)
            rows.append((name, field, list(numbers.shape), numbers.ravel().tolist(), type(value).__name__))
    # fitted numbers only: their count does not depend on the rows that were fitted
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")


def load_artifact(spark: SparkSession, path: str, version: int, **kinds: type) -> dict[str, Any]:
    """The named parts of a version, each as the given dataclass, or as a number or array for ``float``/``np.ndarray``."""
    found: dict[str, dict[str, Any]] = {}
    for row in spark.read.parquet(f"{path}/version={version}").collect():
        value: Any = np.array(row.numbers).reshape(row.shape)
        if row.kind in ("int", "float", "bool"):
            value = {"int": int, "float": float, "bool": bool}[row.kind](value)
        found.setdefault(row.part, {})[row.field] = value
    missing = sorted(set(kinds) - set(found))
    if missing:
        raise ValueError(f"version {version} has no part {missing}")
    return {
        name: kind(**found[name]) if hasattr(kind, "__dataclass_fields__") else found[name][""] for name, kind in kinds.items()
    }
