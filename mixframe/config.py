"""Declared tables: column specs, roles, and the Spark schema that follows from them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# The declared dtypes and feature kinds a configuration may use.
DTYPES = {"FLOAT": T.FloatType(), "INTEGER": T.LongType(), "STRING": T.StringType()}
KINDS = ("fcNumeric", "fcVocabIndicator", "fcHashEmbedding")
SPLITS = ("train", "eval", "test")
MAX_HASH_BUCKETS = 10000
# Fixed value: this column is always embedded in 64 dimensions, whatever its declaration says.
FORCED_EMBEDDING_SIZES = {"core_user_id": 64}


@dataclass(frozen=True)
class FeatureSpec:
    """One declared column."""

    name: str
    shape: tuple[int, ...]
    kind: str
    dtype: str
    params: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"column {self.name}: unsupported fcType {self.kind!r}")
        if self.dtype not in DTYPES:
            raise ValueError(f"column {self.name}: unsupported dtype {self.dtype!r}")
        needed = {"fcVocabIndicator": ("vocabulary",), "fcHashEmbedding": ("hashSize", "embeddingSize")}
        for key in needed.get(self.kind, ()):
            if key not in self.params:
                raise ValueError(f"column {self.name}: {self.kind} needs {key}")

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> FeatureSpec:
        name, kind, shape = raw["name"], raw["fcType"], raw["shape"]
        if not isinstance(shape, list):
            raise TypeError(f"column {name}: shape must be a list")
        if kind not in KINDS:
            raise ValueError(f"column {name}: unsupported fcType {kind!r}")
        params = raw["fcParam"][kind]
        if not isinstance(params, dict):
            raise TypeError(f"column {name}: fcParam.{kind} must be an object")
        return cls(name, tuple(int(n) for n in shape), kind, params["dtype"], params)

    @property
    def length(self) -> int | None:
        """Declared vector length; None for a scalar."""
        return self.shape[0] if self.shape else None

    @property
    def spark_type(self) -> T.DataType:
        scalar = DTYPES[self.dtype]
        return T.ArrayType(scalar) if self.shape else scalar

    @property
    def buckets(self) -> int:
        return min(int(self.params["hashSize"]), MAX_HASH_BUCKETS)

    @property
    def embedding_size(self) -> int:
        return FORCED_EMBEDDING_SIZES.get(self.name, int(self.params["embeddingSize"]))


@dataclass(frozen=True)
class TableConfig:
    """Declared columns with their roles, and where the splits are stored."""

    columns: Mapping[str, FeatureSpec]
    ids: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    no_export: tuple[str, ...] = ()
    paths: Mapping[str, str] = field(default_factory=dict)
    params: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> TableConfig:
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> TableConfig:
        specs = [FeatureSpec.from_dict(entry) for entry in raw["featureColumns"]]

        def names(key: str) -> tuple[str, ...]:
            return tuple(sorted(raw.get(key, ())))

        model_type = raw.get("modelType")
        return cls(
            columns={spec.name: spec for spec in sorted(specs, key=lambda spec: spec.name)},
            ids=names("idCols"),
            labels=names("labelCols"),
            excluded=names("exceptCols"),
            no_export=names("noExportCols"),
            paths={k: v for k, v in raw.get("dataSource", {}).items() if k in SPLITS},
            params=raw.get("modelParam", {}).get(model_type, {}) if model_type else {},
        )

    @property
    def features(self) -> list[str]:
        """Model inputs in name order; the order fixes vector positions and channels."""
        special = {*self.ids, *self.labels, *self.excluded}
        return sorted(name for name in self.columns if name not in special)

    def names(self, role: str) -> list[str]:
        """Column names of a role: features, labels, ids, export, no_export or all."""
        if role == "features":
            return self.features
        if role == "labels":
            return list(self.labels)
        if role == "ids":
            return list(self.ids)
        if role == "export":
            return [name for name in self.features if name not in self.no_export] + list(self.ids)
        if role == "no_export":
            return [name for name in self.features if name in self.no_export]
        if role == "all":
            return self.features + list(self.labels) + list(self.ids)
        raise ValueError(f"unknown role {role!r}")

    def schema(self, *roles: str) -> T.StructType:
        """Spark schema of the given roles (all roles when none is given)."""
        wanted = [name for role in (roles or ("all",)) for name in self.names(role)]
        return T.StructType([T.StructField(name, self.columns[name].spark_type) for name in dict.fromkeys(wanted)])


def schema_from_config(config: TableConfig) -> T.StructType:
    """Table schema of a declared configuration."""
    return config.schema()
