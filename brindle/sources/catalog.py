"""Catalog of tables: attach a path under a name, with overrides, a key and pinned versions; read-only."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions.dates import to_millis

OVERRIDES = ("date", "keyword", "ip", "wildcard", "text", "geo_point", "fields")
_KINDS = {"string": "keyword", "boolean": "boolean", "tinyint": "byte", "smallint": "short", "int": "integer", "bigint": "long", "float": "float", "double": "double", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "binary": "binary"}


@dataclass(frozen=True)
class Index:
    """A table as a search index. keys: columns that together order rows totally (ties of pages); key: the primary key, or None."""

    name: str
    df: DataFrame
    key: str | None = None
    keys: tuple[str, ...] = ()
    overrides: dict = field(default_factory=dict)
    renamed: dict = field(default_factory=dict)
    #: The table where df is a query's rows.
    whole: DataFrame | None = None

    def __post_init__(self):
        columns = set(self.df.columns)
        for column, wanted in self.overrides.items():
            if column not in columns:
                raise Refused(f"override of [{column}]: no such column")
            kind = wanted.get("type")
            if kind not in OVERRIDES and "fields" not in wanted:
                raise Refused(f"override of [{column}]: unknown type [{kind}]")
            own = dict(self.df.dtypes)[column]
            if kind == "date" and own not in ("bigint", "int"):
                raise Refused(f"override of [{column}]: date needs epoch milliseconds")
            if kind in ("ip", "wildcard", "text", "keyword") and own not in ("string", "array<string>"):
                raise Refused(f"override of [{column}]: {kind} needs a string")
        if self.key and dict(self.df.dtypes).get(self.key) not in ("tinyint", "smallint", "int", "bigint", "string", "decimal(20,0)"):
            raise Refused(f"[{self.key}] can't be a primary key")

    def resolve(self, name: str, nested: bool = True) -> str | None:
        """The column (dotted path) of a field name: itself, or the base of a declared sub-field, or a path through structs; None if nothing maps."""
        if name in self.df.columns:
            return name
        base, _, sub = name.rpartition(".")
        if base in self.df.columns and sub in self.overrides.get(base, {}).get("fields", ()):
            return base
        at: T.DataType = self.df.schema
        for part in name.split("."):
            if isinstance(at, T.ArrayType):
                if nested:
                    raise Refused(f"[{name}] crosses a list: use nested")
                at = at.elementType
            if not isinstance(at, T.StructType) or part not in at.names:
                return None
            at = at[part].dataType
        return name

    def column(self, name: str) -> tuple[Column, str, T.DataType] | None:
        """(column, kind, type) of a field, or None if it isn't mapped."""
        path = self.resolve(name)
        if path is None:
            return None
        at: T.DataType = self.df.schema
        for part in [path] if path in self.df.columns else path.split("."):
            at = at[part].dataType
        kind = self.overrides.get(path, {}).get("type") or self.kind(at)
        return F.col(path if path not in self.df.columns else f"`{path}`"), kind, at

    @staticmethod
    def kind(at: T.DataType) -> str:
        if isinstance(at, T.ArrayType):
            inner = at.elementType
            return "nested" if isinstance(inner, T.StructType) else "keyword" if isinstance(inner, T.StringType) else "vector" if isinstance(inner, (T.FloatType, T.DoubleType)) else "unsupported"
        if isinstance(at, T.StructType):
            return "geo_point" if set(at.names) == {"lat", "lon"} else "object"
        return _KINDS.get(at.simpleString(), "unsupported")

    def comparable(self, name: str) -> tuple[Column, str, T.DataType]:
        """A field as it sorts and groups: dates as epoch milliseconds, booleans as 0 and 1."""
        found = self.column(name)
        if found is None:
            raise Refused(f"[{name}] was renamed to [{self.renamed[name]}]" if name in self.renamed else f"[{name}] does not map to a column")
        column, kind, at = found
        if kind == "date" and not isinstance(at, T.IntegralType):
            return to_millis(column, at.simpleString()), kind, at
        if kind == "boolean":
            return column.cast("int"), kind, at
        return column, kind, at

    def mapping(self) -> dict[str, str]:
        """Field -> type, of what a request may name."""
        out = {}
        for f in self.df.schema:
            out[f.name] = self.overrides.get(f.name, {}).get("type") or self.kind(f.dataType)
            for sub in self.overrides.get(f.name, {}).get("fields", ()):
                out[f"{f.name}.{sub}"] = "keyword"
        return {k: v for k, v in out.items() if v != "unsupported"}


class Catalog:
    """Names of indexes over one session. A version is a path; tags name versions."""

    def __init__(self, spark: SparkSession):
        self.spark, self.indexes, self.versions, self.tags, self.paths, self.readers = spark, {}, {}, {}, {}, {}

    def attach(self, name: str, table: str | DataFrame, key: str | None = None, keys: tuple[str, ...] | None = None, overrides: dict | None = None, version: int | None = None, tag: str | None = None, options: dict | None = None, renamed: dict | None = None) -> Index:
        """Register a parquet path (or a DataFrame). options go to the reader; version or tag pins a registered path."""
        if version is not None and tag is not None:
            raise Refused("a version and a tag can't both be pinned")
        if isinstance(table, str):
            self.readers[name] = (table, key, keys, overrides, version, tag, options, renamed)
            path = table
            if tag is not None:
                version = self.tags.get((table, tag))
                if version is None:
                    raise Refused(f"[{table}] has no tag [{tag}]")
            if version is not None:
                if version not in self.versions.get(table, {}):
                    raise Refused(f"[{table}] has no version [{version}]")
                path = self.versions[table][version]
            df = self.spark.read.options(**(options or {})).parquet(path)
            self.paths[name] = path
        else:
            df = table
        self.indexes[name] = Index(name, df, key, keys if keys is not None else ((key,) if key else ()), overrides or {}, renamed or {})
        return self.indexes[name]

    def commit(self, table: str, version: int, path: str, tag: str | None = None) -> None:
        """Record that a table's version lies at a path."""
        self.versions.setdefault(table, {})[version] = path
        if tag:
            self.tags[table, tag] = version

    def refs(self, table: str) -> DataFrame:
        """(kind, name, version) of a table's versions and tags."""
        rows = [("version", str(v), v) for v in self.versions.get(table, {})] + [("tag", t, v) for (own, t), v in self.tags.items() if own == table]
        return self.spark.createDataFrame(rows, "kind string, name string, version int")

    def discover(self, folder: str, keys: dict[str, tuple[str, ...]] | None = None) -> list[str]:
        """Attach every <name>.parquet of a folder."""
        found = sorted(f[:-8] for f in os.listdir(folder) if f.endswith(".parquet"))
        for name in found:
            own = (keys or {}).get(name, ())
            self.attach(name, os.path.join(folder, f"{name}.parquet"), own[0] if len(own) == 1 else None, own)
        return found

    def refresh(self, name: str) -> Index:
        """Read the table's files and schema again, with the options it was attached with: a pinned version stays, a tag is followed."""
        if name in self.readers:
            self.spark.catalog.refreshByPath(self.paths[name])
            self.attach(name, *self.readers[name])
        return self.indexes[name]

    def stats(self) -> DataFrame:
        """(name, columns, files) of each index."""
        rows = [(k, len(x.df.columns), len(x.df.inputFiles()) if k in self.paths else 0) for k, x in self.indexes.items()]
        return self.spark.createDataFrame(rows, "name string, columns int, files int")

    def get(self, index: Index, value) -> DataFrame:
        """The row with this key, or none; of a list of keys, all their rows."""
        if not index.key:
            raise Refused(f"[{index.name}] has no primary key")
        return index.df.where(F.col(index.key).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(index.key) == F.lit(value))
