"""Where a logical table name finds its DataFrame.

A scan asks the sources in order. The first that knows the name answers; names that
nobody maps stay physical names. No data are read here: a DataFrame is a plan.
"""

from __future__ import annotations

import os
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Source(Protocol):
    def find(self, name: str) -> DataFrame | None: ...


class Frames:
    """DataFrames under names."""

    def __init__(self, frames: dict[str, DataFrame]) -> None:
        self.frames = dict(frames)

    def find(self, name: str) -> DataFrame | None:
        return self.frames.get(name)


class ParquetFolder:
    """<folder>/<name>.parquet, a file or a directory."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        if "://" not in path:
            return os.path.exists(path)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def find(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}.parquet"
        return self.spark.read.parquet(path) if name.replace("_", "").isalnum() and self._exists(path) else None


class SessionTables:
    """Tables and views of the Spark session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def find(self, name: str) -> DataFrame | None:
        return self.spark.table(name) if self.spark.catalog.tableExists(name) else None


class Sources:
    def __init__(self, *sources: Source) -> None:
        self.sources = list(sources)

    def find(self, name: str) -> DataFrame | None:
        bare = name.split(":", 1)[-1]
        for s in self.sources:
            if (df := s.find(name)) is not None or (bare != name and (df := s.find(bare)) is not None):
                return df
        return None

    def table(self, name: str) -> DataFrame:
        df = self.find(name)
        if df is None:
            raise LookupError(f"Table '{name}' does not exist.")
        return df
