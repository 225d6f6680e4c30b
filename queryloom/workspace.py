"""Folders that all nodes of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where nothing names any and all is one machine (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("On a cluster spark.checkpoint.dir must name a shared folder.")
        return tempfile.mkdtemp(prefix=f"queryloom-{name}-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
