"""Folders that the driver and all executors share, for tables written between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, what: str) -> str:
    """A new folder: where spark.checkpoint.dir or the checkpoint folder names, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
