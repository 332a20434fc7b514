"""A folder that every executor and the driver see, for tables that a job writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under ``spark.checkpoint.dir``; where that is unset, under the warehouse, and on a local master in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"
