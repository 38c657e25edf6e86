"""A folder that the driver and all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, beside the tables, or on a local master a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="spark-")
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{label}-{uuid.uuid4().hex}"
