"""Where queries that write put their files: below the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for every call below ``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or tempfile.gettempdir()).rstrip('/')}/florin-files-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
