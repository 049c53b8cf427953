"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new path under spark.checkpoint.dir; only where that is unset, as in tests, under a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="resonant-scratch-"))
        named = _OWN[0]
    return f"{named.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
