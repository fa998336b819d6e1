"""What a session needs before it runs loomwork's operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows and bytes that Python workers get at a time, where the session names no other numbers: rows may hold whole documents.
BATCH_ROWS, BATCH_BYTES = 1000, 16 * 2**20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Python workers give freed memory back rather than keep it for the next task.
_THRIFTY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1000000"}


def ready(spark: SparkSession) -> SparkSession:
    """Sets up Python workers: they find this package at the driver's path, take small batches and keep little memory.

    On clusters without the package at that path, ship it with --py-files.
    """
    env = spark.sparkContext.environment
    for name, value in _THRIFTY.items():
        env.setdefault(name, value)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.isModifiable(_BYTES) and spark.conf.get(_BYTES) == "67108864b":
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in paths if p]])
    return spark
