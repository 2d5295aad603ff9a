"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset a local run gets a temporary folder, and on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            folder = _own[context.applicationId] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = f"file://{_own[context.applicationId]}"
    return f"{at.rstrip('/')}/tessera/{uuid.uuid4().hex}/{label}"
