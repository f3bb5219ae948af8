"""What Python workers need."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started from."""
    here, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *(p for p in paths if p)])


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name where all machines can write: below ``spark.checkpoint.dir``, on one machine below a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="threadmill-")
        _OWN[spark.sparkContext.applicationId] = at
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
