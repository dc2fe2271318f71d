"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; under a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared folder, so that what reads it several times does not make it again."""
    work_folder(df.sparkSession, "checkpoints")
    return df.checkpoint()
