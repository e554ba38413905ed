"""Shared folders for what a job keeps between its stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the cluster names for checkpoints, by its setting or by its context. Only a local master may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if of_context.isDefined():
        return of_context.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return None


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files: in the shared folder, or a temporary one where a local session names none (tests)."""
    shared = shared_folder(spark)
    return f"{shared}/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"{name}-")


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
