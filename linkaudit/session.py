"""Settings an audit needs from the Spark session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a session without one gets an error.

    Other executors cannot read a machine-local folder, so none is made up here. Programs that
    run on one machine can call ``local_checkpoint_dir`` first.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured)
    return configured


def local_checkpoint_dir(spark: SparkSession) -> None:
    """Name a temporary folder for a session in one process that has no checkpoint folder yet."""
    context = spark.sparkContext
    unset = not context.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None)
    if unset and context.master.startswith("local[") or unset and context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkaudit-checkpoint-"))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write shuffles goes from the disks as soon as it ends.

    Without it Spark keeps these files until the driver happens to collect its garbage, so that the steps of a long query add up. A table
    that is written and read again needs none of them. Versions of Spark without the setting keep the files.
    """
    before = spark.conf.get(_DROPPED, None)
    spark.conf.set(_DROPPED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROPPED)
        else:
            spark.conf.set(_DROPPED, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    Iterations and tables that several passes share go through here: what they need survives
    the loss of executors, and plans stay short.
    """
    checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, whose shuffles nothing else reads


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table beside the checkpoints and read it from there.

    For tables that several passes read a few columns of; like a checkpoint it outlives executors and cuts the plan, and the
    next plan knows its size. The order of rows is not kept.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/linkaudit-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
