"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # AQE splits a hot join key over several tasks, and turns a join side that
    # proved small into a broadcast.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join whose build side proved to fit this size in every partition is hashed
    # instead of sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Checkpoint files go once no frame refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.checkpoint.compress": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app_name: str = "shoplytic") -> SparkSession.Builder:
    """A session builder with the settings above; add master and sizes yourself."""
    build = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    return build


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without one: it has a single machine, so a
    temporary folder is as shared as any other.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shoplytic-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so later reads repeat no work."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
