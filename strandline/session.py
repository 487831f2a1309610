"""Session settings that every plan here assumes: UTC, AQE, explicit shuffle width, small tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's settings are used as they are."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandline")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Where the submitter names no size: bytes of shuffle files that AQE gives a task when it merges partitions.
ADVISORY = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
#: Likewise: partitions of a shuffle before AQE merges them, and bytes of files that a task reads.
NARROW = dict([ADVISORY, ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "2000"), ("spark.sql.files.maxPartitionBytes", "16m")])


def narrow_tasks(spark: SparkSession) -> SparkSession:
    """The session, with small tasks wherever the submitter has not set their size.

    AQE merges by the bytes of shuffle files. Rows of a few keys compress to some four bytes each, so 64 MB, Spark's own
    size, are 15 million rows and gigabytes in a task's hash table. Merging only makes partitions larger, so there must
    be many to begin with, or a task grows with the input; and 128 MB of files hold as many rows for a partial aggregate.
    """
    for key, size in NARROW.items():
        if spark.conf.get(key, "1") == "1":  # not set
            spark.conf.set(key, size)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local session may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"/tmp/strandline-{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df materialised in the shared checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
