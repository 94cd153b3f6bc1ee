"""Session helpers: a local session for tests and benches, and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def local_session(app: str = "lakegauge", cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        # recording the Python line of every expression costs more than planning small queries
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


@lru_cache
def _local_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="lakegauge-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: spark.checkpoint.dir of the session.

    Only a local session that sets none (a test run) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir(context.applicationId)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes working files that nothing reads any more."""
    context = spark.sparkContext
    for p in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
