"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "offerloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a session whose executors run inside the driver (tests, the bench) may leave the setting empty; it then gets a
    temporary folder. Anything else is an error, as executors would not share such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="offerloom-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder path (not created) inside the shared folder."""
    return os.path.join(work_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors do not replay it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a narrow table (keys and flags) that every executor may hold: some 50 MB.
MOST_BROADCAST = 1_000_000


def checked_broadcast(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows; larger ones join by a shuffle. For stored, narrow tables."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
