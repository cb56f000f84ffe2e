"""Session settings that the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: UTC makes timestamps comparable with naive ones; AQE splits skewed joins and sizes the shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "chirplake", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with ``SETTINGS``; a master or partition count only where the caller (not the cluster) decides them."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | conf)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables between steps: ``spark.checkpoint.dir``; where it is unset, a folder of this machine if it runs the whole session, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='chirplake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpoints(spark: SparkSession) -> SparkSession:
    """The session, able to checkpoint into its shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return spark


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt anew by a hash of columns: a small file is one task's, however much work each of its rows is.  The number is given, so AQE doesn't join the parts again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def ship_library(spark: SparkSession) -> None:
    """Python workers started by this session find the library where the driver found it."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
