"""What iterative operators keep between rounds, in the folder that the cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package, even where only the driver's path holds it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset in local mode, as in tests, a temporary folder, and elsewhere an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "/tmp/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{folder(spark)}/lumenframe-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed: its lineage is cut, and a lost executor costs nothing."""
    folder(df.sparkSession)
    return df.checkpoint()
