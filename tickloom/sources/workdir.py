"""Where jobs keep intermediate tables, checkpoints and stream state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from the session.

    Only a session whose executors are threads of this machine may fall back
    to a temporary folder.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: worked out once, whatever is read of it how often."""
    path = new_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
