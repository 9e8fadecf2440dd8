"""Tables between steps in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder of this application's own where the master is local and it is unset.

    On a cluster each executor would write into a folder of its own, so an unset spark.checkpoint.dir is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {master})")
        path = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tribuna-"))
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Written as Parquet and read back: a short plan, computed once, safe against lost executors. rows_a_file bounds files of large rows."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("maxRecordsPerFile", rows_a_file) if rows_a_file else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one run of one step."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
