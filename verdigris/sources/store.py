"""The folder that the driver and all executors share, and rows that are written to it once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named, one of this process if the executors live in it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="verdigris-"))
    return sc.getCheckpointDir()


def keep(rows: DataFrame) -> DataFrame:
    """The same rows, worked out once: later plans read them from the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"
