"""Access to the input tables and to the shared checkpoint folder; names that do not clash."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is named, a folder of this process if the executors live in it, and an
    error on a cluster, whose executors would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="verdigris-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids that are broadcast at most (8 bytes each); beyond it the same join is a shuffle.
BROADCAST_IDS = 200_000


def few(ids: DataFrame, most: int | None = None) -> DataFrame:
    """Marked for broadcast if a count shows that it is small; left to the planner otherwise."""
    most = BROADCAST_IDS if most is None else most
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def in_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names: inside they go by their places."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def free(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until none of the taken names equals it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
