"""The folder that driver and executors share, for tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a saved table that a join may send to the driver and from there to all tasks.
FEW_ROWS = 10_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder of the warehouse, which a cluster's machines share, and in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/strataloom-shared"
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="strataloom-")
        found = _own[app]
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in a new folder of the shared one; the folder is deleted when the application ends."""
    folder = f"{shared_dir(spark)}/strataloom/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)  # only a path that is there can be marked
    system.deleteOnExit(path)
    return f"{folder}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, lineage cut, safe against lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join by merge, never broadcast: a saved table of 10 MB is some 60 MB on the driver, and that in every round."""
    return df.hint("merge")


def joined(df: DataFrame) -> DataFrame:
    """A saved table as a side of a join: broadcast up to FEW_ROWS rows, so a small one costs no shuffle of the other side, and merged above."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else merged(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by a hash of keys over all cores, for work in Python whose cost is not told by the size of what it reads.

    A table of a few MB is one split, so one core would do all; adaptive execution leaves this number of partitions as it is.
    """
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(count, *keys)
