"""Governance documents, stored notes and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.storage import saved


def governance_docs(files: DataFrame) -> DataFrame:
    """path, category, content (cut) of the well-known documents among files (path, content)."""
    path = F.col("path")
    kind = F.lit(None).cast("string")
    for name, category in reversed(rules.GOVERNANCE_PATHS):
        hit = path.rlike(f"^{name}[^/]+\\.(md|yaml|yml)$") if name.endswith("/") else path == name
        kind = F.when(hit, category).otherwise(kind)
    return files.select("path", kind.alias("category"), F.left("content", F.lit(rules.DOCUMENT_CHARS)).alias("content")).where("category IS NOT NULL")


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table; where there is none or it cannot be read, an empty one."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    if own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own):
        found = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
        return found.where(F.col(found.columns[0]).isNotNull())
    return spark.createDataFrame([], schema)


def notes(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Notes of JSON files, and the ones that could not be read (value)."""
    read = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    own = saved(read.option("multiLine", True).option("recursiveFileLookup", True).json(path), "notes")
    return own.where("_corrupt IS NULL").drop("_corrupt"), own.where("_corrupt IS NOT NULL").select(F.col("_corrupt").alias("value"))


def edges_or_dependents(edges: DataFrame | None, index: DataFrame) -> DataFrame:
    """src, dst from the edge table, or else from the index's lists of dependents."""
    if edges is not None:
        return edges.select("src", "dst")
    return index.select(F.explode("dependents").alias("src"), F.col("path").alias("dst"))
