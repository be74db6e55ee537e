"""Repository files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, rules


def scanned(files: DataFrame, include=rules.DEFAULT_INCLUDE, exclude=rules.DEFAULT_EXCLUDE) -> DataFrame:
    """The files whose path matches an include glob and no exclude glob, no hidden segment, each path once."""
    path = F.col("path")
    hidden = path.rlike(r"(^|/)\.")
    return files.where(paths.any_glob(path, include) & ~paths.any_glob(path, exclude) & ~hidden).dropDuplicates(["path"])


def scan_repository(spark: SparkSession, root: str, include=rules.DEFAULT_INCLUDE, exclude=rules.DEFAULT_EXCLUDE) -> DataFrame:
    """path, extension, size, content, hash of a repository's files.

    Globs act on the path before content is selected, so files that are left out are listed and not read. What is no UTF-8 in a
    file becomes replacement characters.
    """
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    home = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    named = own.select(paths.relative(F.regexp_replace("path", "^file:/+", "file:/"), home.replace("file:///", "file:/")).alias("path"), "length", "content")
    kept = scanned(named, include, exclude)
    return kept.select("path", paths.extension(F.col("path")).alias("extension"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha1("content").alias("hash"))


def by_path(files: DataFrame) -> DataFrame:
    """Files in the order of their paths as people sort them (Unicode collation), not by code points."""
    return files.orderBy(F.collate("path", "UNICODE"), "path")


def listing(files: DataFrame) -> DataFrame:
    """A JSON object for each file of a scan, by path."""
    return by_path(files.select("path", "extension", "size")).select(F.to_json(F.struct("path", "extension", "size")).alias("value"))
