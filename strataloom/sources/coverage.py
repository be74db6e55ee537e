"""Coverage reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def lcov(reports: DataFrame) -> DataFrame:
    """path, coverage_pct of LCOV texts (value): LH over LF of each record; without lines no row, of several records the last."""
    record = reports.select(F.posexplode(F.split("value", "end_of_record")).alias("pos", "r"))
    number = lambda tag: F.regexp_extract("r", rf"(?m)^{tag}:(\d+)", 1).try_cast("double")
    own = record.select("pos", F.trim(F.regexp_extract("r", r"(?m)^SF:(.+)$", 1)).alias("path"), number("LF").alias("lf"), F.coalesce(number("LH"), F.lit(0.0)).alias("lh"))
    return own.where((F.col("path") != "") & (F.col("lf") > 0)).groupBy("path").agg(F.max_by(F.col("lh") / F.col("lf"), "pos").alias("coverage_pct"))


def coverage(files: DataFrame, root: str = ".") -> DataFrame:
    """path, coverage_pct from the reports among files (path, content): the LCOV report if there is one, else the JSON summary.

    Paths below root are made relative. An LCOV report that holds nothing usable gives nothing: the summary is not asked then.
    """
    tracefile = files.where("path = 'coverage/lcov.info'").select(F.col("content").alias("value"))
    json_file = files.where("path = 'coverage/coverage-summary.json'").select(F.col("content").alias("value"))
    there = tracefile.agg((F.count(F.lit(1)) > 0).alias("there"))
    instead = summary(json_file).crossJoin(F.broadcast(there)).where(~F.col("there")).drop("there")  # one row
    return lcov(tracefile).unionByName(instead).select(paths.relative(F.col("path"), root).alias("path"), "coverage_pct")


def summary(reports: DataFrame) -> DataFrame:
    """path, coverage_pct of JSON summaries (value): lines.pct of each file as a ratio, the total left out."""
    shape = "map<string,struct<lines:struct<pct:double>>>"
    own = reports.select(F.explode(F.from_json("value", shape)).alias("path", "s"))
    return own.where((F.col("path") != "total") & F.col("s.lines.pct").isNotNull()).select("path", (F.col("s.lines.pct") / 100).alias("coverage_pct"))
