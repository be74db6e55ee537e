"""The index over notes: entries, header, domains, statistics, ranked look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scoring import SCORE


def is_stale(generated_at, now, days: int = 30):
    """Older than so many days, strictly. now is a parameter: nothing here reads a clock."""
    return generated_at < now - F.expr(f"make_dt_interval({int(days)})")


def entries(notes: DataFrame, consumers: DataFrame, now, days: int = 30) -> DataFrame:
    """path, domain, score, model, purpose, generated_at, stale, dependents of each note (path, score, model, purpose_observed, purpose_inferred, generated_at).

    The purpose is the first inferred, else the first observed, else empty.
    """
    purpose = F.coalesce(F.get("purpose_inferred", F.lit(0)), F.get("purpose_observed", F.lit(0)), F.lit(""))
    none = F.array().cast("array<string>")
    own = notes.join(consumers.select(F.col("node").alias("path"), F.col("consumers").alias("dependents")), "path", "left")
    return own.select("path", paths.domain(F.col("path")).alias("domain"), "score", "model", purpose.alias("purpose"), "generated_at", is_stale(F.col("generated_at"), now, days).alias("stale"), F.coalesce(F.array_distinct("dependents"), none).alias("dependents"))


def header(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("model") != "static").alias("synthesized_files"), F.count_if("stale").alias("stale_files"))


def ranked(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc("score"), "path")


def at_least(index: DataFrame, threshold: float = 0.5, limit: int = 20) -> DataFrame:
    """The first entries by score from a threshold on: one pass that keeps the top of each task."""
    return ranked(index.where(F.col("score") >= F.lit(threshold))).limit(limit)


def of_domain(index: DataFrame, name: str) -> DataFrame:
    return ranked(index.where(F.col("domain") == name))


def domain_summary(index: DataFrame, name: str) -> DataFrame:
    """domain, files, average (to two decimals) of one domain."""
    own = index.where(F.col("domain") == name)
    return own.agg(F.lit(name).alias("domain"), F.count(F.lit(1)).alias("files"), F.round(F.sum("score") / F.count(F.lit(1)), 2).alias("average"))


def totals(index: DataFrame) -> DataFrame:
    """total_files, stale_files, average (to two decimals; null of an empty index)."""
    return index.agg(F.count(F.lit(1)).alias("total_files"), F.count_if("stale").alias("stale_files"), F.round(F.sum("score") / F.count(F.lit(1)), 2).alias("average"))


def domains(index: DataFrame) -> DataFrame:
    """domain, files, score_sum, score_max, rank (by average score); averages are left as sum and count, which are exact."""
    own = index.groupBy("domain").agg(F.count(F.lit(1)).alias("files"), F.sum("score").alias("score_sum"), F.max("score").alias("score_max"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("score_sum").cast("double") / F.col("files")), "domain")))


def grouped(index: DataFrame) -> DataFrame:
    """Entries with their domain's best score, in the order of a grouped list."""
    best = F.max("score").over(Window.partitionBy("domain"))
    return index.withColumn("domain_best", best).orderBy(F.desc("domain_best"), "domain", F.desc("score"), "path")


def sidebar(index: DataFrame, least: float = 0.0, query: str = "") -> DataFrame:
    return grouped(index.where((F.col("score") >= least) & F.contains(F.lower("path"), F.lit(query.lower()))))


def repo_stats(notes: DataFrame) -> DataFrame:
    """total, with_tests, without_tests, coverage_sum, coverage_files of notes with signals (has_tests not null)."""
    own = notes.where("has_tests IS NOT NULL")
    return own.agg(F.count(F.lit(1)).alias("total"), F.count_if("has_tests").alias("with_tests"), F.count_if(~F.col("has_tests")).alias("without_tests"), F.sum("coverage_pct").alias("coverage_sum"), F.count("coverage_pct").alias("coverage_files"))


def graph_nodes(files: DataFrame, index: DataFrame) -> DataFrame:
    """path, domain, score of the graph's files; without an entry the directory is the domain and the score 0."""
    own = files.join(index.select("path", "domain", "score"), "path", "left")
    return own.select("path", F.coalesce("domain", paths.dirname(F.col("path"))).alias("domain"), F.coalesce("score", F.lit(0).cast(SCORE)).alias("score"))


def quota(candidates: DataFrame, most: int = 8) -> DataFrame:
    """The added source files that are synthesised whatever their score: the first by consumers (columns path, edit, consumers)."""
    kind = paths.category(F.col("path"))
    return candidates.where((F.col("edit") == "added") & paths.is_source(kind)).orderBy(F.desc("consumers"), "path").limit(most)


def markdown(index: DataFrame) -> DataFrame:
    """domain, best, score, path, text: the lines of the index in order, a heading (path is null) for each domain and below it its files by score.

    A line is a row, so neither a domain nor the whole is ever one row or one task: the order is a range sort, which a large domain is split by too.
    """
    domains = index.groupBy("domain").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    average = F.round(F.col("total") / F.col("n"), 2).cast("string")
    heads = domains.select("domain", "best", F.lit(None).cast(index.schema["score"].dataType).alias("score"), F.lit(None).cast("string").alias("path"), F.concat(F.lit("## "), "domain", F.lit(" — "), F.col("n").cast("string"), F.lit(" files, average "), average).alias("text"))
    line = F.concat(F.lit("- `"), "path", F.lit("` ("), F.col("score").cast("string"), F.lit(") "), F.coalesce(F.left("purpose", F.lit(80)), F.lit("")))
    files = index.select("domain", "score", "path", line.alias("text")).join(domains.select("domain", "best"), "domain").select(*heads.columns)
    return heads.unionByName(files).orderBy(F.desc("best"), "domain", F.desc_nulls_first("score"), F.asc_nulls_first("path"))
