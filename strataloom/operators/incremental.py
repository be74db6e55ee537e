"""Incremental maintenance: content hashes, dependency fingerprints, what is stale, state upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashes(files: DataFrame) -> DataFrame:
    """path, hash: SHA-1 of the bytes."""
    return files.select("path", F.sha1(F.col("content").cast("binary")).alias("hash"))


def status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, status: unchanged, changed, new or deleted, by path and hash."""
    both = current.select("path", F.col("hash").alias("now")).join(stored.select("path", F.col("hash").alias("was")), "path", "full")
    kind = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return both.select("path", kind.alias("status"))


def fingerprints(edges: DataFrame, current: DataFrame) -> DataFrame:
    """path, dep, hash: the hashes of a file's direct dependencies, those without a hash left out."""
    own = edges.select(F.col("src").alias("path"), F.col("dst").alias("dep")).distinct()
    return own.join(current.select(F.col("path").alias("dep"), "hash"), "dep").select("path", "dep", "hash")


def stale_dependencies(now: DataFrame, stored: DataFrame, known: DataFrame) -> DataFrame:
    """path, stale of every path in known: whether its fingerprint (path, dep, hash rows) differs from the stored one.

    known lists the files with a stored fingerprint, empty ones too; a file without one is not stale. One hop only.
    """
    a, b = now.withColumnRenamed("hash", "now"), stored.withColumnRenamed("hash", "was")
    differs = a.join(b, ["path", "dep"], "full").where(~F.col("now").eqNullSafe(F.col("was"))).select("path").distinct().withColumn("differs", F.lit(True))
    return known.join(differs, "path", "left").select("path", F.coalesce("differs", F.lit(False)).alias("stale"))


def cache_hits(state: DataFrame, stale: DataFrame, forced: DataFrame | None = None, force: bool = False) -> DataFrame:
    """path, hit: unchanged, no stale dependency, not forced."""
    out = state.join(stale, "path", "left").withColumn("hit", (F.col("status") == "unchanged") & ~F.coalesce("stale", F.lit(False)) & F.lit(not force))
    if forced is not None:
        out = out.join(forced.select("path", F.lit(True).alias("must")), "path", "left").withColumn("hit", F.col("hit") & F.col("must").isNull()).drop("must")
    return out.select("path", "hit")


def upserted(old: DataFrame, fresh: DataFrame, key: str = "path", present: DataFrame | None = None) -> DataFrame:
    """fresh over old by key, other rows kept; with present, those of files that are gone are purged."""
    kept = old.join(fresh.select(key), key, "left_anti")
    if present is not None:
        kept = kept.join(present.select(key), key, "left_semi")
    return kept.unionByName(fresh)


def bootstrapped(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored fingerprint rows, and the current ones of files that had none."""
    return stored.unionByName(current.join(stored.select("path").distinct(), "path", "left_anti"))


def update_set(index: DataFrame) -> DataFrame:
    """The paths that an update of stale notes reprocesses."""
    return index.where("stale").select("path")


def dry_run(plan: DataFrame) -> DataFrame:
    """write, skip, llm: what a run would do to the rows of plan (hit, uses_llm)."""
    return plan.agg(F.count_if(~F.col("hit")).alias("write"), F.count_if("hit").alias("skip"), F.count_if(~F.col("hit") & F.col("uses_llm")).alias("llm"))
