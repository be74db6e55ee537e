"""Scores as column expressions. All are whole hundredths; a score is a DECIMAL(6,2) made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths, rules

SCORE = "decimal(6,2)"


def as_score(points: Column) -> Column:
    return (points.cast("decimal(6,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(SCORE)


def cochange_points(most: Column, churn: Column) -> Column:
    """15 from a ratio of 0.6 and 3 commits in common, 10 from 0.4 and 2; ratios compared as whole numbers."""
    per = F.greatest(churn, F.lit(1))
    return F.when((10 * most >= 6 * per) & (most >= 3), 15).when((10 * most >= 4 * per) & (most >= 2), 10).otherwise(0)


#: Term, its most points.
TERMS = (("consumers", 40), ("hooks", 20), ("external_imports", 10), ("env_vars", 10), ("api_calls", 10), ("todo_comments", 5), ("untested", 15), ("churn", 15), ("authors", 5), ("co_change", 15))


def terms() -> dict[str, Column]:
    """Points of each term from the columns consumers, has_hooks, has_external_imports, has_env_vars, has_api_calls, has_todo_comments, has_tests, churn, authors, max_cochange."""
    yes = lambda name, points: F.when(F.col(name), points).otherwise(0)
    return {
        "consumers": F.least(10 * F.col("consumers"), F.lit(40)),
        "hooks": yes("has_hooks", 20),
        "external_imports": yes("has_external_imports", 10),
        "env_vars": yes("has_env_vars", 10),
        "api_calls": yes("has_api_calls", 10),
        "todo_comments": yes("has_todo_comments", 5),
        "untested": F.when(F.col("has_tests"), 0).when(F.col("consumers") > 0, 15).otherwise(5),
        "churn": F.least(F.col("churn"), F.lit(15)),
        "authors": F.when(F.col("authors") > 3, 5).otherwise(0),
        "co_change": cochange_points(F.col("max_cochange"), F.col("churn")),
    }


def criticality_points() -> Column:
    own = list(terms().values())
    return F.least(sum(own[1:], own[0]), F.lit(100)).cast("long")


def breakdown() -> Column:
    """An array of (term, points, most) to explode; its points may sum to more than the capped score."""
    own = terms()
    return F.array(*(F.struct(F.lit(name).alias("term"), own[name].cast("long").alias("points"), F.lit(most).cast("long").alias("most")) for name, most in TERMS))


def badge(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "mid").otherwise("low")


def boost_points(category: Column, edit: Column) -> Column:
    """Hundredths added for an edit (added, modified, else none) and a category; 0 where the category is skipped."""
    source = paths.is_source(category)
    by_edit = F.lit(0)
    for name, (own, other) in rules.EDIT_BOOST.items():
        by_edit = F.when(edit == name, F.when(source, own).otherwise(other)).otherwise(by_edit)
    by_type = F.lit(0)
    for name, points in rules.TYPE_BOOST.items():
        by_type = F.when(category == name, points).otherwise(by_type)
    return F.when(paths.is_skipped(category), 0).otherwise(by_edit + by_type).cast("long")


def synthesis_gate(has_provider: Column, skipped: Column, boosted: Column, threshold: float, forced: Column) -> Column:
    """Whether a file goes to the language model."""
    return has_provider & ~skipped & ((boosted >= threshold) | forced)


def is_hotspot(score: Column, dependents: Column, tested: Column) -> Column:
    return (score >= 0.6) & (dependents >= 5) & ~tested


def cross_signals() -> Column:
    """Facts (fixed values: results depend on the sentences) that only several signals together show, from consumers, has_tests, coverage_pct, has_env_vars, churn, authors, has_side_effects."""
    n = F.col("consumers")
    return F.array_compact(
        F.array(
            F.when((n >= 1) & ~F.col("has_tests"), F.concat(F.lit("Consumed by "), n.cast("string"), F.when(n == 1, " file").otherwise(" files"), F.lit(" but has no related tests — changes propagate untested"))),
            F.when((n >= 3) & (F.col("coverage_pct") < 0.5), F.concat(n.cast("string"), F.lit(" consumers with low coverage ("), F.round(F.col("coverage_pct") * 100).cast("int").cast("string"), F.lit("%) — high regression blast radius"))),
            F.when(F.col("has_env_vars") & ~F.col("has_tests"), F.lit("Depends on env vars but has no related tests — behavior changes silently by environment")),
            F.when((F.col("churn") >= 10) & (F.col("authors") >= 3), F.concat(F.lit("Volatile: "), F.col("churn").cast("string"), F.lit(" recent commits by "), F.col("authors").cast("string"), F.lit(" authors — expect conflicts and drift"))),
            F.when(F.col("has_side_effects") & (n >= 2), F.concat(F.lit("Importing this module runs side effects at load time — every one of the "), n.cast("string"), F.lit(" consumers triggers them"))),
        )
    )
