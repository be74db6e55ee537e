"""Column expressions and small plans over text: tagged comments, extractions, keywords, list merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), line: a row for each line."""
    return df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def comment_tag(line: Column, marker: str = "//") -> Column:
    """The tag of a comment line, null without one. // wants a colon or white space after invariant and decision words."""
    out = F.lit(None).cast("string")
    for tag, words in reversed(rules.COMMENT_TAGS):
        after = r"(:|\s)" if marker == "//" and tag in ("invariant", "decision") else r"([^0-9A-Za-z_]|$)"
        out = F.when(line.rlike(f"(?i){marker}(.*[^0-9A-Za-z_])?({words}){after}"), tag).otherwise(out)
    return out


def tagged_comments(df: DataFrame, key: str, text: str, marker: str = "//") -> DataFrame:
    """key, pos, tag, comment of all tagged comment lines."""
    own = lines(df, key, text).withColumn("line", F.trim("line")).withColumn("tag", comment_tag(F.col("line"), marker))
    return own.where("tag IS NOT NULL").select(key, "pos", "tag", F.trim(F.regexp_replace("line", f"^.*?{marker}+\\s*", "")).alias("comment"))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of all matches, each once, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def env_vars(text: Column) -> Column:
    return found(text, r"process\.env\.([A-Z_][A-Z0-9_]*)")


def api_calls(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Called addresses by each pattern in turn, each once."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (*rules.API_CALLS, *more)))))


def has_side_effects(imports: Column, more: tuple[str, ...] = ()) -> Column:
    parts = list(dict.fromkeys(p.lower() for p in (*rules.SIDE_EFFECT_PACKAGES, *more)))
    return F.exists(imports, lambda i: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(i), p)))


def import_labels(imports: Column) -> Column:
    """What the imported packages say a file does, in first-hit order."""

    def of(i: Column) -> Column:
        tests = []
        for label, packages, below in rules.IMPORT_LABELS:
            hit = i.isin(*packages)
            if below:
                hit = hit | F.exists(F.array(*map(F.lit, packages)), lambda p: F.startswith(i, F.concat(p, F.lit("/"))))
            tests.append(F.when(hit, label))
        return F.array_compact(F.array(*tests))

    return F.array_distinct(F.flatten(F.transform(imports, of)))


def is_local_import(specifier: Column) -> Column:
    return specifier.startswith(".") | specifier.startswith("@/") | specifier.startswith("~/")


def validation_package(imports: Column) -> Column:
    return F.get(F.filter(imports, lambda i: F.substring_index(i, "/", 1).isin(*rules.VALIDATION_PACKAGES)), F.lit(0))


def risky_messages(messages: Column) -> Column:
    return F.filter(messages, lambda m: F.lower(m).rlike("|".join(rules.RISKY_WORDS)))


def keyword_hit(text: Column, language: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Whether a text holds a word of its language's list: that of the tag, else of its base tag, else of en."""
    table = F.create_map(*(x for name, own in words.items() for x in (F.lit(name), F.array(*map(F.lit, own)))))
    own = F.coalesce(F.try_element_at(table, language), F.try_element_at(table, F.substring_index(language, "-", 1)), F.try_element_at(table, F.lit("en")))
    return F.exists(own, lambda w: F.contains(F.lower(text), w))


def is_decision(message: Column, language: Column) -> Column:
    return message.rlike(rules.DECISION_PREFIX) | keyword_hit(message, language, rules.DECISION_WORDS)


def diff_report(path: Column, delta: Column, fields: dict[str, tuple[Column, Column]]) -> Column:
    """The report of a changed note: its score's change from a hundredth on, then what each field gained and lost; fields: (added, removed)."""
    signed = F.concat(F.when(delta > 0, "+").otherwise(""), F.format_string("%.2f", delta.cast("double")))
    parts = [F.concat(F.lit("## "), path), F.when(F.abs(delta) >= 0.01, F.concat(F.lit("  score: "), signed))]
    for name, (added, removed) in fields.items():
        listed = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(f"    {mark} "), x))
        own = F.concat(F.array(F.lit(f"  {name}:")), listed("+", added), listed("-", removed))
        parts.append(F.when(F.size(added) + F.size(removed) > 0, F.array_join(own, "\n")))
    return F.concat_ws("\n", *parts)


def bag_minus(left: Column, right: Column) -> Column:
    """What left holds and right does not, with its repeats and order."""
    return F.filter(left, lambda x: ~F.array_contains(right, x))


def merged(own: Column, more: Column) -> Column:
    """own, then what of more is not in it (white space around and case apart)."""
    fold = lambda x: F.lower(F.trim(x))
    return F.concat(own, F.filter(more, lambda x: ~F.exists(own, lambda y: fold(y) == fold(x))))
