"""Column expressions over paths."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def glob_regex(pattern: str) -> str:
    """The anchored regex of a glob: **/ any directories or none, ** anything, * within a segment; braces and ? as written."""
    out, at = [], 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out.append("(?:.+/)?")
            at += 3
        elif pattern.startswith("**", at):
            out.append(".*")
            at += 2
        elif pattern[at] == "*":
            out.append("[^/]*")
            at += 1
        else:
            out.append(pattern[at] if pattern[at] == "?" else re.escape(pattern[at]))
            at += 1
    return "^" + "".join(out) + "$"


def any_glob(path: Column, patterns) -> Column:
    """Whether a path matches one of the globs."""
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last slash; "." where there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """The last dot of the name and what follows; "" without one, or where the name starts with its only dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def relative(path: Column, root: str) -> Column:
    """path below root; others pass."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def normalised(path: Column) -> Column:
    """A relative path without "." and ".." segments; ".." that lead out of the root stay."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.get(done, F.size(done) - 1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(folded, "/")


def domain(path: Column) -> Column:
    """Two segments below the directories that hold domains, else the first; "." for a file in the root."""
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    return F.when(F.size(parts) == 1, F.lit(".")).when(first.isin(*rules.DOMAIN_ROOTS), F.concat_ws("/", first, F.get(parts, F.lit(1)))).otherwise(first)


def _first_match(pairs, otherwise: Column, test) -> Column:
    return functools.reduce(lambda rest, pair: F.when(test(pair), pair[0]).otherwise(rest), reversed(pairs), otherwise)


def category(path: Column) -> Column:
    """What kind of file a path names, from the path alone."""
    own = F.replace(path, F.lit("\\"), F.lit("/"))
    return _first_match(rules.PATH_CATEGORIES, F.lit("aux"), lambda pair: own.rlike(pair[1]))


def is_skipped(category_: Column) -> Column:
    return category_.startswith("skip:")


def is_source(category_: Column) -> Column:
    return category_.isin(*rules.SOURCE_CATEGORIES)


def filename_label(path: Column) -> Column:
    """What a file's name says it is; null where nothing."""
    pairs = [(label, pattern) for pattern, label in rules.FILENAME_LABELS]
    return _first_match(pairs, F.lit(None).cast("string"), lambda pair: path.rlike(pair[1]) | basename(path).rlike(pair[1]))
