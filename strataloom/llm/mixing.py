"""Mixing sources to target weights.

Tokens are summed for each source; shares of a total follow the weights, no source above a cap, what is cut off is shared
again by weight (water filling, solved in closed form); a source's repetition rate is its target over its size. Each document
is taken floor(rate) times and once more if a number hashed from a seed and its doc_id lies below the rate's fraction.

Defined results: a null source is a source of its own, after all others; a null or empty text has size 0; a source of size 0
has target 0 and rate 0; rows that repeat a doc_id share their hashed number; an empty table gives an empty result;
other columns are handed on as they are, whatever their names. All of it is DataFrame operations; sources are ranked in one task, which holds a row for each source, never for a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: White space that ends a word, as a regex: space and U+0009 to U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ ; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    outer = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - outer).cast("long")


def hashed_unit(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that seed and doc_id decide: 52 bits of MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, rate of sizes (source, source_size), a row for each source.

    With sources in the order of cap over weight, the level after the first k are cut off at their caps is what is left of
    the total over the weights left; the first k whose level does not pass the next source's own cap is right for all.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(total_share))
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    fits = F.when(level <= F.col("most") / F.col("weight"), level)
    level_all = weighed.withColumn("level", fits).withColumn("level", F.first("level", ignorenulls=True).over(whole))
    target = F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("level"), F.col("most")))
    done = level_all.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return done.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(hashed_unit(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **law) -> DataFrame:
    """docs with one column more, the last: a struct of size, source_size, target, rate, copies.

    It is called mix, with underscores after it as long as docs has a column of that name; the columns of docs stay as they are.
    The table of sources meets the documents by a join that Spark may broadcast where it is small; where it is not, a hot
    source's rows are dealt anew by adaptive execution, as nothing else needs them together.
    """
    mix, size, key = common.free_names(docs, "mix", "mix_size", "mix_source")
    sums = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    by = targets(sums, **law).select(F.col("source").alias(key), F.struct("source_size", "target", "rate").alias(mix))
    found = docs.withColumn(size, word_count(F.col(text))).join(by, F.col(source).eqNullSafe(F.col(key)))
    parts = F.struct(F.col(size).alias("size"), f"{mix}.source_size", f"{mix}.target", f"{mix}.rate", copies(F.col(f"{mix}.rate"), F.col(doc_id)).alias("copies"))
    return found.select(*common.own_columns(docs), parts.alias(mix))


def emitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **law) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs as they are."""
    found = mixed(docs, doc_id, text, source, **law)
    mix = found.columns[-1]
    (copy,) = common.free_names(found, "copy")
    taken = found.where(F.col(f"{mix}.copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{mix}.copies"))))
    return taken.select(*common.own_columns(docs))
