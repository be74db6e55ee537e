"""Signals of commit history, from one bulk table of (file, commit) rows instead of a query for each file."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import joined, saved

TOP = 10
#: Files of a commit that are paired at once.
PIECE = 1_000
#: Rows of a file above which its pairs are dealt by the other file as well, and into how many parts.
HOT, HOT_PARTS = 1_000_000, 64
#: Buckets of hashes that rows are counted by to find what comes often.
BUCKETS = 1 << 20
#: Pairs, and names, that a task holds at most before it gives out their sums.
MOST_PAIRS, MOST_NAMES = 4_000_000, 500_000


def churn(commits: DataFrame) -> DataFrame:
    """file, churn, authors: how many commits touch a file, by how many authors."""
    return commits.groupBy("file").agg(F.countDistinct("commit").alias("churn"), F.countDistinct("author").alias("authors"))


def recent(commits: DataFrame, keep: int = TOP) -> DataFrame:
    """The newest commits of each file with their rank; ties by commit, message, author. The rank limit is pushed below the shuffle."""
    return commits.withColumn("rank", F.row_number().over(newest_first())).where(F.col("rank") <= keep)


def newest_first():
    return Window.partitionBy("file").orderBy(F.desc("at"), F.desc("commit"), F.desc("message"), F.desc("author"))


def distinct_rows(commits: DataFrame, most_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """file, commit, each once, and commit, k, pieces of the commits of more than PIECE files."""
    own = commits.select("file", "commit").distinct()
    sizes = own.groupBy("commit").agg(F.count(F.lit(1)).alias("k"))
    if most_files is not None:
        sizes = sizes.where(F.col("k") <= most_files)
        own = own.join(sizes.select("commit"), "commit", "left_semi")
    return own, saved(sizes.where(F.col("k") > PIECE).withColumn("pieces", F.ceil(F.col("k") / PIECE).cast("int")), "large")


def pair_counts(commits: DataFrame, most_files: int | None = None) -> DataFrame:
    """file, other, n: how many commits touch both, for each ordered pair.

    A self-join makes each unordered pair of a commit once, so a commit of k files makes k (k - 1) / 2 rows; they are summed
    before they are mirrored. A commit of more than PIECE files is cut into pieces, and each pair of pieces is a key of the
    join of its own, so a task has the pairs of two pieces at most. most_files (off by default) leaves out commits of more
    files than that, as bulk renames are.
    """
    own, large = distinct_rows(commits, most_files)
    cut = own.join(large.select("commit", "pieces"), "commit", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("file"), F.col("pieces")).cast("int"))
    last = F.col("pieces") - 1
    left = cut.select("commit", "file", F.col("piece").alias("a"), F.explode(F.sequence("piece", last)).alias("b"))
    right = cut.select("commit", F.col("file").alias("other"), F.explode(F.sequence(F.lit(0), "piece")).alias("a"), F.col("piece").alias("b"))
    pairs = left.join(right, ["commit", "a", "b"]).where((F.col("a") < F.col("b")) | (F.col("file") < F.col("other")))
    return mirrored(summed(pairs))


def summed(pairs: DataFrame) -> DataFrame:
    """file, other, n: how often each unordered pair comes, the lesser name first."""
    return pairs.groupBy(F.least("file", "other").alias("file"), F.greatest("file", "other").alias("other")).agg(F.count(F.lit(1)).alias("n"))


def mirrored(counted: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct("file", "other"), F.struct(F.col("other").alias("file"), F.col("file").alias("other"))))
    return counted.select(both.alias("p"), "n").select("p.file", "p.other", "n")


def best_pairs(commits: DataFrame, keep: int, most_files: int | None = None, own: bool = False) -> DataFrame:
    """file, other, n of pair_counts, of which the first `keep` of each file by n, ties by name, are among the rows; others may be left out.

    own: with a row for each file paired with itself, whose n is how many commits touch it.

    Pairs that share a commit of at most PIECE files are all made. Of those that share larger commits only, a file needs its
    first ones. Files in the same larger commits are a class; classes that share such a commit are paired, and of each the
    first keep + 1 names count for the other (one may be the file itself), of all classes together the first keep + 1. A name
    left out has keep others before it, whose n can but be greater for the smaller commits they share with the file as well.
    """
    rows = (commits.select("file", "commit") if most_files is None else distinct_rows(commits, most_files)[0]).where("file IS NOT NULL AND commit IS NOT NULL")
    large = large_commits(rows)
    if large is None:
        return counted_pairs(rows, own)
    few = large.count() <= 2_000
    within = rows.distinct().join(F.broadcast(large.select("commit")) if few else large.select("commit"), "commit", "left_semi")
    kinds = saved(within.groupBy("file").agg(F.sort_array(F.collect_list("commit")).alias("kind")), "kinds")
    small = counted_pairs(rows.join(F.broadcast(large.select("commit")) if few else large.select("commit"), "commit", "left_anti"), own)
    a, b = (kinds.select(F.col("file").alias(n), F.col("kind").alias(k)) for n, k in (("file", "x"), ("other", "y")))
    shared = F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0))
    close = small.join(a, "file", "left").join(b, "other", "left")
    close = close.select("file", "other", (F.col("n") + F.when(F.col("x").isNull() | F.col("y").isNull(), 0).otherwise(shared)).alias("n"))
    first = kinds.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("file"))).where(F.col("place") <= keep + 1)
    kind = saved(kinds.select("kind").distinct(), "kind")
    each = kind.select(F.col("kind").alias("x"), F.explode("kind").alias("commit"))
    met = each.join(each.select(F.col("x").alias("y"), "commit"), "commit").select("x", "y").distinct()
    named = met.withColumn("n", shared.cast("long")).join(first.select(F.col("kind").alias("y"), F.col("file").alias("other")), "y")
    order = Window.partitionBy("x").orderBy(F.desc("n"), "other")
    named = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep + 1).select("x", "other", "n")
    far = a.join(named, "x").where("file != other").select("file", "other", "n")
    if own:
        far = far.unionByName(kinds.select("file", F.col("file").alias("other"), F.size("kind").cast("long").alias("n")))
    return close.unionByName(far).groupBy("file", "other").agg(F.max("n").alias("n"))


def crowded(rows: DataFrame, name: str, most: int) -> DataFrame | None:
    """The rows among which are all of each value of `name` that comes more than `most` times; None where no value does.

    Rows are counted by buckets of a hash, so a task writes a small row for a bucket at most, not one for a value.
    """
    bucket = F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int").alias("bucket")
    full = saved(rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("bucket"), "full")
    return None if full.isEmpty() else rows.withColumn("bucket", bucket).join(joined(full), "bucket", "left_semi").drop("bucket")


def large_commits(rows: DataFrame) -> DataFrame | None:
    """commit, k of the commits of more than PIECE files; None where there are none."""
    some = crowded(rows, "commit", PIECE)
    if some is None:
        return None
    large = saved(some.distinct().groupBy("commit").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > PIECE), "large")
    return None if large.isEmpty() else large


def counted_pairs(rows: DataFrame, own: bool = False) -> DataFrame:
    """file, other, n: how many commits touch both, for each ordered pair, with own also of a file and itself; commits hold at most PIECE files.

    Files of a commit become a list, the lists are dealt by ranges of their first file, so that commits of the same files meet in a task,
    which sums their pairs. A pair is then a row of few tasks, not of each commit, and they are summed by file, as they are ranked.
    Pairs of a file in more than HOT rows are dealt by the other file as well.
    """
    lists = rows.groupBy("commit").agg(F.sort_array(F.collect_set("file")).alias("files")).where(F.size("files") > (0 if own else 1)).select("files")
    spark = rows.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    first = F.col("files")[0]
    dealt = lists.repartitionByRange(count, first, F.xxhash64("files")).sortWithinPartitions(first)
    kind = rows.schema["file"].dataType.simpleString()
    pairs = dealt.mapInArrow(functools.partial(summed_pairs, own=own), f"file {kind}, other {kind}, n bigint")
    keys, some = ["file"], crowded(rows, "file", HOT)
    if some is not None:
        hot = some.groupBy("file").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("file", F.lit(True).alias("hot"))
        pairs = pairs.join(F.broadcast(hot), "file", "left")  # one row for HOT rows at most
        pairs = pairs.select("file", "other", "n", F.when(F.col("hot"), F.pmod(F.xxhash64("other"), F.lit(HOT_PARTS))).otherwise(0).alias("part"))
        keys = ["file", "part"]
    return pairs.repartition(*keys).groupBy(*keys, "other").agg(F.sum("n").alias("n")).select("file", "other", "n")


def summed_pairs(batches: Iterator[pa.RecordBatch], own: bool) -> Iterator[pa.RecordBatch]:
    """file, other, n: how many lists hold both, for each ordered pair of the names of sorted lists without repeats, with own also of a name and itself.

    Names are numbered as they come, and a pair is one number. Sums are given out, by name, where there are too many of them to hold, and at the end.
    """
    codes, keys, n, fresh, kind = {}, np.empty(0, np.int64), np.empty(0, np.int64), [], None

    def whole() -> tuple[np.ndarray, np.ndarray]:
        found, counts = np.unique(np.concatenate(fresh), return_counts=True)
        fresh.clear()
        both = np.concatenate([keys, found])
        order = np.argsort(both, kind="stable")
        both = both[order]
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        return both[at], np.add.reduceat(np.concatenate([n, counts])[order], at)

    def given() -> Iterator[pa.RecordBatch]:
        names = pa.array(list(codes), kind)
        order = pc.sort_indices(names)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        names = names.take(order)
        a, b = rank[keys >> 32], rank[keys & 0xFFFFFFFF]
        two = a != b
        file, other, counts = np.concatenate([a, b[two]]), np.concatenate([b, a[two]]), np.concatenate([n, n[two]])
        order = np.lexsort((other, file))
        for begin in range(0, len(order), 100_000):
            rows = order[begin : begin + 100_000]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(file[rows])), names.take(pa.array(other[rows])), pa.array(counts[rows])], names=["file", "other", "n"])

    for batch in batches:
        lists = batch["files"]
        kind = lists.type.value_type
        values = lists.flatten().dictionary_encode()
        numbers = np.array([codes.setdefault(v, len(codes)) for v in values.dictionary.to_pylist()], np.int64)[values.indices.to_numpy()]
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        for k in np.unique(sizes):
            a, b = np.triu_indices(k, 0 if own else 1)
            begins, step = starts[sizes == k], max(1, MOST_PAIRS // 4 // max(1, len(a)))
            for at in range(0, len(begins), step):
                part = numbers[begins[at : at + step, None] + np.arange(k)]
                fresh.append((part[:, a] << 32 | part[:, b]).ravel())
                if sum(map(len, fresh)) >= MOST_PAIRS:
                    keys, n = whole()
        if len(keys) > MOST_PAIRS or len(codes) > MOST_NAMES:
            if fresh:
                keys, n = whole()
            yield from given()
            codes, keys, n = {}, np.empty(0, np.int64), np.empty(0, np.int64)
    if fresh:
        keys, n = whole()
    if len(keys):
        yield from given()


def cochanged(commits: DataFrame, keep: int | None = TOP, most_files: int | None = None) -> DataFrame:
    """file, other, n, rank: files that share commits with a file, the most common first, ties by name."""
    pairs = pair_counts(commits, most_files) if keep is None else best_pairs(commits, keep, most_files)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "other")))
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def max_cochange(commits: DataFrame) -> DataFrame:
    """file, max_cochange."""
    return best_pairs(commits, 1).groupBy("file").agg(F.max("n").alias("max_cochange"))


def git_signals(commits: DataFrame) -> DataFrame:
    """file, churn, authors, recent_commits, recent_messages, co_changed, max_cochange; newest and most common first.

    A file is paired with itself as well, and that pair, which comes first, tells its churn, so rows are not dealt for it again.
    """
    own = commits.groupBy("file").agg(F.countDistinct("author").alias("authors"))
    newest = recent(commits).groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "commit", "at", "message", "author"))), lambda r: F.struct(r["commit"].alias("hash"), r["at"].alias("date"), r["message"], r["author"])).alias("recent_commits")
    )
    other = F.col("other") != F.col("file")
    order = Window.partitionBy("file").orderBy(other, F.desc("n"), "other")
    first = best_pairs(commits, TOP, own=True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP + 1)
    near = first.groupBy("file").agg(
        F.max(F.when(~other, F.col("n"))).alias("churn"), F.max(F.when(other, F.col("n"))).alias("max_cochange"),
        F.transform(F.array_sort(F.collect_list(F.when(other, F.struct("rank", "other", "n")))), lambda r: F.struct(r["other"].alias("path"), r["n"].alias("count"))).alias("co_changed"),
    )
    out = own.join(newest, "file", "left").join(near, "file", "left").withColumn("co_changed", F.when(F.size("co_changed") > 0, F.col("co_changed")))
    return out.withColumn("recent_messages", F.transform("recent_commits", lambda r: r["message"])).fillna(0, ["churn", "max_cochange"])
