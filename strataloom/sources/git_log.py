"""Git history and differences as tables, from bulk logs instead of a process for each file and commit.

The log is a data source ("git_log"): the driver reads the date of each commit, cuts the commits into ranges, leaves out ranges
that a filter on the date rules out, and each range is read by a task. The repository has to be in a folder that all machines
see, as its files have to for the scan.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.storage import saved

LOG_FORMAT = "%x1e%H%x1f%aI%x1f%an%x1f%s"
#: Names as they are, not quoted for a terminal.
GIT = ("git", "-c", "core.quotepath=off", "-C")
LOG_ARGS = ("log", "--no-color", "--name-status", "-M", f"--format={LOG_FORMAT}")
#: Commits of a range, so of a task.
RANGE = 2_000


def read_diff(root: str, base: str) -> str:
    out = subprocess.run([*GIT, root, "diff", "--name-status", "-M", f"{base}...HEAD"], capture_output=True, text=True, errors="replace")
    return out.stdout if out.returncode == 0 else ""


class CommitRange(InputPartition):
    def __init__(self, skip: int, count: int):
        self.skip, self.count = skip, count


class GitLog(DataSource):
    """Options: root; range, the commits of a partition. Columns: at, the author's date, and value, the commit as the log has it."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "at timestamp, value string"

    def reader(self, schema) -> GitLogReader:
        return GitLogReader(self.options["root"], int(self.options.get("range", RANGE)))


class GitLogReader(DataSourceReader):
    def __init__(self, root: str, size: int):
        self.root, self.size = root, size
        self.least, self.most = datetime.min.replace(tzinfo=timezone.utc), datetime.max.replace(tzinfo=timezone.utc)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes note of bounds of the date; Spark still applies each filter, since a range holds other dates too."""
        for f in filters:
            if getattr(f, "attribute", None) == ("at",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.least = max(self.least, _aware(f.value))
            if getattr(f, "attribute", None) == ("at",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.most = min(self.most, _aware(f.value))
            yield f

    def partitions(self) -> list[CommitRange]:
        """The ranges that hold a commit between the bounds. A line of the date is read for each commit, one at a time."""
        run = subprocess.Popen([*GIT, self.root, "log", "--format=%aI"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
        out, dates, n = [], [], 0

        def close() -> None:
            if dates and max(dates) >= self.least and min(dates) <= self.most:
                out.append(CommitRange(n - len(dates), len(dates)))
            dates.clear()

        for line in run.stdout:
            dates.append(datetime.fromisoformat(line.strip()))
            n += 1
            if len(dates) == self.size:
                close()
        close()
        return out if run.wait() == 0 and out else [CommitRange(0, 0)]

    def read(self, partition: CommitRange) -> Iterator[tuple]:
        if not partition.count:
            return
        run = subprocess.Popen([*GIT, self.root, *LOG_ARGS, f"--skip={partition.skip}", f"--max-count={partition.count}"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        held: list[str] = []
        for line in (raw.decode(errors="replace") for raw in run.stdout):
            if line.startswith("\x1e") and held:
                yield _commit("".join(held))
                held = []
            held.append(line)
        if held and held[0].startswith("\x1e"):
            yield _commit("".join(held))
        if run.wait():
            raise RuntimeError(f"git log of {self.root!r} failed")


def _aware(at: datetime) -> datetime:
    return at if at.tzinfo else at.astimezone()


def _commit(text: str) -> tuple[datetime, str]:
    return datetime.fromisoformat(text.split("\x1f", 2)[1]), text


def commit_texts(spark: SparkSession, root: str, size: int = RANGE) -> DataFrame:
    """at, value of each commit of a repository; filters on at leave out ranges of commits."""
    spark.dataSource.register(GitLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("git_log").option("root", root).option("range", size).load()


def plain_name(name):
    """A file's name without the quotes and escapes that git puts around names with quotes, backslashes, tabs and line ends."""
    inner = F.regexp_replace(F.substring(name, 2, F.length(name) - 2), r"\\\\", "\u0000")
    for mark, own in (("t", "\t"), ("n", "\n"), ('"', '"')):
        inner = F.regexp_replace(inner, rf"\\{mark}", own)
    return F.when(F.startswith(name, F.lit('"')), F.translate(inner, "\u0000", "\\")).otherwise(name)


def parsed_log(logs: DataFrame) -> DataFrame:
    """file, commit, at, author, message, status, was of a table of logs (value): a row for each commit and file; was: its name before a rename."""
    commit = logs.select(F.explode(F.split("value", "\u001e")).alias("c")).where(F.trim("c") != "")
    head = F.split(F.substring_index("c", "\n", 1), "\u001f")
    files = F.filter(F.split("c", "\n"), lambda x: F.contains(x, F.lit("\t")) & ~F.contains(x, F.lit("\u001f")))
    each = commit.select(head.alias("h"), F.explode(files).alias("f")).withColumn("f", F.transform(F.split("f", "\t"), plain_name))
    return each.select(F.element_at("f", -1).alias("file"), F.col("h")[0].alias("commit"), F.to_timestamp(F.col("h")[1]).alias("at"), F.col("h")[2].alias("author"), F.col("h")[3].alias("message"), F.left(F.col("f")[0], F.lit(1)).alias("status"), F.when(F.startswith(F.col("f")[0], F.lit("R")), F.col("f")[1]).alias("was"))


def history(spark: SparkSession, root: str, since: datetime | None = None, size: int = RANGE) -> DataFrame:
    """The log of a repository, each file under the name it has now; with since only commits from then on, read from the ranges that hold some."""
    texts = commit_texts(spark, root, size)
    return followed(parsed_log((texts if since is None else texts.where(F.col("at") >= F.lit(since))).select("value")))


def followed(commits: DataFrame) -> DataFrame:
    """commits (with was, the old name of a renamed file) under each file's latest name, so its history goes on before a rename.

    A rename says that the old name, up to that commit, is the new one; names are led on until none is renamed any more.
    Each hop is to a later rename, so it ends.
    """
    renames = saved(commits.where("was IS NOT NULL AND was != file").select(F.col("was").alias("file"), F.col("file").alias("next"), F.col("at").alias("until")), "renames")
    own = commits.drop("was").withColumn("id", F.monotonically_increasing_id()) if renames.limit(1).count() else None
    if own is None:
        return commits.drop("was")
    own = saved(own.withColumn("seen", F.col("at")), "named")
    names = own.columns
    while True:
        hop = own.join(renames, "file").where(F.col("until") >= F.col("seen"))
        led = saved(hop.groupBy("id").agg(F.min(F.struct("until", "next")).alias("hop")), "hops")
        if not led.limit(1).count():
            break
        moved = own.join(led, "id", "left")
        own = saved(moved.select(*(F.coalesce("hop.next", "file").alias(c) if c == "file" else F.when(F.col("hop").isNotNull(), F.timestamp_add("MICROSECOND", F.lit(1), F.col("hop.until"))).otherwise(F.col("seen")).alias(c) if c == "seen" else F.col(c) for c in names)), "named")
    return own.drop("id", "seen")


def parsed_diff(lines: DataFrame) -> DataFrame:
    """path, edit of name-status lines (value): A and C are added, M and T modified, D deleted, R both the new path modified and the old deleted."""
    f = F.transform(F.split("value", "\t"), plain_name)
    kind = F.left("value", F.lit(1))
    own = F.when(kind.isin("A", "C"), F.array(F.struct(F.element_at(f, -1).alias("path"), F.lit("added").alias("edit"))))
    own = own.when(kind.isin("M", "T"), F.array(F.struct(F.element_at(f, -1).alias("path"), F.lit("modified").alias("edit"))))
    own = own.when(kind == "D", F.array(F.struct(F.element_at(f, -1).alias("path"), F.lit("deleted").alias("edit"))))
    own = own.when(kind == "R", F.array(F.struct(F.element_at(f, 3).alias("path"), F.lit("modified").alias("edit")), F.struct(F.element_at(f, 2).alias("path"), F.lit("deleted").alias("edit"))))
    return lines.where(F.contains("value", F.lit("\t"))).select(F.explode(own).alias("x")).select("x.path", "x.edit")


def changes(spark: SparkSession, root: str, base: str) -> DataFrame:
    return parsed_diff(spark.createDataFrame([(x,) for x in read_diff(root, base).split("\n")], "value string"))
