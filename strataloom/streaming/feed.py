"""A repository's changes as a stream: a source of change events with offsets, and bursts of them settled by timers.

The source ("file_changes") looks at a folder and numbers each look that finds a change; the offset is that number. What a
look found is written under its number before the offset is given out, so a batch that is run again after a failure gets the
same events; they go once Spark has committed the batch. A look costs a listing (time and size), no reading.

Bursts are settled by keyed state with timers: a file's first event sets a timer, every further one sets it anew, and when
nothing has come for the gap the burst comes out as one row. No later event is needed for the last burst to come out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

GAP_MS = 300
SKIPPED = frozenset({".git", "node_modules"})
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileChanges(DataSource):
    """Options: root; log, a folder for what looks have found, outside of root or in a folder named in skip; skip, folders left out, comma-separated."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "filename string, edit string, at timestamp"

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["root"], self.options["log"], SKIPPED | set(filter(None, self.options.get("skip", "").split(","))))


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, log: str, skip: set[str]):
        self.root, self.log, self.skip = root, Path(log), skip
        self.log.mkdir(parents=True, exist_ok=True)

    def listing(self) -> dict[str, list[int]]:
        """Path -> time in nanoseconds and size of every file."""
        out = {}
        for folder, names, files in os.walk(self.root):
            names[:] = [n for n in names if n not in self.skip]
            for name in files:
                path = os.path.join(folder, name)
                try:
                    found = os.stat(path)
                except FileNotFoundError:  # gone meanwhile
                    continue
                out[os.path.relpath(path, self.root)] = [found.st_mtime_ns, found.st_size]
        return out

    def _write(self, name: str, value) -> None:
        part = self.log / f"{name}.part"
        part.write_text(json.dumps(value))
        os.replace(part, self.log / name)

    def _last(self) -> dict:
        """The number of the last look and what it saw. The first look of all is where changes count from."""
        path = self.log / "seen.json"
        if not path.exists():
            self._write("seen.json", {"number": 0, "files": self.listing()})
        return json.loads(path.read_text())

    def initialOffset(self) -> dict:
        return {"number": self._last()["number"]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        last, now = self._last(), self.listing()
        was, number = last["files"], last["number"]
        edits = [(p, "added" if p not in was else "modified") for p in sorted(now) if was.get(p) != now[p]] + [(p, "deleted") for p in sorted(was.keys() - now.keys())]
        if edits:
            at = datetime.now(timezone.utc).timestamp()
            self._write(f"{number + 1}.json", [[p, e, at] for p, e in edits])
            self._write("seen.json", {"number": number + 1, "files": now})  # after the events: if it is missing, they are found again
            number += 1
        return self.readBetweenOffsets(start, {"number": number}), {"number": number}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = [r for k in range(start["number"] + 1, end["number"] + 1) for r in json.loads((self.log / f"{k}.json").read_text())]
        return iter([(p, e, datetime.fromtimestamp(at, timezone.utc)) for p, e, at in rows])

    def commit(self, end: dict) -> None:
        for path in self.log.glob("[0-9]*.json"):
            if int(path.stem) <= end["number"] - 1:
                path.unlink(missing_ok=True)


class Settle(StatefulProcessor):
    """A row for each burst of a file's events: filename, the last edit and time, and how many there were."""

    def __init__(self, gap_ms: int = GAP_MS):
        self.gap = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("burst", "edit string, at timestamp, events long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        edit, at, events = (held[0], held[1], held[2]) if held else (None, None, 0)
        for r in rows:
            edit, at = (r["edit"], r["at"]) if at is None or r["at"] >= at else (edit, at)
            events += 1
        if held:
            self.handle.deleteTimer(held[3])
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap
        self.handle.registerTimer(due)
        self.state.update((edit, at, events, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        edit, at, events, _ = self.state.get()
        self.state.clear()
        yield Row(filename=key[0], edit=edit, last_at=at, events=events)

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str, log: str, skip: str = "") -> DataFrame:
    """filename, edit, at: the stream of a folder's changes."""
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("root", root).option("log", log).option("skip", skip).load()


def settled(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """filename, edit, last_at, events: a row for each burst of events (filename, edit, at) that is followed by a quiet gap."""
    kind = "filename string, edit string, last_at timestamp, events long"
    return events.groupBy("filename").transformWithState(Settle(gap_ms), kind, "Append", "ProcessingTime")


def start(spark: SparkSession, root: str, folder: str, apply: Callable[[DataFrame, int], None], gap_ms: int = GAP_MS, every: str = "1 second", skip: str = "") -> StreamingQuery:
    """Runs apply(settled changes, batch id) on every batch that has some. Started again with the same folder it goes on where it ended.

    A batch may be repeated after a failure; apply should be idempotent, as upserts by path are.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def some(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            apply(batch, number)

    own = settled(changes(spark, root, f"{folder}/looks", skip), gap_ms)
    return own.writeStream.foreachBatch(some).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
