"""Exact dedup over cuckoo-filter indexes.

Each document is reduced to the SHA-256 of its text with A-Z in lower case. Digests are dealt into index buckets; the index
of a bucket is a cuckoo filter of short fingerprints, and beside each fingerprint's slot the entry that it stands for: the
whole digest, the largest doc_id met and the number of rows. A digest none of whose slots holds its fingerprint is new and is
inserted. A hit counts only once an entry in one of the two places confirms the whole digest; the entry that it supersedes is
then deleted and the merged one inserted. Where an insertion finds no place after so many evictions, the filter is rebuilt at
twice its size from the stored entries.

Defined results: a null text counts as the empty one; of equal texts the row with the largest doc_id stays (a null id is
below all others), and of rows that repeat that doc_id one is kept; an empty table gives an empty result.
Other columns of the input, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SLOTS = 4
MAX_KICKS = 200
#: Rows that the index of one bucket is planned for.
BUCKET_ROWS = 200_000


class CuckooIndex:
    """A cuckoo filter with 16-bit fingerprints, SLOTS to a place, and in the same slots the live digests with a value each."""

    def __init__(self, capacity: int = 1_024):
        self.resizes = self.live = 0
        self._clear(max(2, 1 << (max(1, capacity * 5 // (4 * SLOTS)) - 1).bit_length()))

    def __len__(self) -> int:
        return self.live

    def _clear(self, places: int) -> None:
        self.mask = places - 1
        self.marks: list[list[int]] = [[] for _ in range(places)]
        self.store: list[list[tuple[bytes, object]]] = [[] for _ in range(places)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says: never False for a live digest."""
        mark, a, b = self._places(digest)
        return mark in self.marks[a] or mark in self.marks[b]

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        """Place and slot of a live digest: entries are read only where the filter has a hit, and must hold the whole digest."""
        if not self.maybe(digest):
            return None
        mark, a, b = self._places(digest)
        for at in (a, b):
            for slot, held in enumerate(self.marks[at]):
                if held == mark and self.store[at][slot][0] == digest:
                    return at, slot
        return None

    def get(self, digest: bytes):
        """The value of a live digest, or None."""
        found = self._find(digest)
        return None if found is None else self.store[found[0]][found[1]][1]

    def insert(self, digest: bytes, value) -> None:
        """Makes a digest live that is not: the caller has looked it up, or deleted it."""
        self.live += 1
        left = self._place((digest, value))
        if left is not None:
            self._resize(left)

    def delete(self, digest: bytes):
        """Takes a live digest out of filter and store and returns its value; None if it is not live."""
        found = self._find(digest)
        if found is None:
            return None
        at, slot = found
        self.live -= 1
        self.marks[at].pop(slot)
        return self.store[at].pop(slot)[1]

    def items(self):
        """The live digests with their values."""
        for entries in self.store:
            yield from entries

    def _place(self, entry: tuple[bytes, object]) -> tuple[bytes, object] | None:
        """Puts an entry into one of its places, moving others; the entry that is left over, or None."""
        mark, a, b = self._places(entry[0])
        at = a if len(self.marks[a]) <= len(self.marks[b]) else b
        for kick in range(MAX_KICKS):
            if len(self.marks[at]) < SLOTS:
                self.marks[at].append(mark)
                self.store[at].append(entry)
                return None
            slot = kick % SLOTS
            mark, self.marks[at][slot] = self.marks[at][slot], mark
            entry, self.store[at][slot] = self.store[at][slot], entry
            at = self._other(at, mark)
        return entry

    def _resize(self, left: tuple[bytes, object]) -> None:
        entries, places = [*self.items(), left], len(self.marks)
        while True:
            self.resizes += 1
            places *= 2
            self._clear(places)
            if all(self._place(e) is None for e in entries):
                return


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (see common.row_key), digest (32 bytes) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        rows = ((i, k, hashlib.sha256(t.lower()).digest()) for i, k, t in common.rows_of(batches, "doc_id", "text_key", "text"))
        yield from common.record_batches(rows, schema, 10_000)

    return common.keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, digest binary")


def task_sums(rows: DataFrame) -> DataFrame:
    """digest, top, n: the largest doc_id and the count of each digest, summed inside a task only.

    A task gives its sums out whenever it holds BUCKET_ROWS digests, so a digest may come from it more than once.
    """
    schema = pa.schema([("digest", pa.binary()), ("top", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[bytes, tuple] = {}
        sums = lambda: ((d, top, n) for d, (top, n) in held.items())
        for digest, doc_id in common.rows_of(batches, "digest", "doc_id", step=10_000):
            held[digest] = _merged(held[digest], (doc_id, 1)) if digest in held else (doc_id, 1)
            if len(held) >= BUCKET_ROWS:
                yield from common.record_batches(sums(), schema, 10_000)
                held.clear()
        yield from common.record_batches(sums(), schema, 10_000)

    return rows.select("digest", "doc_id").mapInArrow(run, "digest binary, top long, n long")


def _merged(a: tuple, b: tuple) -> tuple:
    """Two (top, n) as one; a null id is below all others."""
    return (b[0] if a[0] is None or b[0] is not None and b[0] > a[0] else a[0]), a[1] + b[1]


def index_groups(rows: DataFrame, total: int) -> DataFrame:
    """digest, keep_id, group_size: one row for each live digest, from the indexes of all buckets.

    The rows of a digest are summed where they are read first, so a group of copies costs its bucket a row for each task;
    the bucket's index finds, verifies and merges what comes from several tasks.
    """
    buckets = max(1, -(-total // BUCKET_ROWS))
    schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        index = CuckooIndex(table.num_rows)
        for digest, top, n in zip(*(table.column(c).to_pylist() for c in ("digest", "top", "n")), strict=True):
            superseded = index.delete(digest)
            index.insert(digest, (top, n) if superseded is None else _merged(superseded, (top, n)))
        digests, values = zip(*index.items(), strict=True)
        return pa.table([pa.array(digests, pa.binary()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], schema=schema)

    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    return task_sums(rows).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, keep_id, group_size, kept, digest for every row of docs."""
    rows = common.saved(digests(docs, doc_id, text), "digests")
    total = rows.count()
    groups = common.saved(index_groups(rows, total), "groups")
    out = common.joined_by_key(rows, groups, "digest", "group_size", total)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("digest").orderBy("text_key")) == 1
    kept = out.where(stays).withColumn("kept", first)
    return kept.unionByName(out.where(~stays).withColumn("kept", F.lit(False))).select("doc_id", "text_key", "keep_id", "group_size", "kept", "digest")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    return common.keep_rows(docs, exact_dedup(docs, doc_id, text).where("kept"), doc_id, text)
