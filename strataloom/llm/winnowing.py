"""Benchmark decontamination by winnowing.

A text is its words: A-Z in lower case, split at every ASCII character that is no letter or digit. Of each window of
consecutive k-grams the least hash is kept. With k-grams of (m + 1) / 2 words and windows of as many k-grams as m words hold,
a span of m words has the same kept hash wherever it stands, so every shared span of m words or more shares a fingerprint.

Fingerprints of training texts meet those of the benchmark in two steps: a bitmap of the benchmark's fingerprints (at most
32 MB however many there are) leaves out most of the others where the text is read, and what remains is extended to the
windows that rely on it and joined by fingerprint and window, a 128-bit digest of the window's words. A window of a text thus
meets one row at most, whatever texts and items share it. Joined windows are then put together to spans.

Windows that stand in the same items are one set of items, and the sets of a text one combination, listed once for all texts
that have it; no pair of a text and an item is made.

Defined results: a null text and a text of separators only have no words; an item of fewer words than a window is one window,
an item without words none; a null item id is listed as the empty string; items that repeat an id are one item, and rows that
repeat a doc_id keep a row each; empty tables give no hits or no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Bits of the bitmap for each fingerprint of the benchmark, and its least and greatest size as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 512, 16, 28
#: Letters and digits, A-Z as a-z; bytes beyond ASCII as they are; all others as a space.
FOLDED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
#: Bytes hashed at once, and those of the longest word hashed among others.
SLICE, LONGEST = 1 << 18, 1 << 12
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = (_powers(b, SLICE + LONGEST + 1) for b in (BASE, pow(BASE, -1, 1 << 64)))


class Words:
    """The words of a text: its folded bytes, where each word begins and ends in them, and a 64-bit hash of each."""

    def __init__(self, text: bytes):
        self.raw = text.translate(FOLDED)
        inside = np.frombuffer(self.raw, np.uint8) != 0x20
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """Polynomials over the bytes of each word, from differences of running sums, mixed with the word's length."""
        out, sizes = np.empty(len(self), np.uint64), self.ends - self.starts
        long = np.flatnonzero(sizes > LONGEST)
        for k in long:
            out[k] = xxhash.xxh3_64_intdigest(self.raw[self.starts[k] : self.ends[k]])
        stops, at = [*long.tolist(), len(self)], 0
        data = np.frombuffer(self.raw, np.uint8)
        for stop in stops:
            while at < stop:
                base = self.starts[at]
                to = min(stop, max(at + 1, int(np.searchsorted(self.ends, base + SLICE, "right"))))
                first, last = self.starts[at:to] - base, self.ends[at:to] - base
                sums = np.zeros(last[-1] + 1, np.uint64)
                np.cumsum(data[base : base + last[-1]] * UP[: last[-1]], out=sums[1:])
                out[at:to] = (sums[last] - sums[first]) * DOWN[first]
                at = to
            at = stop + 1
        return common.mix64(out ^ (sizes.astype(np.uint64) * np.uint64(BASE)))

    def window(self, start: int, length: int) -> bytes:
        """128 bits of so many words joined by single spaces."""
        return xxhash.xxh3_128_digest(b" ".join(self.raw[self.starts[start] : self.ends[start + length - 1]].split()))


def winnowed(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of so many words: its fingerprint, the least hash of its k-grams. And where it is not that of the window before."""
    k = (length + 1) // 2
    grams = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        grams += hashes[j : len(grams) + j] * UP[j]
    grams = common.mix64(grams ^ np.uint64(length))
    n = len(hashes) - length + 1
    least = grams[:n].copy()
    for j in range(1, length - k + 1):
        np.minimum(least, grams[j : n + j], out=least)
    return least, np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))


CANDIDATE = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("fp", pa.int64()), ("window", pa.binary())])


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """fp, window, length, item: each window of each item once."""
    schema = pa.schema([("fp", pa.int64()), ("window", pa.binary()), ("length", pa.int32()), ("item", pa.string())])

    def rows(batches) -> Iterator[tuple]:
        for item, raw in common.rows_of(batches, "item", "text"):
            words = Words(raw)
            length = min(window, len(words))
            if length:
                least, _ = winnowed(words.hashes(), length)
                for start, fp in enumerate(least.view(np.int64).tolist()):
                    yield fp, words.window(start, length), length, item.decode()

    def run(batches):
        yield from common.record_batches(rows(batches), schema)

    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(run, "fp long, window binary, length int, item string").distinct()


def fingerprint_bitmap(windows: DataFrame) -> np.ndarray:
    """A bit for each fingerprint, at its low bits; put together in pieces of 4 KB of which each is made in a task of its own."""
    kept = common.saved(windows.select("fp").distinct(), "fingerprints")
    bits = min(MOST_BITS, max(LEAST_BITS, (kept.count() * BITS_EACH).bit_length()))
    spot = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))

    def piece(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << 15, np.uint8)
        out[table["spot"].to_numpy() & 0x7FFF] = 1
        return pa.table({"piece": table["piece"].slice(0, 1), "bits": [np.packbits(out, bitorder="little").tobytes()]})

    spots = kept.select(spot.alias("spot"), F.shiftright(spot, 15).alias("piece")).distinct()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in spots.groupBy("piece").applyInArrow(piece, "piece long, bits binary").collect():
        out[r["piece"] << 12 : (r["piece"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidates(docs: DataFrame, doc_id: str, text: str, bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, n_words and the windows whose fingerprint the bitmap has, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("found", pa.list_(CANDIDATE))])

    def of_text(raw: bytes) -> tuple[int, list[dict]]:
        words, found, bits = Words(raw), [], shared.value
        hashes = words.hashes() if lengths and len(words) >= lengths[0] else None
        for length in lengths:
            if len(words) < length:
                break
            least, fresh = winnowed(hashes, length)
            spots = least[fresh] & np.uint64(len(bits) * 8 - 1)
            known = (bits[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1
            if not known.any():
                continue
            ends = np.append(fresh[1:], len(least))
            for k in np.flatnonzero(known):  # a fingerprint is extended to all windows that rely on it
                fp = int(least[fresh[k]].view(np.int64))
                found += [{"start": s, "length": length, "fp": fp, "window": words.window(s, length)} for s in range(int(fresh[k]), int(ends[k]))]
        return len(words), found

    def run(batches):
        rows = ((i, *of_text(t)) for i, t in common.rows_of(batches, "doc_id", "text"))
        yield from common.record_batches(rows, schema, 256)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "doc_id long, n_words long, found array<struct<start:int,length:int,fp:long,window:binary>>"
    return own.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id())


def item_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fp, window, set_id; and set_id, item. Windows of the same items have the same set_id, a digest of their sums of hashes."""
    total = lambda *by: F.sum(F.xxhash64(*by, "item").cast("decimal(38,0)")).cast("string")
    set_id = F.unhex(F.md5(F.concat_ws(":", F.count("*").cast("string"), total(), total(F.lit(1))).cast("binary")))
    sets = common.saved(windows.groupBy("fp", "window", "length").agg(set_id.alias("set_id")), "sets")
    first = sets.groupBy("set_id").agg(F.min(F.struct("fp", "window", "length")).alias("first")).select("set_id", "first.*")
    return sets.select("fp", "window", "length", "set_id"), windows.join(first, ["fp", "window", "length"]).select("set_id", "item")


def merged_spans(spans: str):
    """Sorted and overlapping or touching spans as one; an aggregate over the array of (start, end) of one text."""
    kind = "array<struct<start:int,end:int>>"

    def step(held, span):
        last = F.element_at(held, -1)
        joined = F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(held) > 0) & (span["start"] <= last["end"]), joined).otherwise(F.concat(held, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items for every row of docs.

    spans: where words of the text stand in a window of the benchmark, as (start, end) in words, end exclusive, apart and in
    order. n_hit: their words. items: the ids, as strings and in order, of the items with such a window.
    """
    windows = common.saved(item_windows(benchmark, item_id, item_text, window), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most as many as a window has words
    own = common.saved(candidates(docs, doc_id, text, fingerprint_bitmap(windows), lengths), "candidates")
    sets, members = item_sets(windows)
    found = own.select("row", F.explode("found").alias("at")).select("row", "at.*")
    hits = found.join(sets, ["fp", "window", "length"]).select("row", "set_id", F.struct("start", (F.col("start") + F.col("length")).alias("end")).alias("span"))
    by_row = hits.groupBy("row").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("set_id")).alias("sets"))
    texts = common.saved(by_row.select("row", "sets", merged_spans("spans").alias("spans")), "texts")
    combinations = texts.select("sets").distinct()
    listed = combinations.select("sets", F.explode("sets").alias("set_id")).join(members, "set_id").groupBy("sets").agg(F.array_sort(F.collect_set("item")).alias("items"))
    done = texts.join(listed, "sets").select("row", "spans", "items")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = own.select("row", "doc_id", "n_words").join(done, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce(words, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
