"""Document fingerprints by I-Match.

The lexicon holds the terms (words, A-Z in lower case) whose share of documents lies in a band. Since a document has only so
many distinct terms, at most (mean distinct terms of a document) / LOW terms can reach the band's lower end, so the lexicon
stays bounded at any number of documents; all of its counts are exact and over all documents. A fingerprint takes a text's
distinct terms in the lexicon in sorted order (by their 64-bit hash) and hashes them once whole and once for each of several
randomised subsets of the lexicon, drawn by the term's own hash at several rates, so likeness is graded: texts that share many
terms agree on the sparse subsets, equal ones on all. A subset that leaves no term gives the empty part.

Defined results: a null text counts as the empty one; a text without terms in the lexicon has empty parts only, and is like
texts of the same kind; rows that repeat have the same fingerprint; a null doc_id comes after all others, and rows of one
doc_id follow each other by their texts' XXH64; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The band, as shares of documents.
LOW, HIGH = 0.001, 0.25
#: The subsets: one in 2**k of the lexicon, and how many such.
RATES = ((3, 4), (5, 8), (7, 16), (9, 20), (11, 15))
EMPTY = "-" * 8
CHUNK_WORDS = 300_000
RANGE_KEYS = 2_000_000
#: Rows that one range of neighbouring documents is planned for, as long as that makes no more ranges than MOST_RANGES.
RANGE_ROWS = 2_000
#: Bounds what the driver gets and what is broadcast: a row for each range.
MOST_RANGES = 20_000


_RATE = np.array([rate for rate, count in RATES for _ in range(count)], np.uint64)
_SEED = np.array([0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1 for k in range(len(_RATE))], np.uint64)
_BIT = np.arange(64, dtype=np.uint64)


def subset_bits(hashes: np.ndarray) -> np.ndarray:
    """Of each term a bit for each subset that holds it; the last bit is the whole lexicon's."""
    held = common.mix64(hashes[:, None] ^ _SEED) >> (np.uint64(64) - _RATE) == 0
    own = np.bitwise_or.reduce(held.astype(np.uint64) << _BIT[: len(_RATE)], axis=1)
    return own | np.uint64(1) << np.uint64(63)


class Fingerprints:
    """lexicon: sorted hashes of the terms in the band."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes, self.bits, self.known = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, bool)

    def _learn(self, fresh: list[bytes]) -> None:
        n = len(self.number)
        own = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))
        self.number.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        while n + len(fresh) > len(self.hashes):
            self.hashes, self.bits, self.known = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.bits, self.known))
        to = slice(n, n + len(fresh))
        place = np.minimum(np.searchsorted(self.lexicon, own), max(0, len(self.lexicon) - 1))
        self.hashes[to], self.bits[to] = own, subset_bits(own)
        self.known[to] = self.lexicon[place] == own if len(self.lexicon) else False

    def __call__(self, text: bytes) -> str:
        distinct = set(common.words(text))
        if len(self.number) > CHUNK_WORDS:
            self._forget()
        if fresh := [w for w in distinct if w not in self.number]:
            self._learn(fresh)
        own = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        own = own[self.known[own]]
        terms = self.hashes[own]
        order = np.argsort(terms)
        terms, bits = terms[order], self.bits[own[order]]
        subset, at = np.nonzero((bits >> _BIT[:, None] & np.uint64(1)).astype(bool))
        raw, ends = terms[at].tobytes(), (np.cumsum(np.bincount(subset, minlength=64)) * 8).tolist()
        return "".join([f"{xxhash.xxh32_intdigest(raw[a:b], k):08x}" if b > a else EMPTY for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))])


def likeness(a: str, b: str) -> float:
    """Of the parts that are not empty in both, the share that agree; 1 if all are empty in both."""
    pairs = [(a[k : k + 8], b[k : k + 8]) for k in range(0, len(a), 8)]
    seen = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(seen) / len(seen) if seen else 1.0


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms whose number of documents is in the band, from exact counts over all documents."""
    slim = docs.select(F.col(text).alias("text"))
    schema = pa.schema([("range", pa.int32()), ("terms", pa.binary()), ("df", pa.binary())])
    total, size = slim.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = max(1, -(-(size or 0) // (64 * RANGE_KEYS)))
    edges = np.array([-(-(k << 64) // ranges) for k in range(1, ranges)], np.uint64)

    def count(batches):
        def fresh():
            numbers = defaultdict()
            numbers.default_factory = itertools.count().__next__
            return numbers, []

        def out(numbers, seen):
            own = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            df = np.bincount(np.concatenate(seen), minlength=len(own))
            order = np.argsort(own)
            own, df = own[order], df[order]
            cuts = [0, *np.searchsorted(own, edges).tolist(), len(own)]
            rows = ((k, common.pack_sorted(own[a:b]), common.pack(df[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a)
            yield from common.record_batches(rows, schema, 64)

        numbers, seen = fresh()
        for (t,) in common.rows_of(batches, "text"):
            distinct = set(common.words(t))
            seen.append(np.fromiter(map(numbers.__getitem__, distinct), np.int64, len(distinct)))
            if len(numbers) > CHUNK_WORDS or len(seen) > 50_000:
                yield from out(numbers, seen)
                numbers, seen = fresh()
        if seen:
            yield from out(numbers, seen)

    def band(table: pa.Table) -> pa.Table:
        terms = np.concatenate([common.unpack_sorted(x) for x in table.column("terms").to_pylist()])
        own, inverse = np.unique(terms, return_inverse=True)
        df = np.bincount(inverse, np.concatenate([common.unpack(x) for x in table.column("df").to_pylist()]).astype(np.float64))
        return pa.table({"term": pa.array(own[(df >= low * total) & (df <= high * total)].view(np.int64))})

    found = slim.mapInArrow(count, "range int, terms binary, df binary").groupBy("range").applyInArrow(band, "term long")
    return np.sort(found.toArrow().column(0).to_numpy().view(np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint for every row of docs."""
    terms = lexicon(docs, text) if terms is None else terms
    held = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        make = Fingerprints(held.value)
        yield from common.record_batches(((i, make(t)) for i, t in common.rows_of(batches, "doc_id", "text")), schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def neighbour_ranges(slim: DataFrame, rows: int, most: int) -> list[tuple[int | None, int]]:
    """The first row (doc_id, text_key) of each range, in order, but for the first range; the first of all stands first.

    Ranges hold about so many rows each, and at most so many ranges there are. Spark deals the two columns by range; what each
    task holds last is where the next range ends, so a row of the table begins each range.
    """
    n = slim.count()
    if not n:
        return []
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_key")]
    dealt = slim.select("doc_id", "text_key").repartitionByRange(max(1, min(most, -(-n // rows))), *order)
    firsts = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("down"), "text_key")).alias("first")).select("first.*").collect()
    return [(None if r["no_id"] else ~r["down"], r["text_key"]) for r in sorted(firsts, key=lambda r: (r["no_id"], r["down"] or 0, r["text_key"]))]


def range_numbers(firsts: list[tuple[int | None, int]], ids: np.ndarray, nulls: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The range that each row (doc_id, or null, and text_key) belongs to: the last whose first row is not after it."""
    down, key = (np.array([f[k] for f in firsts if f[0] is not None], np.int64) for k in (0, 1))
    null_keys = np.array([k for i, k in firsts if i is None], np.int64)
    down = ~down
    low, high = np.searchsorted(down, ~ids, "left"), np.searchsorted(down, ~ids, "right")
    for one in np.unique(low[high > low]):  # ids with which a range begins: their text_key decides
        rows = (high > low) & (low == one)
        high[rows] = one + np.searchsorted(key[one : high[rows][0]], keys[rows], "right")
    return np.where(nulls, len(down) + np.searchsorted(null_keys, keys, "right"), high) - 1


def with_next(docs: DataFrame, use, columns: str, doc_id: str = "doc_id", text: str = "text", rows: int | None = None) -> DataFrame:
    """Rows of use(triples) over doc_id, text and next text of all rows by descending doc_id (nulls last, ties by text_key).

    One shuffle brings the rows of a range to one task in order. The first row of each range comes also to the range before
    it, as its last row's next, and the first row of all to the last range; texts are held two at a time.
    """
    slim = common.keyed(docs, doc_id, text)
    firsts = neighbour_ranges(slim, rows or RANGE_ROWS, MOST_RANGES)
    count = max(1, len(firsts))

    @F.pandas_udf("long")
    def range_of(ids: pd.Series, nulls: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(range_numbers(firsts, ids.to_numpy(np.int64), nulls.to_numpy(bool), keys.to_numpy(np.int64)))

    if count > 1:
        dealt = slim.withColumn("range", range_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_key"))
        to = [(i, key, (r - 1) % count) for r, (i, key) in enumerate(firsts)]
        guests = F.broadcast(docs.sparkSession.createDataFrame(to, "first_id long, first_key long, to long"))
        both = F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.struct(F.col("to").alias("range"), F.lit(1).alias("guest")))
        places = F.when(F.col("to").isNull(), F.slice(both, 1, 1)).otherwise(both)
        begins = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
        dealt = dealt.join(guests, begins, "left").withColumn("place", F.explode(places)).select("doc_id", "text_key", "text", "place.range", "place.guest")
    else:
        dealt = slim.withColumns({"range": F.lit(0), "guest": F.lit(0)})
    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text_key", "text")

    def run(batches):
        def triples():
            own, first, prior = None, b"", None
            for i, t, place, guest in common.rows_of(batches, "doc_id", "text", "range", "guest"):
                if place != own:
                    if prior is not None:
                        yield (*prior, first)
                    own, first, prior = place, t, None if guest else (i, t)
                    continue
                if prior is not None:
                    yield (*prior, t)
                prior = None if guest else (i, t)
            if prior is not None:
                yield (*prior, first)

        yield from use(triples())

    return ordered.mapInArrow(run, columns)


def edited(text: str, following: str) -> str:
    """text with the second half of its code points replaced by as many of the following text's first, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text))
    names = ("fingerprint", "edited_fingerprint")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), *((n, pa.string()) for n in names), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def use(triples):
        make, last = Fingerprints(held.value), (None, "")

        def rows():
            nonlocal last
            for i, t, following in triples:
                own = last[1] if last[0] is t else make(t)
                last = (following, make(following))
                whole = t.decode("utf-8", "replace")
                other = edited(whole, following.decode("utf-8", "replace"))
                changed = make(other.encode())
                yield i, len(whole), other, own, changed, likeness(own, changed), likeness(own, last[1])

        yield from common.record_batches(rows(), schema, 256)

    return with_next(docs, use, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", doc_id, text)
