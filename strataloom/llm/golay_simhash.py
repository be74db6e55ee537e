"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints (64 bits, from 3-word shingles) are cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ
in at most two bits agree in at least one whole segment (pigeonhole over three segments), and of the other two segments at
least one differs in at most one bit. The binary Golay code [23, 12, 7] is perfect: every 23-bit word lies within three bits
of exactly one codeword. So a segment u is stored under the index of its codeword, and looked up under the indexes of the
codewords of u and of all words one bit away (one key, or six where u is three bits off its codeword): whoever is at most one
bit away is found. A candidate key is one whole segment with one such index of another; candidates are verified by their
differing bits. Links are gathered as spanning trees of each key's bucket, never as all pairs, and joined into components.

near_dedup() links like that. similar() links wider, texts that share four fifths of their 5-word shingles or more: their words
(each weighing 1 + ln of its count) give one fingerprint, which such texts have within WIDE_BITS bits of each other, and their
5-word shingles another, which they have within SHINGLE_BITS. Two words that differ in at most two bits have a codeword index
in common among those of all words one bit away, and of at most five errors in three segments at most two fall on each of
some two segments: so the keys are the pairs of such indexes of two segments, and both distances verify a candidate. As the
bits that differ scatter about their mean, some pairs just above four fifths are missed (see README for the measured recall).

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other; rows
that repeat are linked by their equal fingerprints; null ids are above all others as component ids; an empty table gives an
empty result. Other columns of the input, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import collections
import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Shift and width of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_POLYNOMIAL = 0b110001110101
#: Of the wide links: bits that may differ in the fingerprint of the words, words of a shingle, bits that may differ in the shingles'.
WIDE_BITS, WIDE_SHINGLE, SHINGLE_BITS = 5, 5, 15
#: A bucket of more fingerprints than this is dealt again by its other bits before they are compared.
DENSE = 8_192


def simhash(text: bytes, words: int = SHINGLE) -> int:
    """The fingerprint of a text: a bit is 1 if set in over half of the hashes of its shingles of so many words."""
    ws = common.words(text)
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    n = max(1, len(ws) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(words, len(ws)) - 1 :].tolist()
    shingles = map(joined.__getitem__, map(slice, starts, stops))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        total += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _majority(hashes: np.ndarray, weights: np.ndarray) -> int:
    """The bits that hashes with over half of the weight have."""
    total = np.zeros(64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += weights[at : at + 65_536] @ bits
    return int.from_bytes(np.packbits(total * 2 > weights.sum()).tobytes(), "big")


def word_simhash(text: bytes) -> int:
    """The fingerprint of a text's distinct words, each weighing 1 + ln of its count; without words zero."""
    counted = collections.Counter(common.words(text))
    if not counted:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, counted, itertools.repeat(SEED)), np.uint64, len(counted))
    return _majority(hashes, 1 + np.log(np.fromiter(counted.values(), np.float64, len(counted))))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (see common.row_key), fp (the fingerprint as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        rows = ((i, k, (f := simhash(t)) - (f >> 63 << 64)) for i, k, t in common.rows_of(batches, "doc_id", "text_key", "text"))
        yield from common.record_batches(rows, schema, 10_000)

    return common.keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, fp long")


@functools.cache
def _syndrome_errors() -> np.ndarray:
    """The error pattern (at most three of 23 bits) of each of the 2,048 syndromes."""
    bits = np.arange(23)
    out = np.zeros(2_048, np.int64)
    single = _syndrome(np.int64(1) << bits)
    for a in bits:
        for b in bits[: a + 1]:
            for c in bits[: b + 1]:
                e, s = 0, 0
                for x in {int(a), int(b), int(c)}:
                    e, s = e | 1 << x, s ^ int(single[x])
                out[s] = e
    return out


def _syndrome(word: np.ndarray) -> np.ndarray:
    rest = word.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1 == 1, rest ^ (GOLAY_POLYNOMIAL << (bit - 11)), rest)
    return rest


@functools.cache
def _decode_table() -> np.ndarray:
    """Of every 22-bit word (bit 22 zero): the 12-bit index of the codeword within three bits."""
    return np.concatenate([codeword_index(np.arange(at, at + (1 << 18))).astype(np.uint16) for at in range(0, 1 << 22, 1 << 18)])


def codeword_index(word: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each 23-bit word."""
    word = np.asarray(word, np.int64)
    return ((word ^ _syndrome_errors()[_syndrome(word)]) >> 11).astype(np.int64)


def nearby_indexes(word: np.ndarray, width: int) -> np.ndarray:
    """For each word of so many bits: the codeword indexes of the word and of all words one bit away, a row each."""
    flips = np.concatenate([[0], np.int64(1) << np.arange(width)])
    return _decode_table()[np.asarray(word, np.int64)[:, None] ^ flips].astype(np.int64)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of a fingerprint, and a key of it, for all keys under which it is stored or looked up.

    A lookup under its own index is the same row as the storage. Key: three bits for the two segments' choice, the whole
    segment, the index.
    """
    u = fps.astype(np.uint64)
    parts = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = []
    for part, (_, width) in zip(parts, SEGMENTS, strict=True):
        found = np.sort(nearby_indexes(part, width), axis=1)
        fresh = np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
        row, col = np.nonzero(fresh)
        near.append((row, found[row, col]))
    rows, keys = [], []
    for choice, (whole, fuzzy) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]):
        row, index = near[fuzzy]
        rows.append(row)
        keys.append(np.int64(choice) << 34 | parts[whole][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def wide_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of a fingerprint, and a key of it: two segments, and an index near each of them."""
    u = fps.astype(np.uint64)
    near = []
    for s, width in SEGMENTS:
        found = np.sort(nearby_indexes(((u >> np.uint64(s)) & np.uint64((1 << width) - 1)).astype(np.int64), width), axis=1)
        fresh = np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
        row, col = np.nonzero(fresh)
        near.append((np.cumsum([0, *np.bincount(row, minlength=len(u))]), found[row, col]))
    rows, keys = [], []
    for choice, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (at_a, own_a), (at_b, own_b) = near[a], near[b]
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        row = np.repeat(np.arange(len(u)), n_a * n_b)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n_a * n_b) - n_a * n_b, n_a * n_b)
        first, second = own_a[at_a[row] + place // n_b[row]], own_b[at_b[row] + place % n_b[row]]
        rows.append(row)
        keys.append(np.int64(choice) << 24 | first << 12 | second)
    return np.concatenate(rows), np.concatenate(keys)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(fps: np.ndarray, max_bits: int = MAX_BITS, more: np.ndarray | None = None, more_bits: int = 0) -> np.ndarray:
    """For each of distinct fingerprints (unsigned), the first position that it reaches over links among them.

    With more, a second fingerprint of each, a link must also hold to so many bits there.

    Up to DENSE are traversed breadth first, each against those not yet reached. More are dealt by each of max_bits + 1
    pieces of their bits in turn, since linked ones agree in one piece at least, and what agrees is dealt by the other bits.
    """
    label = list(range(len(fps)))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)

    def traverse(members: np.ndarray) -> None:
        while len(members) > 1:
            first, members, todo = int(members[0]), members[1:], [int(members[0])]
            while todo and len(members):
                own = todo.pop()
                near = distance(fps[members], fps[own]) <= max_bits
                if more is not None:
                    near &= distance(more[members], more[own]) <= more_bits
                if near.any():
                    for x in members[near].tolist():
                        union(first, x)
                    todo.extend(members[near].tolist())
                    members = members[~near]

    def deal(members: np.ndarray, bits: np.ndarray) -> None:
        if len(members) <= DENSE or len(bits) < 2 * (max_bits + 1):
            traverse(members)
            return
        for piece in np.array_split(bits, max_bits + 1):
            own = fps[members] & np.bitwise_or.reduce(np.uint64(1) << piece)
            order = np.argsort(own, kind="stable")
            for group in np.split(members[order], np.flatnonzero(np.diff(own[order])) + 1):
                if len(group) > 1:
                    deal(np.sort(group), np.setdiff1d(bits, piece))

    deal(np.arange(len(fps)), np.arange(64, dtype=np.uint64))
    return np.fromiter((find(i) for i in range(len(fps))), np.int64, len(fps))


def bucket_links(keys: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all links within each run of equal keys."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(cuts)
    small, a, b = np.repeat(sizes <= 8, sizes), [], []
    for off in range(1, 8):
        near = np.flatnonzero(small[off:] & (keys[off:] == keys[:-off]) & (distance(fps[off:], fps[:-off]) <= max_bits))
        a.append(fps[near])
        b.append(fps[near + off])
    for k in np.flatnonzero(sizes > 8):
        own = np.unique(fps[cuts[k] : cuts[k + 1]])
        label = forest(own, max_bits)
        far = np.flatnonzero(label != np.arange(len(own)))
        a.append(own[label[far]])
        b.append(own[far])
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame) -> DataFrame:
    """a, b: links among the distinct fingerprints in column fp that span the components of all links."""
    key_schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def key_rows(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 4_096):
                row, key = bucket_keys(own[at : at + 4_096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[at : at + 4_096][row])], schema=key_schema)

    def link_rows(batches):
        keys, own = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            a, b = bucket_links(k, f)
            both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], schema=link_schema)

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            own = np.concatenate([own, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) >= 100_000 and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                yield out(keys[:cut], own[:cut])
                keys, own = keys[cut:], own[cut:]
        if len(keys):
            yield out(keys, own)

    keyed = fps.select("fp").mapInArrow(key_rows, "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(link_rows, "a long, b long").distinct()


def wide_bucket_links(keys: np.ndarray, fps: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Rows (fp, more, fp, more) that span the same components as all wide links within each run of equal keys; no row twice."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(cuts)
    small, out = np.repeat(sizes <= 16, sizes), []
    for off in range(1, 16):
        a, b = slice(None, -off), slice(off, None)
        near = np.flatnonzero(small[b] & (keys[b] == keys[a]) & (distance(fps[b], fps[a]) <= WIDE_BITS))
        near = near[distance(more[near], more[near + off]) <= SHINGLE_BITS]
        out.append(np.stack([fps[near], more[near], fps[near + off], more[near + off]], axis=1))
    for k in np.flatnonzero(sizes > 16):
        own, theirs = fps[cuts[k] : cuts[k + 1]], more[cuts[k] : cuts[k + 1]]
        label = forest(own, WIDE_BITS, theirs, SHINGLE_BITS)
        far = np.flatnonzero(label != np.arange(len(own)))
        out.append(np.stack([own[label[far]], theirs[label[far]], own[far], theirs[far]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def wide_links(groups: DataFrame) -> DataFrame:
    """a, b (structs fp, more): links among the distinct pairs of fingerprints fp, more that span the components of all wide links."""
    key_schema = pa.schema([("key", pa.int32()), ("fp", pa.int64()), ("more", pa.int64())])
    names = ("a_fp", "a_more", "b_fp", "b_more")
    link_schema = pa.schema([(n, pa.int64()) for n in names])

    def key_rows(batches):
        for batch in batches:
            fp, more = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(fp), 1_024):
                row, key = wide_keys(fp[at : at + 1_024])
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[at : at + 1_024][row]), pa.array(more[at : at + 1_024][row])], schema=key_schema)

    def link_rows(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]

        def out(k, f, m):
            found = wide_bucket_links(k, f, m).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in range(4)], schema=link_schema)

        for batch in batches:
            fresh = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (1, 2))]
            held = [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            keys = held[0]
            if len(keys) >= 100_000 and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                yield out(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield out(*held)

    keyed = groups.select("fp", "more").mapInArrow(key_rows, "key int, fp long, more long")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link_rows, ", ".join(f"{n} long" for n in names)).distinct()
    named = found.select(F.struct(F.col("a_fp").alias("fp"), F.col("a_more").alias("more")).alias("a"), F.struct(F.col("b_fp").alias("fp"), F.col("b_more").alias("more")).alias("b"))
    return contracted(contracted(named))


def contracted(edges: DataFrame) -> DataFrame:
    """Links a, b with the same components, and fewer of them: b keeps its least a, to which its other ones are linked instead.

    Many nodes share their roots, so what is linked anew is mostly the same few pairs. Nothing is gathered into a list.
    """
    least = edges.select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("least"))
    both = F.explode(F.array(F.struct(F.col("least").alias("a"), "b"), F.struct(F.col("least").alias("a"), F.col("a").alias("b"))))
    return least.select(both.alias("link")).select("link.a", "link.b").where("a != b").distinct()


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, component_id (the smallest doc_id reached over wide links), stays (one row of each component) for every row."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_key", "fp", "more")])

    def run(batches):
        rows = ((i, k, _signed(word_simhash(t)), _signed(simhash(t, WIDE_SHINGLE))) for i, k, t in common.rows_of(batches, "doc_id", "text_key", "text"))
        yield from common.record_batches(rows, schema, 10_000)

    made = common.keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, fp long, more long")
    rows = common.saved(made, "fingerprints").select("doc_id", "text_key", F.struct("fp", "more").alias("both"))
    return _resolved(rows, "both", lambda groups: wide_links(groups.select("both.fp", "both.more")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reached) of every node of the edges a, b.

    Labels go to neighbours and then to their labels' labels (pointer jumping), so rounds are about the logarithm of the
    longest path; each round is a saved table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = common.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        top = labels.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        labels = common.saved(low.join(top, "mid").select("node", F.least("mid", "top").alias("root"), (F.least("mid", "top") != F.col("old")).alias("moved")), "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, fp, component_id (the smallest doc_id reached), stays (one row of each component) for every row."""
    rows = common.saved(fingerprints(docs, doc_id, text), "fingerprints")
    out = _resolved(rows, "fp", links)
    return out.select("doc_id", "text_key", "fp", "component_id", "stays")


def _resolved(rows: DataFrame, node: str, linked) -> DataFrame:
    """rows (saved: doc_id, text_key, the node of each) with component_id and stays, by the links among their distinct nodes."""
    total = rows.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    groups = common.saved(rows.groupBy(node).agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    edges = common.saved(linked(groups), "links")
    roots = components(edges).withColumnRenamed("node", node)
    rooted = groups.join(roots, node, "left").select(node, "first", "n", F.coalesce("root", node).alias("root"))
    least = rooted.groupBy("root").agg(F.min(F.struct("first.no_id", "first.doc_id", "first.text_key")).alias("least"))
    mapped = common.saved(rooted.join(least, "root").select(node, "n", F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("stay_key")), "components")
    out = common.joined_by_key(rows, mapped, node, "n", total)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("stay_key"))
    return out.withColumn("stays", stays)


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """One row of docs for each component, with all its columns; wide: of the components of similar()."""
    found = similar(docs, doc_id, text).select("doc_id", "text_key", "stays") if wide else near_dedup(docs, doc_id, text)
    return common.keep_rows(docs, found.where("stays"), doc_id, text)
