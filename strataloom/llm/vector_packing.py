"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly over a fixed number of shards.

Rows with equal texts form a group and go to one shard. Groups are packed in descending order of their largest share of a
total, each into the shard where the dot product of its shares with the shard's residual capacity is highest (ties: the lowest
shard). At any size that goes in two rounds. A group that holds more than 1 / (shards * LARGE) of some total is left for the
second round; all others are dealt by hash into buckets, and each bucket packs its own groups, one after another in
descending order, into as many bins as there are shards, holding nothing but the bins' residual capacities. The second round
packs the bins of all buckets and the large groups into the shards, by the same rule on the driver: at most MOST_BUCKETS *
shards bins, and at most 3 * shards * LARGE large groups, whatever the size of the input.

A group is never cut, so a shard with a group above its capacity is larger than the others; with cut_above, a share of a
shard's capacity (off by default), larger groups are cut by hashed doc_id into pieces of 1 / LARGE of a shard at most.

Defined results: a null text counts as the empty one and has no bytes; size is the UTF-8 bytes plus 8; rows that repeat go
together; slots of a shard are gapless from 0; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, mixing

LARGE = 256
#: Groups that a bucket is planned for, as long as that makes no more buckets than MOST_BUCKETS.
BUCKET_GROUPS = 20_000
MOST_BUCKETS = 4_096
MEASURES = ("size", "tokens", "n")
#: Rows of a shard that are numbered in one task.
BLOCK_ROWS = 200_000
ROW_BYTES = 8


class Packer:
    """Bins with a capacity of 1 in each dimension, filled one load after another."""

    def __init__(self, bins: int, dimensions: int):
        self.residual = np.ones((bins, dimensions))

    def place(self, share: np.ndarray) -> int:
        at = int(np.argmax(self.residual @ share))
        self.residual[at] -= share
        return at


def pack_vectors(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of loads (one column a dimension)."""
    share = loads / np.maximum(loads.sum(axis=0), 1e-9) * shards
    packer, out = Packer(shards, loads.shape[1]), np.zeros(len(loads), np.int64)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        out[k] = packer.place(share[k])
    return out


def binned(groups: DataFrame, shards: int, buckets: int, total: list[float]) -> DataFrame:
    """digest, bucket, bin, size, tokens, n of groups (digest, size, tokens, n, share): each bucket packs its own into its bins.

    A task gets a bucket's groups in descending order of share and streams them.
    """
    schema = pa.schema([("digest", pa.binary()), ("bucket", pa.int32()), ("bin", pa.int32()), *((c, pa.int64()) for c in MEASURES)])

    def run(batches):
        packer, bucket, capacity = None, None, np.maximum(np.array(total), 1) / (shards * buckets)
        for batch in batches:
            loads = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(MEASURES))], axis=1)
            shares, bins = loads / capacity, []
            for share, own in zip(shares, batch.column(1).to_pylist(), strict=True):
                if own != bucket:
                    packer, bucket = Packer(shards, len(MEASURES)), own
                bins.append(packer.place(share))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins, pa.int32()), *batch.columns[2:]], schema=schema)

    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = groups.select("digest", bucket, *MEASURES, "share").repartition(buckets, "bucket").sortWithinPartitions("bucket", F.desc("share"), "digest")
    return dealt.drop("share").mapInArrow(run, "digest binary, bucket int, bin int, size long, tokens long, n long")


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = common.text_or_empty(text)
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("bytes"), mixing.word_count(whole).alias("tokens"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
    )


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", cut_above: float | None = None) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot for every row of docs."""
    spark = docs.sparkSession
    rows = common.saved(_measured(docs, doc_id, text).withColumn("size", F.col("bytes") + ROW_BYTES), "measured")
    whole = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total = whole.agg(F.count(F.lit(1)).alias("groups"), *(F.sum(c).alias(c) for c in MEASURES)).first()
    totals = [float(total[c] or 0) for c in MEASURES]
    share: Column = F.greatest(*(F.col(c) / F.lit(max(1.0, t)) for c, t in zip(MEASURES, totals, strict=True)))
    groups = common.saved(whole.withColumn("share", share), "groups")
    is_large = F.col("share") * (shards * LARGE) > 1
    cut = groups.where(is_large & (F.col("share") * shards > cut_above)) if cut_above is not None else groups.limit(0)
    cut = cut.select("digest", F.ceil(F.col("share") * (shards * LARGE)).alias("pieces"))
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.col("pieces")).cast("int").alias("piece")
    cut_rows = rows.join(F.broadcast(cut), "digest").select("*", piece)  # cut: at most 3 * shards * LARGE groups
    pieces = cut_rows.groupBy("digest", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect() if cut_above is not None else []

    buckets = max(1, min(MOST_BUCKETS, -(-int(total["groups"]) // BUCKET_GROUPS)))
    small = common.saved(binned(groups.where(~is_large), shards, buckets, totals), "bins")
    bins = small.groupBy("bucket", "bin").agg(*(F.sum(c).alias(c) for c in MEASURES)).collect()
    large = groups.where(is_large).select("digest", *MEASURES).collect()
    cut_digests = {bytes(r["digest"]) for r in pieces}
    items = [(None, r["bucket"], r["bin"], r) for r in bins] + [(bytes(r["digest"]), None, r["piece"], r) for r in pieces]
    items += [(bytes(r["digest"]), None, None, r) for r in large if bytes(r["digest"]) not in cut_digests]
    items.sort(key=lambda x: (x[0] or b"", -1 if x[1] is None else x[1], -1 if x[2] is None else x[2]))
    placed = pack_vectors(np.array([[r[c] for c in MEASURES] for *_, r in items], float).reshape(-1, len(MEASURES)), shards)
    plan = [(bytearray(d) if d is not None else None, b, p, int(s)) for (d, b, p, _), s in zip(items, placed, strict=True)]
    plan_table = common.saved(spark.createDataFrame(plan, "digest binary, bucket int, part int, shard int"), "plan")

    by_bin = plan_table.where("digest IS NULL").select("bucket", F.col("part").alias("bin"), "shard")
    by_digest = small.join(F.broadcast(by_bin), ["bucket", "bin"]).select("digest", "n", "shard")  # at most MOST_BUCKETS * shards rows
    whole_large = plan_table.where("digest IS NOT NULL AND part IS NULL").join(groups.select("digest", "n"), "digest").select("digest", "n", "shard")
    count = int(total["n"] or 0)
    sharded = common.joined_by_key(rows, common.saved(by_digest.unionByName(whole_large), "shards"), "digest", "n", count)
    columns = ["doc_id", "size", "tokens", "text_crc32", "shard"]
    out = sharded.select(columns)
    if cut_digests:
        by_piece = plan_table.where("part IS NOT NULL AND digest IS NOT NULL").select("digest", F.col("part").alias("piece"), "shard")
        out = out.unionByName(cut_rows.join(F.broadcast(by_piece), ["digest", "piece"]).select(columns))
    return _with_slots(common.saved(out, "sharded"), count, shards)


def _with_slots(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """A shard's rows are numbered in blocks by hashed doc_id, each block after those before it."""
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    block = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int")
    blocked = rows.withColumn("block", block)
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")) - 1
    numbered = blocked.withColumn("number", number).join(offsets, ["shard", "block"])
    return numbered.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("number") + F.col("offset")).cast("long").alias("slot"))
