"""What the operators of this subpackage share: storage, byte words, skew-safe joins, packed integer arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import saved, shared_path  # noqa: F401

#: A key with at least one row in so many counts as hot; so there are at most so many hot keys, and a table of them can be broadcast.
HOT_SHARE = 2_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def crc_remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def row_key(text: str = "text"):
    """With the doc_id it names a row where ids repeat: XXH64 of the text, null as the empty one."""
    return F.xxhash64(text_or_empty(text))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, text under these names, whatever other columns docs has."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(text).alias("text_key"), F.col(text).alias("text"))


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of docs has, in upper or lower case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def keep_rows(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs whose (doc_id, text_key) is in kept, repeated rows once, with the columns of docs as they are."""
    own_id, own_key, there_id, there_key, once = free_names(docs, "own_id", "own_key", "there_id", "there_key", "once")
    marked = docs.withColumns({own_id: F.col(doc_id).cast("long"), own_key: row_key(text)})
    there = kept.select(F.col("doc_id").alias(there_id), F.col("text_key").alias(there_key))
    found = marked.join(there, F.col(own_id).eqNullSafe(F.col(there_id)) & (F.col(own_key) == F.col(there_key)), "left_semi")
    first = F.row_number().over(Window.partitionBy(own_id, own_key).orderBy(own_key))
    return found.withColumn(once, first).where(F.col(once) == 1).select(*own_columns(docs))


def input_bytes(docs: DataFrame, text: str = "text") -> int:
    """About how many bytes docs has: what its files hold, by Spark's own estimate; where Spark has none, the bytes of its texts."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 60 else int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str, step: int = 64) -> Iterator[tuple]:
    """Tuples of the named columns, a few rows of a batch at a time in Python objects; strings come as UTF-8 bytes, null strings as b""."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        columns = [c.cast(pa.large_binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in columns]
        for at in range(0, batch.num_rows, step):
            part = [c.slice(at, step) for c in columns]
            yield from zip(*([b"" if v is None else v for v in c.to_pylist()] if pa.types.is_large_binary(c.type) else c.to_pylist() for c in part), strict=True)


def record_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def words(text: bytes) -> list[bytes]:
    """The maximal runs of bytes that are not ASCII white space, A-Z in lower case."""
    return text.lower().split()


def joined_by_key(rows: DataFrame, groups: DataFrame, key: str, group_rows: str, total: int) -> DataFrame:
    """rows inner-joined to groups (one row for each key), where one key may hold a large part of all rows.

    Keys with more than total / HOT_SHARE rows are fewer than HOT_SHARE; they meet their rows by a broadcast,
    so such rows are never dealt by key. All others meet theirs by a shuffle. rows should be a saved table: it is read twice.
    """
    hot = F.col(group_rows) > max(1_000, total // HOT_SHARE)
    hot_groups = F.broadcast(groups.where(hot))
    in_hot = rows.join(hot_groups, key)
    rest = rows.join(F.broadcast(groups.where(hot).select(key)), key, "left_anti").join(groups.where(~hot), key)
    return in_hot.unionByName(rest)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, highest planes that are all zero left out: the width in a byte, then the planes."""
    values = values.astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
