"""Token-ID output as ORC.

Each text is encoded with the tokenizers library; its ids and the end id are written as a row of an ORC table in ascending
doc_id order: one range of doc_ids a file, integers in ORC's run-length encoding, row indexes every STRIDE rows and Bloom
filters on doc_id, so readers take stripes in parallel and skip stripes and row groups by their doc_ids.

Texts are taken apart into words and pieces by word_pieces; the library encodes the pieces that a worker does not remember,
many in one call.

Defined results: a null text counts as the empty one and has only the end id; rows that repeat a doc_id stand in the order
of their texts' XXH64, and many such may fill several files; a null doc_id stands first; an empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from . import common, word_pieces

END_ID = 2
#: New pieces that the library is given in one call.
CALL_PIECES = 2_000
#: Bytes of texts whose words are numbered together: about what one file has (FILE_BYTES are compressed).
SHARED_BYTES = 32 << 20
STRIDE = 1_000
STRIPE_BYTES = 16 << 20
#: Input bytes that one file is planned for, as long as that makes no more files than MOST_FILES.
FILE_BYTES = 16 << 20
MOST_FILES = 100_000
ORC_OPTIONS = {
    "compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE_BYTES),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


def library_pieces(tokenizer_path: str) -> word_pieces.Encode:
    """The library's model on pieces, many in one call; each piece's last token carries the end-of-word mark, so they come apart again."""
    model = Tokenizer.from_file(tokenizer_path)
    ends = np.zeros(model.get_vocab_size(), bool)
    ends[[i for t, i in model.get_vocab(with_added_tokens=False).items() if t.endswith(word_pieces.WORD_END)]] = True
    model.normalizer, model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for at in range(0, len(pieces), CALL_PIECES):
            lines = word_pieces.in_symbols(pieces[at : at + CALL_PIECES])
            out.append(np.array(model.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.int32))
        ids = np.concatenate(out)
        lens = np.diff(np.flatnonzero(ends[ids]) + 1, prepend=0)
        if len(lens) != len(pieces):
            raise ValueError("the model's tokens do not mark where pieces end")
        return ids, lens

    return encode


_encoders: dict[str, word_pieces.WordPieces] = {}


def encoder_of(tokenizer_path: str) -> word_pieces.WordPieces:
    """A worker's encoder; it goes on knowing its pieces, up to word_pieces.MEMO_BYTES, from task to task."""
    if tokenizer_path not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_path] = word_pieces.WordPieces(tokenizer_path, library_pieces(tokenizer_path))
    return _encoders[tokenizer_path]


TOKENS = "doc_id long, start long, n_tokens long, tokens array<int>"


def _encoded(tokenizer_path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batches):
        start = 0
        for rows, flat, bounds in word_pieces.encoded_blocks(batches, "text", encoder_of(tokenizer_path), END_ID, SHARED_BYTES):
            tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
            columns = [rows.column(rows.schema.get_field_index("doc_id")), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), tokens]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            start += len(flat)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes doc_id, start (ids before it in its file), n_tokens, tokens as ORC files in ascending doc_id order.

    Texts are dealt by range before they are encoded; the range has the text's hash second, so rows of one doc_id may be split.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.row_key(text).alias("text_key"), F.col(text).alias("text"))
    size = common.input_bytes(docs, text)
    files = max(1, -(-size // max(FILE_BYTES, -(-size // MOST_FILES))))
    dealt = slim.repartitionByRange(files, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key").select("doc_id", "text")
    dealt.mapInArrow(_encoded(tokenizer_path), TOKENS).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).orc(path)


def checksums(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: start counts the ids of all documents before.

    A file's number is that of its range, so files are in order; where a file begins is a sum over a row for each file.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            tokens = batch.column(3)
            flat, at = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), tokens.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], schema=schema)

    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long").alias("file")
    rows = read_tokens(spark, path).select("doc_id", number, "start", "tokens").mapInArrow(run, "doc_id long, file long, start long, n_tokens long, ids_crc32 long")
    files = read_tokens(spark, path).select(number, "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "file").select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
