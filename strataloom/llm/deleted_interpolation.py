"""LM scoring by deleted interpolation.

A text's tokens are its words (A-Z in lower case) and one end. The probability of a token given the one before mixes three
estimates: uniform over the training vocabulary and one unknown word, maximum likelihood of the token, maximum likelihood of
the pair. The weights belong to the bucket (by powers of two) of the context's training frequency. They are learned by
expectation-maximisation on counts held out from the training texts: the pairs of deleted texts, under estimates from the
other training texts. Scores then use the counts of all training texts. The end of the text before is the context of a
text's first token.

How the counts meet the texts, at any size: texts are gathered into chunks of so many tokens with a local dictionary; a chunk asks once for each of its distinct words and pairs (64-bit hashes, sorted, in packed differences), with
its own counts, so a frequent word costs a row of a chunk and not of a text; ranges of the hash space sum the counts of all
chunks and answer each in its own order; chunk and answers meet by the chunk's id. Chunks and ranges hold CHUNK_TOKENS and
RANGE_KEYS, and beyond some 10^10 tokens ROOT times the square root of all tokens, so there is at most one row of a chunk and
range for ROOT^2 tokens: rows grow with the input and not with its square, and a task's memory with the root. Nothing that
grows is sent to the driver: it gets the totals and a histogram of likelihood ratios over a fixed grid, each cell with the
means of its logarithms.

Defined results: a null text counts as the empty one, whose only token is the end; a null doc_id hashes as the empty text;
texts that repeat are scored and counted each time; without training texts all tokens are unknown and the probability is
uniform; without deleted texts DEFAULT_WEIGHTS hold. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_TOKENS = 1_000_000
#: Words and pairs of chunks that one range of the hash space is planned for.
RANGE_KEYS = 1_500_000
ROOT = 10
#: Bytes of input to a token, in the estimate of how many tokens there are.
TOKEN_BYTES = 4
FOLDS = 10
HELD_OUT, DELETED = 0, 9
#: The parts that a text can belong to: scored only, estimating, deleted.
SCORED, ESTIMATING, DELETED_PART = 0, 1, 2
END = xxhash.xxh64_intdigest(b"\n")
#: Powers of two of a context's frequency, 0 for frequency 0.
BUCKETS = 48
#: Likelihood ratios are counted by quarters of a power of two.
GRID = 4
DEFAULT_WEIGHTS = (0.1, 0.4, 0.5)
EM_ROUNDS = 60
ALPHA = 0.1

CHUNK = "chunk long, part int, tokens long, ids binary, lens binary, words binary, stream binary"
ANSWER = "chunk long, range int, word binary, pair binary, word_est binary, pair_est binary, n long, v long, n_est long, v_est long"


def planned(tokens: int) -> tuple[int, int]:
    """Tokens of a chunk, and ranges of the hash space, for so many tokens."""
    root = ROOT * math.isqrt(tokens)
    return max(CHUNK_TOKENS, root), max(1, -(-tokens // max(RANGE_KEYS, root)))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS) -> DataFrame:
    """Rows of texts in chunks of one part each: ids, words a text, hashes of the distinct words, the words' local numbers."""
    fold = common.crc_remainder(doc_id, FOLDS)
    part = F.when(fold == HELD_OUT, SCORED).when(fold == DELETED, DELETED_PART).otherwise(ESTIMATING)
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("tokens", pa.int64()), *((n, pa.binary()) for n in ("ids", "lens", "words", "stream"))])

    def run(batches):
        task, serial, open_chunks, counted = TaskContext.get().partitionId(), itertools.count(), {}, {}

        def row(part):
            ids, numbers, streams = open_chunks.pop(part)
            own = list(numbers)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
            stream = np.concatenate(streams)
            id_bytes = b"".join(bytes([i is not None]) + (i or 0).to_bytes(8, "little", signed=True) for i, _ in ids)
            lens = np.array([n for _, n in ids], np.uint32)
            values = (task << 32 | next(serial), part, len(stream) + len(ids), id_bytes, lens.tobytes(), hashes.tobytes(), zstandard.compress(common.pack(stream), 1))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for i, part, text in common.rows_of(batches, "doc_id", "part", "text"):
            if part not in open_chunks:
                numbers = defaultdict()
                numbers.default_factory = itertools.count().__next__
                open_chunks[part], counted[part] = ([], numbers, []), 0
            ids, numbers, streams = open_chunks[part]
            ws = common.words(text)
            streams.append(np.fromiter(map(numbers.__getitem__, ws), np.uint32, len(ws)))
            ids.append((i, len(ws)))
            counted[part] += len(ws) + 1
            if counted[part] >= size:
                yield row(part)
        for part in sorted(open_chunks):
            yield row(part)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), part.alias("part"), F.col(text).alias("text")).mapInArrow(run, CHUNK)


def _streams(lens: bytes, words: bytes, stream: bytes) -> tuple[np.ndarray, ...]:
    """Starts of the texts, local numbers of tokens and of their contexts, hashes of all local words with the end."""
    lens = np.frombuffer(lens, np.uint32).astype(np.int64)
    hashes = np.append(np.frombuffer(words, np.uint64), np.uint64(END))
    own = common.unpack(zstandard.decompress(stream)).astype(np.uint32)
    ends = np.cumsum(lens + 1) - 1
    token = np.full(len(own) + len(lens), len(hashes) - 1, np.uint32)
    inside = np.ones(len(token), bool)
    inside[ends] = False
    token[inside] = own
    return np.concatenate([[0], ends[:-1] + 1]), token, np.roll(token, 1), hashes


def _pair_keys(token: np.ndarray, context: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first = common.mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return common.mix64(first[context] + hashes[token])


def requests(chunk_rows: DataFrame, ranges: int) -> DataFrame:
    """A row for each chunk and range of the hash space: its distinct words and pairs there, and how often each."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("range", pa.int32()), *((n, pa.binary()) for n in ("word", "word_n", "pair", "pair_n"))])
    edges = np.array([-(-(k << 64) // ranges) for k in range(1, ranges)], np.uint64)

    def run(batches):
        for chunk, part, lens, words, stream in common.rows_of(batches, "chunk", "part", "lens", "words", "stream", step=1):
            _, token, context, hashes = _streams(lens, words, stream)
            order = np.argsort(hashes)
            word, word_n = hashes[order], np.bincount(token, minlength=len(hashes))[order]
            pair, pair_n = np.unique(_pair_keys(token, context, hashes), return_counts=True)
            cut_w = [0, *np.searchsorted(word, edges).tolist(), len(word)]
            cut_p = [0, *np.searchsorted(pair, edges).tolist(), len(pair)]
            rows = [
                (chunk, part, k, common.pack_sorted(word[a:b]), common.pack(word_n[a:b]), common.pack_sorted(pair[c:d]), common.pack(pair_n[c:d]))
                for k, (a, b, c, d) in enumerate(zip(cut_w, cut_w[1:], cut_p, cut_p[1:], strict=False))
            ]
            yield from common.record_batches(iter(rows), schema, 64)

    ddl = "chunk long, part int, range int, word binary, word_n binary, pair binary, pair_n binary"
    return chunk_rows.select("chunk", "part", "lens", "words", "stream").mapInArrow(run, ddl)


def answers(asked: DataFrame) -> DataFrame:
    """To each chunk from each range the training counts of what it asked for, in its order; a row of totals for each range."""
    schema = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), *((n, pa.binary()) for n in ("word", "pair", "word_est", "pair_est")), *((n, pa.int64()) for n in ("n", "v", "n_est", "v_est"))])

    def summed(keys, counts, part):
        at = np.cumsum([0, *map(len, keys)])
        own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n, parts = np.concatenate(counts).astype(np.float64), np.repeat(part, np.diff(at))
        est = np.bincount(inverse, n * (parts == ESTIMATING), len(own)).astype(np.uint64)
        all_n = est + np.bincount(inverse, n * (parts == DELETED_PART), len(own)).astype(np.uint64)
        return est, all_n, [inverse[a:b] for a, b in zip(at, at[1:], strict=False)]

    def packed(x):
        return zstandard.compress(common.pack(x), 1)

    def run(table: pa.Table) -> pa.Table:
        get = {c: table.column(c).to_pylist() for c in table.column_names}
        w_est, w_all, w_at = summed([common.unpack_sorted(x) for x in get["word"]], [common.unpack(x) for x in get["word_n"]], get["part"])
        p_est, p_all, p_at = summed([common.unpack_sorted(x) for x in get["pair"]], [common.unpack(x) for x in get["pair_n"]], get["part"])
        rows = [(-1, get["range"][0], None, None, None, None, int(w_all.sum()), int((w_all > 0).sum()), int(w_est.sum()), int((w_est > 0).sum()))]
        for k, (chunk, part) in enumerate(zip(get["chunk"], get["part"], strict=True)):
            est = (packed(w_est[w_at[k]]), packed(p_est[p_at[k]])) if part == DELETED_PART else (None, None)
            rows.append((chunk, get["range"][k], packed(w_all[w_at[k]]), packed(p_all[p_at[k]]), *est, None, None, None, None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return asked.groupBy("range").applyInArrow(run, ANSWER)


def with_answers(chunk_rows: DataFrame, answered: DataFrame) -> DataFrame:
    names = ["chunk", "part", "ids", "lens", "words", "stream", "range", "word", "pair", "word_est", "pair_est"]
    both = chunk_rows.unionByName(answered.where("chunk >= 0"), allowMissingColumns=True)
    return both.select(*names).groupBy("chunk")


def _joined(table: pa.Table, suffix: str = ""):
    """A chunk's streams, with the counts of words (by local number), of pairs (by token), and its ids."""
    rows = table.to_pylist()
    own = next((r for r in rows if r["stream"] is not None), None)
    got = sorted((r for r in rows if r["stream"] is None), key=lambda r: r["range"])
    starts, token, context, hashes = _streams(own["lens"], own["words"], own["stream"])
    word = np.empty(len(hashes), np.float64)
    word[np.argsort(hashes)] = np.concatenate([common.unpack(zstandard.decompress(r["word" + suffix])) for r in got])
    _, inverse = np.unique(_pair_keys(token, context, hashes), return_inverse=True)
    pair = np.concatenate([common.unpack(zstandard.decompress(r["pair" + suffix])) for r in got]).astype(np.float64)[inverse]
    return own, starts, token, context, word, pair


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 and the whole binary logarithm, BUCKETS - 1 at most."""
    return np.minimum(np.frexp(context_count)[1], BUCKETS - 1)


def held_out_counts(grouped, n: int, v: int) -> DataFrame:
    """bucket, unigram, pair, n, unigram_sum, pair_sum: how many tokens of the deleted texts have which likelihood ratios.

    Ratios to the uniform estimate, in binary logarithms: whole steps of 1/GRID name the cell (null estimates have a step of
    their own), the sums hold the exact logarithms of its tokens.
    """
    whole = [(c, pa.int64()) for c in ("bucket", "unigram", "pair", "n")]
    schema = pa.schema([*whole, ("unigram_sum", pa.float64()), ("pair_sum", pa.float64())])
    none = -(1 << 20)

    def run(table: pa.Table) -> pa.Table:
        _, _, token, context, word, pair = _joined(table, "_est")
        cw, cu = word[token], word[context]
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = [np.where((cw > 0) & (n > 0), np.log2(cw / max(n, 1) * (v + 1)), 0.0), np.where((pair > 0) & (cu > 0), np.log2(pair / np.maximum(cu, 1) * (v + 1)), 0.0)]
        r1 = np.where((cw > 0) & (n > 0), np.rint(GRID * logs[0]), none)
        r2 = np.where((pair > 0) & (cu > 0), np.rint(GRID * logs[1]), none)
        key = (bucket_of(cu).astype(np.int64) << 44) + ((r1.astype(np.int64) + (1 << 21)) << 22) + (r2.astype(np.int64) + (1 << 21))
        own, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        low = (1 << 22) - 1
        columns = [own >> 44, (own >> 22 & low) - (1 << 21), (own & low) - (1 << 21), count.astype(np.int64), *(np.bincount(inverse, x, len(own)) for x in logs)]
        return pa.table([pa.array(x) for x in columns], schema=schema)

    rows = grouped.applyInArrow(run, "bucket long, unigram long, pair long, n long, unigram_sum double, pair_sum double")
    return rows.groupBy("bucket", "unigram", "pair").agg(F.sum("n").alias("n"), F.sum("unigram_sum").alias("unigram_sum"), F.sum("pair_sum").alias("pair_sum"))


def learned_weights(histogram: list[tuple[int, int, int, int, float, float]]) -> np.ndarray:
    """Weights (uniform, unigram, pair) of each bucket by expectation-maximisation; a bucket without tokens has those of all.

    histogram: rows of held_out_counts; a cell stands for its tokens with the mean of their logarithms.
    """
    out = np.tile(np.array(DEFAULT_WEIGHTS), (BUCKETS, 1))
    if not histogram:
        return out
    rows = np.array(sorted(histogram), np.float64)
    ratio = np.stack([np.ones(len(rows)), *(np.where(rows[:, k] > -(1 << 19), np.exp2(rows[:, k + 3] / rows[:, 3]), 0.0) for k in (1, 2))], axis=1)

    def fit(which: np.ndarray) -> np.ndarray:
        weights = np.array(DEFAULT_WEIGHTS)
        for _ in range(EM_ROUNDS):
            share = ratio[which] * weights
            share *= (rows[which, 3] / share.sum(axis=1))[:, None]
            weights = share.sum(axis=0) / share.sum()
        weights = np.maximum(weights, [1e-6, 1e-9, 0.0])
        return weights / weights.sum()

    out[:] = fit(np.ones(len(rows), bool))
    for b in np.unique(rows[:, 0]):
        out[int(b)] = fit(rows[:, 0] == b)
    return out


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    size, _ = planned(common.input_bytes(docs, text) // TOKEN_BYTES)
    chunk_rows = common.saved(chunks(docs, doc_id, text, size), "chunks")
    _, ranges = planned(chunk_rows.agg(F.sum(F.col("tokens"))).first()[0] or 0)
    answered = common.saved(answers(requests(chunk_rows, ranges)), "answers")
    n, v, n_est, v_est = (int(x or 0) for x in answered.where("chunk < 0").agg(*(F.sum(c) for c in ("n", "v", "n_est", "v_est"))).first())
    deleted = chunk_rows.where(F.col("part") == DELETED_PART)
    histogram = held_out_counts(with_answers(deleted, answered.where("word_est IS NOT NULL")), n_est, v_est).collect()
    weights = learned_weights([tuple(r) for r in histogram])
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        own, starts, token, context, word, pair = _joined(table)
        cw, cu = word[token], word[context]
        base = np.log10((cw + ALPHA) / (n + ALPHA * (v + 1)))
        w = weights[bucket_of(cu)]
        w[cu == 0, 2] = 0.0
        w[:, 1] *= n > 0
        w /= w.sum(axis=1, keepdims=True)
        p = w[:, 0] / (v + 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] * pair / np.maximum(cu, 1)
        ids = [int.from_bytes(own["ids"][k + 1 : k + 9], "little", signed=True) if own["ids"][k] else None for k in range(0, len(own["ids"]), 9)]
        lens = np.frombuffer(own["lens"], np.uint32).astype(np.int64) + 1
        known = np.add.reduceat((cw > 0).astype(np.int64), starts)
        size = len(ids)
        columns = [ids, [own["part"] == SCORED] * size, lens, known, np.full(size, n), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return with_answers(chunk_rows, answered).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
