"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to ORDER with counts of the bytes that followed, frozen after training.
A byte's code length is that of prediction by partial matching with escape method C: in the longest context that the tree
holds, a byte seen there so often out of T with D different bytes costs log2((T + D) / count); one not seen costs the escape,
log2((T + D) / D), and is coded in the next shorter context; below order 0 all 256 bytes are alike. Contexts that the tree
does not hold cost nothing. The language with the least total is predicted. Bytes are folded first: A-Z to a-z, white space
to the space, digits to the nought; all other bytes are symbols of their own.

Because the statistics are frozen, a byte's cost depends on ORDER bytes before it only. For each order the runs of bytes seen
in training are kept with their costs, found by hashing; a byte whose run is not among them pays the escape of its context
and is looked up in the next order. So a text is scored by table look-ups, many texts at a time.

The trees are fitted on a sample of labelled texts, bounded by SAMPLE_TEXTS for each language (documented parameter): texts
with the least hashed doc_id, whole. Predictions cover all rows.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned; ties
go to the first language by code point; rows that repeat are predicted alike; an empty table gives an empty result. The score
is the predicted language's posterior where n bytes count as sqrt(n) independent ones. Other columns of the input are not
read, and recognised() hands them on as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER = 3
#: Bits of a byte below order 0.
LOWEST_BITS = 8.0
SAMPLE_TEXTS = 3_000
FOLDS, HELD_OUT = 4, 2
#: A text that costs so many bits a byte is explained no better than by its raw bytes.
REJECTED_BITS = 8.0
UNKNOWN = "und"
#: Costs (a byte and a language each) that are worked out at a time.
BLOCK = 4 << 20
LETTER = regex.compile(r"\p{L}")
ASCII_LETTER = regex.compile(rb"[A-Za-z]")


def folding() -> np.ndarray:
    """The byte that each byte counts as."""
    fold = np.arange(256)
    fold[65:91] += 32
    fold[9:14] = 32
    fold[48:58] = 48
    return fold.astype(np.uint8)


FOLD = folding()


def text_codes(block: bytes) -> np.ndarray:
    """Of each byte its ORDER bytes before and its own as one number; before the first byte stands white space."""
    own = FOLD[np.frombuffer(block, np.uint8)]
    code, padded = own.astype(np.uint32), np.concatenate([np.full(ORDER, 32, np.uint8), own])
    for k in range(1, ORDER + 1):
        code |= padded[ORDER - k : len(padded) - k].astype(np.uint32) << np.uint32(8 * k)
    return code


class Places:
    """Where a number stands among distinct ones, by open addressing in a table at most a quarter full; -1 for others."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers.astype(np.uint32)
        self.bits = max(4, (4 * max(1, len(numbers)) - 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(numbers), dtype=np.int32), self._slot(self.numbers)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]  # of several for one slot, the last is there
            left = self.table[at] != todo
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * np.uint32(2_654_435_769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.numbers):
            return np.full(len(numbers), -1, np.int32)
        at = self._slot(numbers)
        out = self.table[at]
        todo = np.flatnonzero((out >= 0) & (self.numbers[out] != numbers))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[todo] = found = self.table[at]
            left = (found >= 0) & (self.numbers[found] != numbers[todo])
            todo, at = todo[left], at[left]
        return out


@dataclass(frozen=True)
class Level:
    """One order: runs of bytes seen in training with their bits, and contexts with the bits of their escape; a column a language."""

    codes: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


@dataclass(frozen=True)
class Trees:
    """langs in order; levels: of orders 0 to ORDER."""

    langs: list[str]
    levels: list[Level]


def levels_of(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels from distinct runs of ORDER + 1 bytes and how often each language has them."""
    out: list[Level] = []
    for order in range(ORDER + 1):
        own, which = np.unique(codes & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        n = np.stack([np.bincount(which, counts[:, k], len(own)) for k in range(counts.shape[1])], axis=1)
        contexts, context = np.unique(own >> np.uint32(8), return_inverse=True)
        total, different = (np.stack([np.bincount(context, x[:, k], len(contexts)) for k in range(n.shape[1])], axis=1) for x in (n, n > 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + different) / different), 0.0)
            seen = np.log2((total + different)[context] / n)
        shorter = out[-1].bits[np.searchsorted(out[-1].codes, own & np.uint32((1 << 8 * order) - 1))] if out else LOWEST_BITS
        out.append(Level(own, np.where(n > 0, seen, escape[context] + shorter), contexts, escape))
    return [Level(x.codes, x.bits.astype(np.float32), x.contexts, x.escape.astype(np.float32)) for x in out]


def _counts(labelled: DataFrame) -> pa.Table:
    """lang, code, n of all runs of ORDER + 1 bytes of the labelled sample: their number is bounded by the sample."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def code_rows(batches):
        held: dict[bytes, list[np.ndarray]] = {}

        def out(lang):
            codes, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

        for lang, t in common.rows_of(batches, "lang", "text"):
            held.setdefault(lang, []).append(text_codes(t))
            if sum(map(len, held[lang])) > BLOCK:
                yield out(lang)
        for lang in sorted(held):
            yield out(lang)

    return labelled.select("lang", "text").mapInArrow(code_rows, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_TEXTS) -> Trees:
    """Trees from rows whose crc32(doc_id) modulo FOLDS is not HELD_OUT and whose lang and text are not null."""
    rows = docs.where((common.crc_remainder(doc_id, FOLDS) != HELD_OUT) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    slim = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("hashed"))
    sizes = {r["lang"]: r["count"] for r in slim.groupBy("lang").count().collect()}
    if not sizes:
        return Trees([], [])
    # Hashes are uniform, so a share of them holds about so many rows of a language; rows beyond the bound are cut after that.
    shares = docs.sparkSession.createDataFrame([(k, float(min(1.0, 1.2 * sample / n + 10 / n))) for k, n in sizes.items()], "lang string, share double")
    near = slim.join(F.broadcast(shares), "lang").where((F.col("hashed") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hashed"))
    labelled = common.saved(near.withColumn("at", first).where(F.col("at") <= sample).select("lang", "text"), "sample")
    return fitted(_counts(labelled))


def fitted(counted: pa.Table) -> Trees:
    """Trees from a table of (lang, code, n)."""
    lang = counted.column("lang").combine_chunks().dictionary_encode()
    names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    langs = sorted(names)
    codes, at = np.unique(counted.column("code").to_numpy().astype(np.uint32), return_inverse=True)
    counts = np.zeros((len(codes), len(langs)))
    counts[at, np.array([langs.index(x) for x in names])[which]] = counted.column("n").to_numpy()
    return Trees(langs, levels_of(codes, counts))


class Scorer:
    def __init__(self, trees: Trees):
        self.trees = trees
        self.found = [(Places(x.codes), Places(x.contexts)) for x in trees.levels]

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """The bits of each byte, given with its context, a column a language."""
        out = np.zeros((len(codes), len(self.trees.langs)), np.float32)
        rows = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            level, (runs, contexts) = self.trees.levels[order], self.found[order]
            at = runs.find(codes)
            there = at >= 0
            if order == ORDER and there.all():
                return level.bits[at]
            out[rows[there]] += level.bits[at[there]]
            rows, codes = rows[~there], codes[~there]
            if not len(rows):
                return out
            context = contexts.find(codes >> np.uint32(8))
            held = context >= 0
            out[rows[held]] += level.escape[context[held]]
            codes = codes & np.uint32((1 << 8 * order) - 1)
        out[rows] += np.float32(LOWEST_BITS)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Total code length of each text by each language."""
        out = np.zeros((len(texts), len(self.trees.langs)))
        most = max(1 << 12, BLOCK // len(self.trees.langs))
        held: list[tuple[int, np.ndarray]] = []

        def add():
            cost = self.costs(np.concatenate([c for _, c in held]))
            starts = np.cumsum([0, *(len(c) for _, c in held[:-1])])
            np.add.at(out, [k for k, _ in held], np.add.reduceat(cost, starts, axis=0, dtype=np.float64))
            held.clear()

        size = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text), most):
                lead = text[max(0, at - ORDER) : at]
                held.append((k, text_codes(lead + text[at : at + most])[len(lead) :]))
                size += len(held[-1][1])
                if size >= most:
                    add()
                    size = 0
        if held:
            add()
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, float]]:
        """(lang, score, bits a byte) of each text; b"" is a text without letters."""
        out = []
        bits = self.bits(texts) if self.trees.langs else None
        for k, text in enumerate(texts):
            if bits is None or not (ASCII_LETTER.search(text) or LETTER.search(text.decode("utf-8", "replace"))):
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            each = bits[k] / len(text)
            best = int(np.argmin(each))
            weight = np.exp2(-(each - each[best]) * np.sqrt(len(text)))
            out.append((self.trees.langs[best], float(1 / weight.sum()), float(each[best])))
        return out


def language_column(spark: SparkSession, trees: Trees, text: str = "text") -> Column:
    """struct(lang, score, bits) of a text column; rows keep all else they have."""
    held = spark.sparkContext.broadcast(trees)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])
    kept: list[Scorer] = []

    @F.arrow_udf("struct<lang:string,score:double,bits:double>")
    def language(column: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Scorer(held.value))
        out = []
        for at in range(0, len(column), 64):
            texts = [x or b"" for x in column.slice(at, 64).cast(pa.large_binary()).to_pylist()]
            out += [dict(zip(("lang", "score", "bits"), r, strict=True)) for r in kept[0].predict(texts)]
        return pa.array(out, kind)

    return language(F.col(text))


def recognised(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The rows of docs that some learned language explains better than raw bytes would; `und` goes."""
    (own,) = common.free_names(docs, "language")
    found = docs.withColumn(own, language_column(docs.sparkSession, trees, text))
    return found.where((F.col(own)["lang"] != UNKNOWN) & (F.col(own)["bits"] < REJECTED_BITS)).drop(own)
