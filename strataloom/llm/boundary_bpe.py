"""BPE encoding and decoding with forced-boundary splitting.

Every token of the vocabulary is a run of byte symbols, the last of a piece marked as its end. Two symbols that stand side by
side in no token can never end up in one token, so the place between them is a certain cut: a piece is cut there, each
fragment is merged on its own (lowest rank first, then leftmost) and the ids are concatenated.

The fragments of many words are merged together, as rows of a matrix for each length: in a round every row that still has a
pair of the merge list merges its first pair of lowest rank. Fragments of more than LONG symbols are merged one by one with a
heap. Words and pieces come from word_pieces, as does the bound of what a worker remembers. Special tokens written in a text
become their ids, as in the library.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that repeat are encoded alike; texts
of any length are encoded whole; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, word_pieces
from .word_pieces import SYMBOLS, WORD_END

LONG = 32
#: Symbols that are merged in one matrix.
MATRIX_SYMBOLS = 1 << 19


def _symbols(token: str) -> list[str]:
    return [*token[: -len(WORD_END) - 1], token[-len(WORD_END) - 1 :]] if token.endswith(WORD_END) and len(token) > len(WORD_END) else [*token]


class Merges:
    """The pairs of token ids that merge, in ascending order, with their rank and what they become."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.width = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.none = pairs[order], len(merges)
        self.rank = np.append(order, self.none).astype(np.int32)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, none for those that do not merge."""
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[np.minimum(at, len(self.pairs) - 1)] == key, self.rank[at], self.none) if self.none else np.zeros(len(key), np.int32)

    def merged_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equally many ids after all merges, and how many each has then."""
        rows, width = ids.shape
        out, left = ids, np.full(rows, width)
        rank = self.ranks(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(rows, width - 1)
        own, ids = np.arange(rows), ids.copy()
        while True:
            first = rank.argmin(axis=1)
            least = rank[np.arange(len(own)), first]
            going = least < self.none
            if not going.all():
                out[own[~going]] = ids[~going]
                own, ids, rank, first, least = own[going], ids[going], rank[going], first[going], least[going]
            if not len(own):
                return out, left
            left[own] -= 1
            row = np.arange(len(own))
            after = np.arange(width) + (np.arange(width) > first[:, None])
            ids = np.take_along_axis(np.concatenate([ids, ids[:, -1:]], axis=1), after, axis=1)
            ids[row, first] = self.into[least]
            # the pair right of the merged one takes its place; the last column is free now
            rank = np.take_along_axis(np.concatenate([rank, np.full((len(own), 1), self.none, np.int32)], axis=1), after[:, : width - 1] , axis=1)
            size = left[own]
            right = first + 1 < size
            rank[row, np.minimum(first, width - 2)] = np.where(right, self.ranks(ids[row, first], ids[row, np.minimum(first + 1, width - 1)]), self.none)
            before = first > 0
            rank[row[before], first[before] - 1] = self.ranks(ids[row[before], first[before] - 1], ids[row[before], first[before]])

    def merged_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def pushed(places: list[int]) -> list[tuple[int, int, int, int]]:
            a, b = [ids[k] for k in places], [ids[after[k]] for k in places]
            return [(r, k, x, y) for r, k, x, y in zip(self.ranks(np.array(a, np.int64), np.array(b, np.int64)).tolist(), places, a, b, strict=True) if r < self.none]

        heap = pushed([*range(n - 1)])
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            to = after[k]
            if ids[k] != a or to < 0 or ids[to] != b:
                continue
            ids[k], ids[to] = int(self.into[rank]), -1
            after[k] = after[to]
            if after[k] >= 0:
                before[after[k]] = k
            for item in pushed([p for p in (before[k], k) if p >= 0 and after[p] >= 0]):
                heapq.heappush(heap, item)
        return [i for i in ids if i >= 0]


class BoundaryBpe:
    def __init__(self, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = Merges(vocab, [tuple(m) for m in spec["model"]["merges"]])
        #: Of a byte, and 256 more where it ends a piece: its token; and which two may stand side by side in a token.
        self.alone = np.array([vocab[s + end] for end in ("", WORD_END) for s in SYMBOLS], np.int32)
        number = {s + end: b + 256 * k for k, end in enumerate(("", WORD_END)) for b, s in enumerate(SYMBOLS)}
        self.inside = np.zeros((512, 512), bool)
        for token in vocab:
            own = [number[s] for s in _symbols(token)]
            self.inside[own[:-1], own[1:]] = True
        names = {v: k for k, v in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = np.array([names.get(k, "") for k in range(max(names) + 1)], object)
        self.words = word_pieces.WordPieces(tokenizer_path, self.piece_ids)

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where fragments start: after a piece's end, and between symbols that no token holds side by side."""
        cut = (symbols[:-1] >= 256) | ~self.inside[symbols[:-1], symbols[1:]]
        return np.flatnonzero(np.concatenate([[True], cut]))

    def piece_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int16)
        ends = np.cumsum(lens)
        symbols[ends - 1] += 256
        starts = self.starts(symbols)
        sizes = np.diff(starts, append=len(symbols))
        ids = self.alone[symbols]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= LONG)]).tolist():
            own = starts[sizes == size]
            for at in range(0, len(own), step := max(1, MATRIX_SYMBOLS // size)):
                places = own[at : at + step, None] + np.arange(size)
                merged, left = self.merges.merged_rows(ids[places])
                ids[places] = np.where(np.arange(size) < left[:, None], merged, -1)
        for at, size in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist(), strict=True):
            merged = self.merges.merged_long(ids[at : at + size].tolist())
            ids[at : at + size] = -1
            ids[at : at + len(merged)] = merged
        there = ids >= 0
        return ids[there], np.diff(np.cumsum(there)[ends - 1], prepend=0)

    def encode(self, text: bytes) -> np.ndarray:
        return self.words.encode_long(text)

    def decode(self, ids: np.ndarray) -> str:
        """As the library does where the tokenizer names no decoder: the tokens with a space between."""
        return " ".join(self.tokens[ids].tolist())


_bpes: dict[str, BoundaryBpe] = {}


def bpe_of(tokenizer_path: str) -> BoundaryBpe:
    """A worker's encoder; it goes on knowing its pieces, up to word_pieces.MEMO_BYTES, from task to task."""
    if tokenizer_path not in _bpes:
        _bpes.clear()
        _bpes[tokenizer_path] = BoundaryBpe(tokenizer_path)
    return _bpes[tokenizer_path]


def encoded(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded for every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        bpe = bpe_of(tokenizer_path)
        for rows, ids, bounds in word_pieces.encoded_blocks(batches, "text", bpe.words):
            decoded = [bpe.decode(ids[a:b]) for a, b in itertools.pairwise(bounds.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), lists, pa.array(decoded, pa.string())], schema=schema)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
