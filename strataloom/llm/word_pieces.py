"""Texts to token ids by way of words and pieces, for tokenizers that drop white space and mark where a piece ends.

ASCII white space is dropped before the split into pieces and nothing is joined across it, so a text is encoded as its words
are. Many texts are taken at a time: Arrow splits them, a block after another, and numbers their distinct words; these are cut
into pieces together, the distinct pieces that are not remembered are encoded together by the encoder given, and Arrow puts the
ids of pieces in the places of words and those of words in the places of texts. Words of printable ASCII and Latin letters below
U+0250 (where Unicode versions agree and composition leaves all as they are) are cut here by the split pattern; all others by
the library's normaliser and pre-tokenizer, and are remembered whole. Texts are folded first, as the tokenizer folds A-Z.

Memory is bounded in bytes: a worker remembers pieces up to a number of bytes in two generations, never those longer than
LONGEST_KEY; a block holds about BLOCK_BYTES of text, and blocks whose words are numbered together about SHARED_BYTES.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

BLOCK_BYTES = 2 << 20
SHARED_BYTES = 16 << 20
#: Words or pieces that are Python objects at one time, besides those remembered.
AT_ONCE = 1 << 14
MEMO_BYTES = 48 << 20
LONGEST_KEY = 64
#: About what an entry takes beside its key's and value's own bytes.
ENTRY_BYTES = 180
WORD_END = "</w>"
#: The split pattern of the tokenizers read here (fixed value), and the words that are cut by it here.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = regex.compile(r"[!-~¡-¬®-ɏ\n]*")
CUT_LATIN = regex.compile(rf"{SPLIT}|\n").findall
CONTROL = re.compile(rb"[\x00-\x09\x0B-\x1F\x7F]").search
CUT_ASCII = re.compile(rb"[a-z]+|\n|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9]+").findall
#: Of pieces (bytes): their ids one after another, and how many each has.
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else free))
        free += b not in printable
    return out


SYMBOLS = byte_symbols()
_BYTE_OF = {s: b for b, s in enumerate(SYMBOLS)}
#: SYMBOLS, where line feeds stand between pieces.
_LINES = ["\n" if b == 10 else s for b, s in enumerate(SYMBOLS)]


def _cut(raw: bytes, ends: np.ndarray) -> list[bytes]:
    at = ends.tolist()
    return [raw[a:b] for a, b in zip([0, *at], at, strict=False)]


def _strings(texts: pa.Array) -> list[bytes]:
    if not len(texts):
        return []
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return _cut(data[at[0] : at[-1]].to_pybytes() if data else b"", at[1:] - at[0])


def _array(texts: list[bytes]) -> pa.LargeStringArray:
    return pa.array(texts, pa.large_binary()).view(pa.large_string())


def _lists(values: list[bytes]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]) // 4, pa.int32()), pa.array(np.frombuffer(b"".join(values), np.int32)))


def _regrouped(lists: pa.ListArray, at: np.ndarray) -> pa.ListArray:
    """Lists one after another as one, from each place to the next."""
    return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[at], pa.int32()), lists.values)


def in_symbols(pieces: list[bytes]) -> str:
    """A line for each piece; pieces have no line feeds."""
    return b"\n".join(pieces).decode("latin-1").translate(_LINES)


class Memo:
    """Bytes by key in two generations: a full young one becomes the old one, and what is met again moves up, so the frequent stay.

    Between begin and end all keys asked for are in the young one.
    """

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.long: list[bytes] = []

    def begin(self, keys: Iterable[bytes]) -> list[bytes]:
        """Of distinct keys those that are not known; the caller adds them."""
        missing = [*itertools.filterfalse(self.young.__contains__, keys)]
        again = [*filter(self.old.__contains__, missing)]
        self.add(again, [*map(self.old.__getitem__, again)])
        return [*itertools.filterfalse(self.young.__contains__, missing)] if again else missing

    def add(self, keys: Iterable[bytes], values: list[bytes]) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.held += sum(map(len, keys)) + sum(map(len, values)) + ENTRY_BYTES * len(values)

    def end(self, fresh: list[bytes]) -> None:
        for key in [k for k in fresh if len(k) > LONGEST_KEY]:
            self.held -= len(key) + len(self.young.pop(key)) + ENTRY_BYTES
        if self.held > self.most // 2:
            self.young, self.old, self.held = {}, self.young, 0

    def clear(self) -> None:
        self.young, self.old, self.held = {}, {}, 0


class WordPieces:
    """Ids of whole texts, given how pieces are encoded."""

    def __init__(self, tokenizer_path: str, encode: Encode, memo_bytes: int = MEMO_BYTES):
        self.library, self.encode_pieces = Tokenizer.from_file(tokenizer_path), encode
        spec = json.loads(self.library.to_str())
        split = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.known_split = split == [SPLIT] and all(len(CUT_LATIN(t["content"].lower())) > 1 for t in spec["added_tokens"])  # no piece is a special token
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.find_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")" if self.special else rb"(?!)")
        self.memo = Memo(memo_bytes)

    def forget(self) -> None:
        self.memo.clear()

    def _cut_by_library(self, word: bytes) -> Iterator[bytes | int]:
        """Pieces, and the ids of special tokens that the word writes out."""
        for part in self.find_special.split(word):
            if part in self.special:
                yield self.special[part]
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part.decode("utf-8", "replace"))):
                    yield bytes(map(_BYTE_OF.__getitem__, piece))

    def _by_kind(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of words of printable ASCII, of ASCII and Latin letters, of others."""
        place = np.arange(len(words))
        if not self.known_split:
            return place[:0], place[:0], place
        plain = np.fromiter(map(bytes.isascii, words), bool, len(words))
        joined = b"\n".join(itertools.compress(words, plain))
        if CONTROL(joined) or self.find_special.search(joined):
            plain &= np.fromiter((not (CONTROL(w) or self.find_special.search(w)) for w in words), bool, len(words))
        rest = [*itertools.compress(words, ~plain)]
        joined = b"\n".join(rest)
        if PLAIN.fullmatch(joined.decode("utf-8", "replace")) and not self.find_special.search(joined):
            return place[plain], place[~plain], place[:0]
        latin = np.fromiter((bool(PLAIN.fullmatch(w.decode("utf-8", "replace")) and not self.find_special.search(w)) for w in rest), bool, len(rest))
        return place[plain], place[~plain][latin], place[~plain][~latin]

    def _values(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; a line feed has none."""
        own = [*filter(b"\n".__ne__, pieces)]
        ids, lens = self.encode_pieces(own) if own else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(own) < len(pieces):
            lens = np.insert(lens, pieces.index(b"\n"), 0)
        return _cut(ids.astype(np.int32).tobytes(), np.cumsum(lens) * 4)

    def _recalled(self, keys: pa.Array, values_of: Callable[[list[bytes]], list[bytes]]) -> pa.ListArray:
        """The ids of distinct pieces or words; values_of gives those of the ones that are not remembered."""
        out = [_lists([])]
        for at in range(0, len(keys), AT_ONCE):
            own = _strings(keys.slice(at, AT_ONCE))
            fresh = self.memo.begin(own)
            self.memo.add(fresh, values_of(fresh))
            out.append(_lists([*map(self.memo.young.__getitem__, own)]))
            self.memo.end(fresh)
        return pa.concat_arrays(out)

    def _other_values(self, words: list[bytes]) -> list[bytes]:
        cut = [[*self._cut_by_library(w)] for w in words]
        own = [*{x for xs in cut for x in xs if isinstance(x, bytes)}]
        known = dict(zip(own, self._values(own), strict=True)) | {i: np.array([i], np.int32).tobytes() for i in self.special.values()}
        return [b"".join(map(known.__getitem__, xs)) for xs in cut]

    def _word_ids(self, words: pa.LargeStringArray) -> pa.ListArray:
        """The ids of each of distinct words."""
        numbered, places, others = [], [], []
        for at in range(0, len(words), AT_ONCE):
            own = _strings(words.slice(at, AT_ONCE))
            plain, latin, other = self._by_kind(own)
            cut = CUT_ASCII(b"\n".join(map(own.__getitem__, plain.tolist())).lower() + b"\n") if len(plain) else []
            if len(latin):
                cut += CUT_LATIN(b"\n".join(map(own.__getitem__, latin.tolist())).decode("utf-8", "replace").lower() + "\n")
            numbered.append(pa.array(cut, pa.large_binary()).dictionary_encode())
            places += [plain + at, latin + at]
            others.append(other + at)
        if not numbered:
            return _lists([])
        numbered = pa.chunked_array(numbered).unify_dictionaries().chunks
        pieces, number = numbered[0].dictionary, pa.concat_arrays([x.indices for x in numbered])
        ends = np.flatnonzero(number.to_numpy() == pc.index(pieces, b"\n").as_py()) + 1
        others = np.concatenate(others)
        cut_here = _regrouped(self._recalled(pieces, self._values).take(number), np.concatenate([[0], ends]))
        out = pa.concat_arrays([cut_here, self._recalled(words.take(pa.array(others)), self._other_values)])
        return out.take(pa.array(np.argsort(np.concatenate([*places, others]))))

    def _folded(self, texts: pa.LargeStringArray) -> pa.LargeStringArray:
        """Special tokens are not folded: texts that hold one are left as they are."""
        folded = pc.ascii_lower(texts)
        if not self.find_special.search(folded.buffers()[2] or b""):
            return folded
        return _array([t if self.find_special.search(f) else f for t, f in zip(_strings(texts), _strings(folded), strict=True)])

    def encode_arrays(self, blocks: list[pa.LargeStringArray], end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block the ids of all its texts, with end after each where one is given, and where each text starts (one more at the end)."""
        numbered, bounds = [], []
        for texts in blocks:
            words = pc.ascii_split_whitespace(self._folded(texts))
            numbered.append(words.flatten().dictionary_encode())
            bounds.append(words.offsets.to_numpy())
        numbered = pa.chunked_array(numbered).unify_dictionaries().chunks
        ids = self._word_ids(numbered[0].dictionary)
        for own, at in zip(numbered, bounds, strict=True):
            texts = _regrouped(ids.take(own.indices), at)
            flat, starts = texts.values.to_numpy(), texts.offsets.to_numpy().astype(np.int64)
            yield (flat, starts) if end is None else (np.insert(flat, starts[1:], end), starts + np.arange(len(starts)))

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return next(self.encode_arrays([_array(texts)], end))

    def encode_long(self, text: bytes, end: int | None = None) -> np.ndarray:
        """Ids of one text of any length, a block of it at a time, cut at white space."""
        parts, at = [], 0
        while at < len(text):
            to = at + BLOCK_BYTES
            if to < len(text):
                gap = next((m.start() for m in re.compile(rb"[\x20\x09-\x0D]").finditer(text, to)), len(text))
                to = gap
            parts.append(self.encode([text[at:to]])[0])
            at = to
        return np.concatenate([*parts, np.array([] if end is None else [end], np.int32)]).astype(np.int32)


def encoded_blocks(batches: Iterable[pa.RecordBatch], text: str, encoder: WordPieces, end: int | None = None, shared: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, bounds) for a block of rows at a time; a null text counts as the empty one. shared: instead of SHARED_BYTES."""
    held: list[tuple[pa.RecordBatch, pa.LargeStringArray]] = []
    size = 0

    def encoded():
        if held:
            yield from ((rows, *out) for (rows, _), out in zip(held, encoder.encode_arrays([x for _, x in held], end), strict=True))

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        ends = np.cumsum([0, *pc.binary_length(texts).to_numpy()])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
            long = ends[at + 1] - ends[at] > BLOCK_BYTES
            if long or size + ends[to] - ends[at] > (shared or SHARED_BYTES):
                yield from encoded()
                held, size = [], 0
            if long:
                ids = encoder.encode_long(texts[at].as_buffer().to_pybytes(), end)
                yield batch.slice(at, 1), ids, np.array([0, len(ids)])
            else:
                held.append((batch.slice(at, to - at), texts.slice(at, to - at)))
                size += ends[to] - ends[at]
            at = to
    yield from encoded()
