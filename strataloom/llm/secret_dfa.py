"""Secret scans with one combined deterministic automaton.

The rules' regular expressions are compiled here: to a nondeterministic automaton (Thompson), by subset construction over
classes of bytes that no rule tells apart to a deterministic one, minimised by partition refinement, and stored as transition
arrays. The search automaton holds all rules at once and reads every byte of every text once; each state says which rules end
a sufficient match there. Texts with such an end are then resolved rule by rule with the rule's own anchored automaton
(leftmost, longest, not overlapping; matches that fall short are consumed and dropped).

Texts are scanned side by side: a block of texts, apart by line feeds (which lead every state back to the start), is cut
into lanes of equal length that all step together from the start state; where a lane should have begun in another state,
it is run again from there until its states agree with those it had.

Defined results: a null or empty text has no spans; rows that repeat have the same spans; an empty table gives an empty
result; positions are code points, ends exclusive. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LANE = 1_024
BLOCK = 4 << 20


@dataclass(frozen=True)
class Rule:
    """any: what a match is; enough: which matches count (of those of any, at the same place)."""

    name: str
    any: str
    enough: str


def _rule(name: str, head: str, body: str, least: int, tail: str = "") -> Rule:
    return Rule(name, f"{head}{body}+{tail}", f"{head}{body}{{{least},}}{tail}")


#: The base rules, in the order of listing.
BASE_RULES = (
    _rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 12),
    _rule("access", "AKIA", "[A-Z0-9]", 14),
    _rule("hex", "", "[0-9a-f]", 16),
)
#: Rules that this method adds.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    _rule("forge", "gh[oprsu]_", "[A-Za-z0-9]", 20),
)
RULES = (*BASE_RULES, *MORE_RULES)


class Nfa:
    """Thompson automaton of expressions over bytes: literals, \\xNN and \\ escapes, classes, groups, (?i:...), | ? * + {m,} {m,n}."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        #: Of a state in a pattern's closing run, which must be repeated so often or more: the run, and how far it is.
        self.run: dict[int, tuple[int, int]] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        out = self._choice(False)
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} in {pattern!r}")
        last = out[1][-1] if out[0] == "seq" and out[1] else out
        self.closing = last if last[0] == "repeat" and last[1][0][0] == "set" and last[1][2] is None else None
        return self._build(out)

    def _build(self, node) -> tuple[int, int]:
        kind, value = node
        if kind == "set":
            a, b = self.state(), self.state()
            self.moves[a] = (value, b)
            return a, b
        if kind == "seq":
            a = b = self.state()
            for x in value:
                c, d = self._build(x)
                self.empty[b].append(c)
                b = d
            return a, b
        if kind == "or":
            a, b = self.state(), self.state()
            for x in value:
                c, d = self._build(x)
                self.empty[a].append(c)
                self.empty[d].append(b)
            return a, b
        inner, least, most = value
        a = b = self.state()
        for k in range(least):
            c, d = self._build(inner)
            if node is self.closing:
                self.run[c] = (a, k)
            self.empty[b].append(c)
            b = d
        if most is None:
            c, d = self._build(inner)
            if node is self.closing:
                self.run[c] = (a, least)
            self.empty[b].append(c)
            self.empty[d].append(b)
            return a, b
        last = self.state()
        for _ in range(most - least):
            self.empty[b].append(last)
            c, d = self._build(inner)
            self.empty[b].append(c)
            b = d
        self.empty[b].append(last)
        return a, last

    def _choice(self, fold: bool):
        out = [self._sequence(fold)]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            out.append(self._sequence(fold))
        return ("or", out) if len(out) > 1 else out[0]

    def _sequence(self, fold: bool):
        out = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            out.append(self._repeated(self._atom(fold)))
        return "seq", out

    def _repeated(self, atom):
        while self.at < len(self.text) and (c := self.text[self.at]) in "?*+{":
            self.at += 1
            if c == "{":
                to = self.text.index("}", self.at)
                least, comma, most = self.text[self.at : to].partition(",")
                self.at = to + 1
                bounds = int(least), int(most) if most else None if comma else int(least)
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            atom = ("repeat", (atom, *bounds))
        return atom

    def _byte(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def _atom(self, fold: bool):
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            if self.text.startswith("?i:", self.at):
                self.at, fold = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            out = self._choice(fold)
            self.at += 1
            return out
        if c == "[":
            self.at += 1
            found: set[int] = set()
            negated = self.text[self.at] == "^"
            self.at += negated
            while self.text[self.at] != "]":
                low = high = self._byte()
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self._byte()
                found.update(range(low, high + 1))
            self.at += 1
            found = set(range(256)) - found if negated else found
        elif c == ".":
            self.at += 1
            found = set(range(256)) - {10}
        else:
            found = {self._byte()}
        if fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return "set", frozenset(found)


@dataclass(frozen=True)
class Dfa:
    """classes: of each byte; table: next state times number of classes, by state times number of classes plus class; accepts: a bit for each pattern."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    start: int

    @property
    def width(self) -> int:
        return len(self.table) // len(self.accepts)


def compiled(patterns: list[str], search: bool) -> Dfa:
    """The minimal automaton of all patterns. search: matches may begin anywhere."""
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for k, pattern in enumerate(patterns):
        a, b = nfa.add(pattern)
        nfa.empty[start].append(a)
        ends[b] = ends.get(b, 0) | 1 << k
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {s: k for k, s in enumerate(dict.fromkeys(signature))}
    classes = np.array([kinds[s] for s in signature], np.uint8)
    one_byte = [signature.index(s) for s in kinds]

    def leading(states) -> frozenset[int]:
        """Without the states of a closing run that another of that run is ahead of: it ends a match wherever they do."""
        ahead: dict[int, int] = {}
        for s in states:
            if s in nfa.run:
                run, k = nfa.run[s]
                ahead[run] = max(k, ahead.get(run, 0))
        return frozenset(s for s in states if s not in nfa.run or nfa.run[s][1] == ahead[nfa.run[s][0]])

    @functools.cache
    def closure(state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(s for s in seen if nfa.moves[s] or s in ends)

    steps = [{s: closure(m[1]) for s, m in enumerate(nfa.moves) if m and b in m[0]} for b in one_byte]
    first = leading(closure(start))
    number, todo, table = {first: 0}, [first], []
    while todo:
        fresh = []
        for own in todo:
            row = []
            for step in steps:
                to = leading(set().union(*(step[s] for s in own if s in step), first if search else ()))
                if to not in number:
                    number[to] = len(number)
                    fresh.append(to)
                row.append(number[to])
            table.append(row)
        todo = fresh
    moves = np.array(table, np.int64)
    accepts = np.array([functools.reduce(int.__or__, (ends.get(s, 0) for s in own), 0) for own in number], np.int64)
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.concatenate([block[:, None], block[moves]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    chosen = np.unique(block, return_index=True)[1]
    width = len(one_byte)
    return Dfa(classes, (block[moves[chosen]] * width).astype(np.int32).reshape(-1), accepts[chosen], int(block[0]) * width)


def scan(dfa: Dfa, block: bytes) -> np.ndarray:
    """The accept bits after each byte."""
    size = len(block)
    lanes = max(1, -(-size // LANE))
    padded = np.full(lanes * LANE, 10, np.uint8)
    padded[:size] = np.frombuffer(block, np.uint8)
    steps = np.ascontiguousarray(dfa.classes[padded].reshape(lanes, LANE).T)
    states = np.empty((LANE, lanes), np.int32)
    now = np.full(lanes, dfa.start, np.int32)
    table = dfa.table
    for k in range(LANE):
        now = table[now + steps[k]]
        states[k] = now
    begun = np.full(lanes, dfa.start, np.int32)
    while True:
        should = np.concatenate([[dfa.start], states[-1, :-1]]).astype(np.int32)
        again = np.flatnonzero(should != begun)
        if not len(again):
            break
        begun, now = should, should[again]
        for k in range(LANE):
            now = table[now + steps[k, again]]
            other = now != states[k, again]
            again, now = again[other], now[other]
            if not len(again):
                break
            states[k, again] = now
    return dfa.accepts[states.T.reshape(-1)[:size] // dfa.width]


class Anchored:
    """Leftmost longest matches by an anchored automaton whose bits are 1: a match, 2: it is enough."""

    def __init__(self, rule: Rule):
        self.dfa = compiled([rule.any, rule.enough], search=False)
        self.table, self.accepts, self.width = self.dfa.table.tolist(), self.dfa.accepts.tolist(), self.dfa.width
        stay = [k * self.width for k, bits in enumerate(self.accepts) if not bits and set(self.table[k * self.width : (k + 1) * self.width]) == {k * self.width}]
        self.dead = stay[0] if stay else -1

    def matches(self, text: bytes) -> list[tuple[int, int]]:
        own = self.dfa.classes[np.frombuffer(text, np.uint8)]
        begins = np.flatnonzero(self.dfa.table[self.dfa.start + own.astype(np.int64)] != self.dead).tolist()
        classes, table, accepts, width, dead = own.tolist(), self.table, self.accepts, self.width, self.dead
        out, free = [], 0
        for at in begins:
            if at < free:
                continue
            state, end, bits = self.dfa.start, 0, 0
            for k in range(at, len(classes)):
                state = table[state + classes[k]]
                if state == dead:
                    break
                if bit := accepts[state // width]:
                    end, bits = k + 1, bit
            if end:
                free = end
                if bits & 2:
                    out.append((at, end))
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.names = [r.name for r in rules]
        self.search = compiled([r.enough for r in rules], search=True)
        self.own = [Anchored(r) for r in rules]
        line_feed = self.search.classes[10]
        if (self.search.table[line_feed :: self.search.width] != self.search.start).any():
            raise ValueError("a rule matches line feeds; texts could not be kept apart")

    def spans(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """For each text (name, start, end) in code points, by start and then in the rules' order."""
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bits = scan(self.search, b"\n".join(texts) + b"\n")
        at = np.flatnonzero(bits)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        which = np.searchsorted(bounds, at, side="right") - 1
        for k in np.unique(which).tolist():
            found = int(np.bitwise_or.reduce(bits[at[which == k]]))
            own = [(a, j, b) for j in range(len(self.names)) if found >> j & 1 for a, b in self.own[j].matches(texts[k])]
            heads = np.cumsum((np.frombuffer(texts[k], np.uint8) & 0xC0) != 0x80)
            point = [0, *heads.tolist()]
            out[k] = [(self.names[j], point[a], point[b]) for a, j, b in sorted(own)]
        return out


@functools.lru_cache(maxsize=8)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end) for every row of docs."""
    scanner = scanner_of(rules)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches):
        ids, texts, held = [], [], 0

        def out():
            spans = [[{"kind": n, "start": a, "end": b} for n, a, b in own] for own in scanner.spans(texts)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, schema.field(1).type)], schema=schema)

        for i, t in common.rows_of(batches, "doc_id", "text"):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held > BLOCK:
                yield out()
                ids, texts, held = [], [], 0
        if ids:
            yield out()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
