"""Secret scan with one deterministic automaton for all rules.

Rules are regular expressions over bytes.  ``compile_rules`` makes a Thompson automaton
of all of them behind an unanchored loop, determinises it by subset construction,
minimises it by partition refinement and lays it out as a transition array over byte
classes.  A scan reads every byte once for all rules: the lines of many texts advance
together, one byte a step, by array lookups.  Only lines in which some rule accepted are
then read again by that rule's own anchored automaton, which gives the leftmost,
longest, non-overlapping matches in time proportional to the line.

A rule is a head, a class of bytes repeated after it (the body), and the least length
of the body; shorter matches are dropped after they have been found, so that they still
take up their place.

Cases: null text is empty; a text of any length is scanned whole; offsets are code
points, the end exclusive; equal rows each get their result; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import joined, slices

NEWLINE = 10
# Lines longer than this are also cut at other bytes that no rule can contain.
LONG_LINE = 1024
# The shared automaton counts body bytes up to this number where a rule has no head to
# tell it from plain text, and one byte elsewhere; full lengths are checked after.
COUNTED = 12
# Walks that go on further than this after their last match are remembered.
REMEMBERED_WALK = 16


class Rule(NamedTuple):
    name: str
    head: str
    body: str
    least: int
    any_case: bool = False
    base: bool = False


RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        "[A-Za-z0-9+/_.=-]",
        6,
        any_case=True,
        base=True,
    ),
    # Twenty characters in all, of which the head is four.
    Rule("access", "AKIA", "[A-Z0-9]", 16, base=True),
    Rule("hex", "", "[0-9a-f]", 24, base=True),
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("maps", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
)

# --- regular expressions to automata ------------------------------------------------------


class _Nfa:
    """Thompson automaton: per state its byte edges (a 256-bit mask) and its empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1


class _Parser:
    """Alternation, grouping, classes, escapes and the repeats ? * + {m} {m,} {m,n}."""

    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern.encode(), 0, any_case

    def parse(self):
        tree = self._either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {chr(self.text[self.at])!r} at {self.at}")
        return tree

    def _peek(self) -> int:
        return self.text[self.at] if self.at < len(self.text) else -1

    def _take(self) -> int:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self):
        branches = [self._chain()]
        while self._peek() == ord("|"):
            self._take()
            branches.append(self._chain())
        return ("either", branches) if len(branches) > 1 else branches[0]

    def _chain(self):
        parts = []
        while self._peek() not in (-1, ord("|"), ord(")")):
            parts.append(self._repeat(self._atom()))
        return ("chain", parts)

    def _repeat(self, atom):
        bounds = {ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}
        while (c := self._peek()) in bounds or c == ord("{"):
            self._take()
            if c != ord("{"):
                atom = ("repeat", atom, *bounds[c])
                continue
            end = self.text.index(b"}", self.at)
            low, comma, high = self.text[self.at : end].decode().partition(",")
            self.at = end + 1
            atom = ("repeat", atom, int(low), int(high) if high else None if comma else int(low))
        return atom

    def _atom(self):
        c = self._take()
        if c == ord("("):
            tree = self._either()
            if self._take() != ord(")"):
                raise ValueError("a group is not closed")
            return tree
        if c == ord("["):
            mask, first = 0, True
            while self._peek() != ord("]") or first:
                low = self._byte(self._take())
                first = False
                if self._peek() == ord("-") and self.text[self.at + 1] != ord("]"):
                    self._take()
                    high = self._byte(self._take())
                else:
                    high = low
                for b in range(low, high + 1):
                    mask |= 1 << b
            self._take()
            return ("bytes", self._cased(mask))
        return ("bytes", self._cased(1 << self._byte(c)))

    def _byte(self, c: int) -> int:
        if c != ord("\\"):
            return c
        c = self._take()
        if c == ord("x"):
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return c

    def _cased(self, mask: int) -> int:
        if self.any_case:
            for low in range(ord("a"), ord("z") + 1):
                if mask >> low & 1 or mask >> (low - 32) & 1:
                    mask |= 1 << low | 1 << (low - 32)
        return mask


def _add(nfa: _Nfa, tree, start: int) -> int:
    """Adds ``tree`` behind ``start``; the state after it."""
    if tree[0] == "bytes":
        end = nfa.state()
        nfa.edges[start].append((tree[1], end))
        return end
    if tree[0] == "chain":
        for part in tree[1]:
            start = _add(nfa, part, start)
        return start
    if tree[0] == "either":
        end = nfa.state()
        for branch in tree[1]:
            entry = nfa.state()
            nfa.empty[start].append(entry)
            nfa.empty[_add(nfa, branch, entry)].append(end)
        return end
    _, part, least, most = tree
    for _ in range(least):
        start = _add(nfa, part, start)
    if most is None:
        loop, end = nfa.state(), nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[_add(nfa, part, loop)].append(loop)
        nfa.empty[loop].append(end)
        return end
    end = nfa.state()
    nfa.empty[start].append(end)
    for _ in range(most - least):
        start = _add(nfa, part, start)
        nfa.empty[start].append(end)
    return end


class Automaton(NamedTuple):
    classes: np.ndarray  # byte -> class
    moves: np.ndarray  # state * number of classes + class -> state
    accepts: np.ndarray  # state -> mask of rules
    dead: int  # the state that nothing leaves, -1 without one

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1


def _closure(nfa: _Nfa, states: set[int]) -> frozenset[int]:
    found, todo = set(states), list(states)
    while todo:
        for nxt in nfa.empty[todo.pop()]:
            if nxt not in found:
                found.add(nxt)
                todo.append(nxt)
    return frozenset(found)


def _minimise(moves: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement: states stay together while their moves lead to equal parts."""
    _, part = np.unique(accepts, return_inverse=True)
    count = 0
    while True:
        rows = np.column_stack([part, part[moves]])
        _, first, part = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        part = part.reshape(-1)
        if len(first) == count:
            break
        count = len(first)
    # The start stays state 0.
    swap = np.arange(count)
    swap[[0, part[0]]] = swap[[part[0], 0]]
    part = swap[part]
    out, ends = np.zeros((count, moves.shape[1]), dtype=np.int64), np.zeros(count, dtype=np.int64)
    out[part], ends[part] = part[moves], accepts
    return out, ends


def determinise(patterns: list[tuple[str, bool]], anchored: bool) -> Automaton:
    """One automaton for all patterns; ``accepts`` has bit i for pattern i."""
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for i, (pattern, any_case) in enumerate(patterns):
        entry = nfa.state()
        nfa.empty[root].append(entry)
        final[_add(nfa, _Parser(pattern, any_case).parse(), entry)] = 1 << i
    if not anchored:
        nfa.edges[root].append(((1 << 256) - 1, root))
    masks = sorted({mask for edges in nfa.edges for mask, _ in edges})
    shapes: dict[tuple, int] = {}
    classes = np.array(
        [shapes.setdefault(tuple(m >> b & 1 for m in masks), len(shapes)) for b in range(256)],
        dtype=np.uint8,
    )
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(shapes))]
    closures = [_closure(nfa, {s}) for s in range(len(nfa.edges))]
    steps = [
        [frozenset().union(*(closures[t] for m, t in edges if m >> b & 1)) for b in sample]
        for edges in nfa.edges
    ]
    start = closures[root]
    numbers, todo, moves = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        active = [steps[s] for s in state if nfa.edges[s]]
        row = []
        for c in range(len(sample)):
            nxt = frozenset().union(*(x[c] for x in active))
            if nxt not in numbers:
                numbers[nxt] = len(numbers)
                todo.append(nxt)
            row.append(numbers[nxt])
        moves.append(row)
    accepts = np.array([sum({final[s] for s in state if s in final}) for state in numbers])
    table, ends = _minimise(np.array(moves), accepts)
    stuck = [s for s in range(len(table)) if not ends[s] and (table[s] == s).all()]
    return Automaton(classes, table.astype(np.int32).ravel(), ends, stuck[0] if stuck else -1)


class Walk(NamedTuple):
    """An automaton for reading one byte after the other in Python."""

    classes: bytes  # byte -> class
    width: int
    moves: list[int]  # state * width + class -> state * width
    accepts: list[bool]  # by state * width
    dead: int
    begins: bytes  # byte -> 1 if a match can begin with it


def walk_of(automaton: Automaton) -> Walk:
    width = automaton.width
    accepts = np.zeros(len(automaton.accepts) * width, dtype=bool)
    accepts[::width] = automaton.accepts != 0
    return Walk(
        automaton.classes.astype(np.uint8).tobytes(), width, (automaton.moves * width).tolist(), accepts.tolist(),
        automaton.dead * width, (automaton.moves[automaton.classes] != automaton.dead).astype(np.uint8).tobytes(),
    )


class Compiled(NamedTuple):
    rules: tuple[Rule, ...]
    probe: Automaton
    resets: np.ndarray  # bytes after which the probe is in its start state, whatever came before
    heads: list[Walk]
    wholes: list[Walk]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    """Automata for all rules: the shared one, and each rule's own for exact matches."""
    probes = [
        (f"{r.head}{r.body}{{{1 if r.head else min(r.least, COUNTED)}}}", r.any_case) for r in rules
    ]
    probe = determinise(probes, anchored=False)
    table = probe.moves.reshape(-1, probe.width)
    resets = (table == 0).all(axis=0)[probe.classes]
    heads = [walk_of(determinise([(r.head, r.any_case)], anchored=True)) for r in rules]
    wholes = [walk_of(determinise([(f"{r.head}{r.body}+", r.any_case)], anchored=True)) for r in rules]
    return Compiled(rules, probe, resets, heads, wholes)


# --- scanning -----------------------------------------------------------------------------


def _pieces(data: np.ndarray, starts: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Where to cut so that each piece begins in the start state; texts are cut apart too."""
    cuts = [starts[1:]]
    if resets[NEWLINE]:
        cuts.append(np.flatnonzero(data == NEWLINE) + 1)
    ends = np.unique(np.concatenate(cuts))
    begins = np.concatenate([[0], ends[:-1]])
    for i in np.flatnonzero(ends - begins > LONG_LINE):
        inside = np.flatnonzero(resets[data[begins[i] : ends[i]]]) + begins[i] + 1
        cuts.append(inside)
    return np.unique(np.concatenate(cuts))


def probe_pieces(compiled: Compiled, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the rules that accepted in each piece; every byte is read once."""
    begins = np.concatenate([[0], ends[:-1]])
    order = np.argsort(begins - ends, kind="stable")  # longest first
    begin, length = begins[order], (ends - begins)[order]
    classes, moves, width = compiled.probe.classes[data], compiled.probe.moves, compiled.probe.width
    accepts = compiled.probe.accepts
    offsets = (moves * width).astype(np.int32)
    by_offset = np.zeros(len(accepts) * width, dtype=np.int64)
    by_offset[::width] = accepts
    accepting = by_offset != 0
    state = np.zeros(len(order), dtype=np.int32)
    found = np.zeros(len(order), dtype=np.int64)
    active_at = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right") if len(length) else []
    for step, active in enumerate(active_at):
        now = offsets[state[:active] + classes[begin[:active] + step]]
        state[:active] = now
        hit = np.flatnonzero(accepting[now])
        if len(hit):
            found[hit] |= by_offset[now[hit]]
    masks = np.zeros(len(order), dtype=np.int64)
    masks[order] = found
    return masks


def _longest(walk: Walk, data: bytes) -> Callable[[int], int]:
    """A function that gives the end of the longest match from a place, or -1.

    What a walk meets after its last accepting state leads to no match.  It is remembered
    when it is long, and a later walk ends where it comes to the same state at the same
    place.  So all walks together take time in proportion to the data, whatever it holds.
    """
    kinds = data.translate(walk.classes)
    moves, accepts, dead, size = walk.moves, walk.accepts, walk.dead, len(data)
    barren: dict[int, bytearray] = {}

    def longest(at: int) -> int:
        state, end, base, since = 0, at if accepts[0] else -1, at, []
        while at < size:
            state = moves[state + kinds[at]]
            at += 1
            if state == dead or (state in barren and barren[state][at]):
                break
            if accepts[state]:
                end = base = at
                since = []
            else:
                since.append(state)
        if len(since) > REMEMBERED_WALK:
            for place, state in enumerate(since, base + 1):
                if state not in barren:
                    barren[state] = bytearray(size + 1)
                barren[state][place] = 1
        return end

    return longest


def matches(compiled: Compiled, rule: int, data: bytes) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of a rule; short ones dropped after."""
    found = []
    whole_end, head_end = (_longest(x[rule], data) for x in (compiled.wholes, compiled.heads))
    begins = data.translate(compiled.wholes[rule].begins)
    at = begins.find(1)
    while at >= 0:
        end = whole_end(at)
        if end < 0:
            end = at + 1
        elif end - head_end(at) >= compiled.rules[rule].least:
            found.append((at, end))
        at = begins.find(1, end)
    return found


def _spans(compiled: Compiled, data: np.ndarray, starts: np.ndarray) -> dict[int, list]:
    """Row -> spans (start, rule number, end) in code points."""
    ends = _pieces(data, starts, compiled.resets)
    masks = probe_pieces(compiled, data, ends)
    out: dict[int, list] = {}
    points: dict[int, np.ndarray] = {}
    for piece in np.flatnonzero(masks):
        begin, end = int(ends[piece - 1]) if piece else 0, int(ends[piece])
        row = int(np.searchsorted(starts, begin, side="right")) - 1
        low = int(starts[row])
        if row not in points:
            text = data[low : int(starts[row + 1])]
            points[row] = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        part = data[begin:end].tobytes()
        for rule in range(len(compiled.rules)):
            if masks[piece] >> rule & 1:
                for a, b in matches(compiled, rule, part):
                    at = points[row]
                    span = (int(at[begin + a - low]), rule, int(at[begin + b - low]))
                    out.setdefault(row, []).append(span)
    return out


def _scan(compiled: Compiled):
    names = [r.name for r in compiled.rules]
    base = [r.base for r in compiled.rules]
    counted = [i for i, r in enumerate(compiled.rules) if r.base]

    def text_of(spans: list) -> str:
        return ",".join(f"{names[r]}:{a}:{b}" for a, r, b in spans)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts = joined(batch.column(1), NEWLINE)
            found = _spans(compiled, data, starts)
            every = [sorted(found.get(i, ())) for i in range(batch.num_rows)]
            counts = [
                pa.array([sum(s[1] == r for s in spans) for spans in every], pa.int64()) for r in counted
            ]
            digests = [
                hashlib.sha256(text_of([s for s in spans if base[s[1]]]).encode()).hexdigest()
                for spans in every
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests), pa.array([text_of(s) for s in every])],
                ["doc_id", *[f"n_{names[r]}" for r in counted], "base_sha256", "spans"],
            )

    return task


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """doc_id, a count per base rule, the digest of the base spans, and all spans.

    ``spans`` lists kind:start:end by start, then in the order of the rules.
    """
    compiled = compile_rules(rules)
    counts = ", ".join(f"n_{r.name} long" for r in rules if r.base)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        _scan(compiled), f"doc_id long, {counts}, base_sha256 string, spans string"
    )
