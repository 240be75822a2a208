"""A trie of integer sequences as a double array, built and followed in numpy.

Every symbol is written in ``digits`` digits of base 256, so a node has at most 256
children.  The child of node s by digit d is cell base[s] + d, if check of that cell is s.
Building places the children of all nodes with many of them first: every round proposes a
random base for each node not yet placed, and nodes whose cells are all free and claimed by
no earlier node take them; when few succeed, the array grows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RADIX = 256


@dataclass
class Trie:
    base: np.ndarray  # int32 for each cell
    check: np.ndarray  # int32: the cell of the parent, -1 if free
    accept: np.ndarray  # cell in which each sequence ends
    digits: int

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.check.nbytes + self.accept.nbytes

    def __post_init__(self) -> None:
        # The cell after each first symbol, -1 for none: one look-up in place of its digits.
        cells, symbols = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        for _ in range(self.digits):
            below = self.base[cells][:, None].astype(np.int64) + np.arange(RADIX)
            parent, digit = np.nonzero(self.check[below] == cells[:, None])
            cells, symbols = below[parent, digit], symbols[parent] * RADIX + digit
        self.first = np.full(int(symbols.max(initial=0)) + 2, -1, dtype=np.int32)
        self.first[symbols] = cells

    def ends(self, symbols: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
        """Cells reached by reading ``length`` symbols from each of ``starts``, all at once.

        A start is dropped at the first digit without a transition; symbols are >= 0.
        """
        state = self.first[np.minimum(symbols[starts], len(self.first) - 1)]
        at, state = starts[state >= 0], state[state >= 0]
        for step in range(1, length):
            read = symbols[at + step]
            for digit in range(self.digits - 1, -1, -1):
                cell = self.base[state] + (read >> (8 * digit) & (RADIX - 1)).astype(np.int32)
                good = self.check[cell] == state
                state, at, read = cell[good], at[good], read[good]
        return state


def _nodes(sequences: np.ndarray, digits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each level the parents (node numbers of the level above) and digits of its nodes.

    Also the number, in the last level, of the node in which each sequence ends.
    """
    shifts = np.arange(digits - 1, -1, -1) * 8
    spelled = (sequences[:, :, None] >> shifts & (RADIX - 1)).reshape(len(sequences), -1)
    order = np.lexsort(spelled.T[::-1])
    spelled = spelled[order]
    levels = []
    parent = np.zeros(len(spelled), dtype=np.int64)
    for level in range(spelled.shape[1]):
        digit = spelled[:, level]
        first = np.r_[True, (parent[1:] != parent[:-1]) | (digit[1:] != digit[:-1])][: len(spelled)]
        levels.append((parent[first], digit[first]))
        parent = np.cumsum(first) - 1
    number = np.empty(len(spelled), dtype=np.int64)
    number[order] = parent
    return levels, number


def build(sequences: np.ndarray) -> Trie:
    """The trie of the rows of ``sequences`` (symbols >= 0, all of one length)."""
    digits = max(1, -(-int(sequences.max(initial=0)).bit_length() // 8))
    levels, ending = _nodes(sequences.astype(np.int64), digits)
    # Nodes of all levels in one numbering, the root first.
    offsets = np.cumsum([0, 1, *(len(parents) for parents, _ in levels)])
    owner = np.concatenate([parents + offsets[i] for i, (parents, _) in enumerate(levels)])
    digit = np.concatenate([d for _, d in levels])
    total = int(offsets[-1])
    children = np.bincount(owner, minlength=total)

    rng = np.random.default_rng(7)
    size = int(total * 1.3) + 2 * RADIX
    taken = np.zeros(size, dtype=bool)
    taken[0] = True  # the root's cell
    place = np.zeros(total, dtype=np.int64)  # base of each node
    # Edges sorted by their owner's number of children, most first, then by owner.
    order = np.lexsort((owner, -children[owner]))
    owner, digit, child = owner[order], digit[order], (np.arange(1, total))[order]
    for many in range(RADIX, 0, -1) if total > 1 else ():
        group = children[owner] == many
        edges, marks = owner[group], digit[group]
        tries = 0
        while len(edges):
            nodes = edges.reshape(-1, many)[:, 0]
            proposed = rng.integers(1, size - RADIX, len(nodes))
            cells = proposed[:, None] + marks.reshape(-1, many)
            free = ~taken[cells].any(axis=1)
            # Of the nodes that claim a cell the first one has it.
            claimed = np.full(size, len(nodes), dtype=np.int64) if many == 1 or len(nodes) > 64 else None
            numbers = np.arange(len(nodes))
            if claimed is None:
                seen: set[int] = set()
                won = np.zeros(len(nodes), dtype=bool)
                for i in np.flatnonzero(free):
                    mine = set(cells[i].tolist())
                    if not mine & seen:
                        seen |= mine
                        won[i] = True
            else:
                able = numbers[free]
                np.minimum.at(claimed, cells[able], able[:, None])
                won = free & (claimed[cells] == numbers[:, None]).all(axis=1)
            place[nodes[won]] = proposed[won]
            taken[cells[won].ravel()] = True
            left = np.repeat(~won, many)
            edges, marks = edges[left], marks[left]
            tries += 1
            if tries % 8 == 0 and len(edges):
                grown = int(size * 1.2) + RADIX
                taken = np.concatenate([taken, np.zeros(grown - size, dtype=bool)])
                size = grown
    cell_of = np.zeros(total, dtype=np.int64)
    cell_of[child] = place[owner] + digit
    base = np.zeros(size, dtype=np.int32)
    check = np.full(size, -1, dtype=np.int32)
    base[cell_of] = place
    check[cell_of[child]] = cell_of[owner]
    return Trie(base, check, cell_of[offsets[-2] + ending], digits)
