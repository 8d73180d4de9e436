"""External suffix sorting by recursive induction with disk-backed bulk priority queues.

Suffixes that begin an ascent after a descent (S*) are sorted first: their substrings up to the
next one are sorted by one induction and named, and if names repeat the string of names is
sorted by recursion. From the sorted S* suffixes all descending (L) suffixes are induced by an
ascending scan, and from those all ascending (S) ones by a descending scan. In a scan every
suffix that comes out of the queue puts its left neighbour in, as a tuple of its first symbol
and the order in which it went in; blocks of the smallest symbols come out together, so that a
block of tuples is one vectorised step. A queue keeps a bounded number of tuples in memory and
the rest in sorted runs on the local scratch disk, which go when the sort ends.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that come out of a queue together; tuples that a queue keeps in memory.
BLOCK, MEMORY = 1 << 13, 1 << 20
#: Of so few symbols each is a block of its own: its suffixes come out in order without sorting.
FEW = 1024


def _by(symbols: np.ndarray) -> np.ndarray:
    """Stable order of symbols of at least 0; those below 2**16 are sorted by radix, others with their places behind them in one number."""
    most, bits = int(symbols.max()) if len(symbols) else 0, len(symbols).bit_length()
    if most < 1 << 16:
        return np.argsort(symbols.astype(np.uint16), kind="stable")
    if most.bit_length() + bits > 62:
        return np.argsort(symbols, kind="stable")
    return np.sort(symbols << bits | np.arange(len(symbols))) & ((1 << bits) - 1)


class BulkQueue:
    """(symbol, suffix) tuples; those below a symbol come out by symbol, then in the order they went in."""

    def __init__(self, folder: str, memory: int) -> None:
        self.folder, self.memory, self.held, self.files = folder, memory, 0, 0
        self.runs: list[list] = []  # symbols, suffixes, next, on disk

    def push(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(symbols):
            return
        order = _by(symbols)
        self.runs.append([symbols[order], suffixes[order], 0, False])
        self.held += len(symbols)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """One run on disk of all runs in memory; they are the latest, so their order among all runs stays."""
        keep = [r for r in self.runs if r[3]]
        fresh = [r for r in self.runs if not r[3]]
        symbols, suffixes = (np.concatenate([r[k][r[2] :] for r in fresh]) for k in (0, 1))
        order = _by(symbols)
        run: list = []
        for x in (symbols[order], suffixes[order]):
            path = os.path.join(self.folder, f"{id(self)}-{self.files}.npy")
            self.files += 1
            np.save(path, x)
            run.append(np.load(path, mmap_mode="r"))
            os.unlink(path)  # the mapping keeps the data until the queue goes
        self.runs, self.held = [*keep, [*run, 0, True]], 0

    def pop(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        symbols, suffixes, left = [], [], []
        for run in self.runs:
            end = int(np.searchsorted(run[0], below))
            if end > run[2]:
                symbols.append(run[0][run[2] : end])
                suffixes.append(run[1][run[2] : end])
                self.held -= 0 if run[3] else end - run[2]
                run[2] = end
            if end < len(run[0]):
                left.append(run)
        self.runs = left
        if not symbols:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, suffixes = np.concatenate(symbols), np.concatenate(suffixes)
        order = _by(symbols)
        return symbols[order], suffixes[order]


def _blocks(weight: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of symbols of about ``limit`` suffixes each, at least one symbol."""
    total = np.cumsum(weight)
    a = 0
    while a < len(weight):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def _order_block(symbols: np.ndarray, suffixes: np.ndarray, seeds: np.ndarray, text: np.ndarray, induced: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of symbols a..b-1 in scan order, and which of them are seeds.

    ``symbols, suffixes``: those that came from the queue, in order; ``seeds``: in order. Left neighbours within the block join.
    """
    found, grown = [suffixes], np.concatenate([suffixes, seeds])
    while len(grown):
        left = grown[grown > 0] - 1
        left = left[induced[left]]
        grown = left[text[left] < b]
        if len(grown):
            found.append(grown)
    if b - a == 1 and len(found) <= 1:
        return np.concatenate([suffixes, seeds]), np.repeat([False, True], [len(suffixes), len(seeds)])
    if b - a == 1:
        # One symbol: neighbours follow in the order of what brought them in, wave after wave.
        both = np.concatenate([*found, seeds])
        return both, np.arange(len(both)) >= len(both) - len(seeds)
    inside = np.concatenate([*found, seeds])
    is_seed = np.arange(len(inside)) >= len(inside) - len(seeds)
    first = np.where(is_seed, 2, 0) + (text[inside] - a) * 4
    sub = np.arange(len(inside))
    if len(found) > 1:
        # What comes from within the block sorts by its right neighbour's place in the block; repeat until places stay.
        own = np.zeros(len(inside), bool)
        own[len(suffixes) : len(inside) - len(seeds)] = True
        first = first + own
        by = np.argsort(inside)
        right = by[np.searchsorted(inside, inside[own] + 1, sorter=by)]
        big = len(inside) + 1
        key = first * big + sub
        order = np.argsort(key)  # keys differ
        while True:
            place = np.empty(len(inside), np.int64)
            place[order] = np.arange(len(inside))
            key[own] = first[own] * big + place[right]
            before, order = order, np.argsort(key)
            if np.array_equal(before, order):
                break
    else:
        order = _by(first)
    return inside[order], is_seed[order]


def _induce(text: np.ndarray, induced: np.ndarray, seeds: np.ndarray, count: np.ndarray, folder: str, memory: int, block: int) -> np.ndarray:
    """All induced suffixes in scan order. ``seeds`` are in scan order; ``count``: suffixes of each symbol that may take part."""
    queue, out, at = BulkQueue(folder, memory), [], 0
    seed_symbols = text[seeds]
    for a, b in _blocks(count, block):
        symbols, suffixes = queue.pop(b)
        to = int(np.searchsorted(seed_symbols, b))
        here, at = seeds[at:to], to
        if not len(suffixes) and not len(here):
            continue
        scan, is_seed = _order_block(symbols, suffixes, here, text, induced, a, b)
        out.append(scan[~is_seed])
        left = scan[scan > 0] - 1
        left = left[induced[left]]
        left = left[text[left] >= b]
        queue.push(text[left], left)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _both_ways(text: np.ndarray, ascending: np.ndarray, starts: np.ndarray, size: int, folder: str, memory: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """L suffixes and S suffixes in order, from S* suffixes in order."""
    descending = ~ascending
    block = 1 if size <= FEW else block
    count = np.bincount(text, minlength=size)
    down = _induce(text, descending, starts, count, folder, memory, block)
    mirrored = size - 1 - text
    up = _induce(mirrored, ascending, down[::-1], count[::-1], folder, memory, block)[::-1]
    return down, up


def suffix_order(text: np.ndarray, size: int, folder: str, memory: int = MEMORY, block: int = BLOCK) -> np.ndarray:
    """Suffix array of ``text`` (symbols below ``size``; the last one, 0, occurs nowhere else)."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    text = text.astype(np.int64, copy=False)
    differs = np.append(text[1:] != text[:-1], True)
    known = np.append(text[:-1] < text[1:], True)
    nearest = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    ascending = known[nearest]
    star = np.append(False, ascending[1:] & ~ascending[:-1])
    starts = np.flatnonzero(star)
    first = starts[_by(text[starts])]
    down, up = _both_ways(text, ascending, first, size, folder, memory, block)
    # The sentinel is S* but induced by nothing; it is the smallest.
    substrings = np.concatenate([[n - 1], up[star[up]]])
    names, distinct = _names(text, ascending, starts, substrings)
    if distinct < len(starts):
        reduced = names[starts]
        ordered = starts[suffix_order(reduced, distinct, folder, memory, block)]
    else:
        ordered = substrings
    down, up = _both_ways(text, ascending, ordered, size, folder, memory, block)
    # L before S within a symbol.
    both = np.concatenate([[n - 1], down, up])
    return both[_by(text[both] * 2 + ascending[both])]


def _names(text: np.ndarray, ascending: np.ndarray, starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the S* substrings by start, equal ones alike, and how many there are; ``order``: starts by substring."""
    n = len(text)
    following = np.zeros(n, np.int64)
    following[starts] = np.append(starts[1:], n - 1)
    a, b = order[:-1], order[1:]
    length_a, length_b = following[a] - a + 1, following[b] - b + 1
    same = length_a == length_b
    todo, k = np.flatnonzero(same), 0
    while len(todo):
        x, y = a[todo] + k, b[todo] + k
        equal = (text[x] == text[y]) & (ascending[x] == ascending[y])
        same[todo[~equal]] = False
        k += 1
        todo = todo[equal]
        todo = todo[length_a[todo] > k]
    names = np.zeros(n, np.int64)
    names[order] = np.append(0, np.cumsum(~same))
    return names, int(names[order[-1]]) + 1


def sort_suffixes(text: np.ndarray, size: int, memory: int = MEMORY, block: int = BLOCK) -> np.ndarray:
    """Suffix array of symbols below ``size``, the last of which is a sentinel 0; scratch files go with the call."""
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        return suffix_order(text, size, folder, memory, block)
