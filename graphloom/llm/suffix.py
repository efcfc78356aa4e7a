"""Suffix sorting by external induction.

The suffixes of a text are sorted as SA-IS sorts them: suffixes that start a rising run
after a fall (S*) are sorted first, by naming the stretches between them and sorting the
shorter text of names in the same way (recursion); then the falling suffixes are induced
from them in one ascending pass, and the rising ones from those in one descending pass.

A pass is a priority queue that only moves forward: a suffix that is popped pushes the
suffix before it, whose first symbol is not smaller. The queue is split by ranges of the
first symbol. Each range is a run of tuples appended in order, so equal symbols keep the
order of what induced them; runs over the memory budget go to files of a scratch folder
and come back a range at a time. Inside a range of several symbols the tuples also carry
what induced them, and ranks along those links, doubling their reach, order the range.

In the last two passes the tuples carry common prefixes as well: they start from what
neighbouring S* suffixes share, and each step of the induction passes them on.

The sorted suffixes are memory-mapped files above the budget.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Suffixes in a range of the queue.
RANGE = 200_000
#: Bytes that a queue holds in memory before it writes its runs, and beyond which arrays are files.
MEMORY = 64 << 20


class Scratch:
    """A folder of the task's own, removed at the end, whatever happens."""

    def __enter__(self) -> Scratch:
        self.path, self.n = tempfile.mkdtemp(prefix="induce-"), 0
        return self

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.path, ignore_errors=True)

    def name(self) -> str:
        self.n += 1
        return os.path.join(self.path, str(self.n))

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= MEMORY:
            return np.empty(n, dtype)
        return np.memmap(self.name(), dtype, "w+", shape=(n,))


class RangeQueue:
    """Positions pushed in order, popped a range at a time."""

    def __init__(self, ranges: int, scratch: Scratch, memory: int) -> None:
        self.runs: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.files: dict[int, str] = {}
        self.held, self.scratch, self.memory = 0, scratch, memory

    def push(self, at: np.ndarray, where: np.ndarray) -> None:
        """``at``: positions in order; ``where``: the range of each."""
        if not len(at):
            return
        order = np.argsort(where, kind="stable")
        at, where = at[order], where[order]
        cuts = np.flatnonzero(np.diff(where)) + 1
        for r, part in zip(where[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            self.runs[r].append(part)
        self.held += at.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        for r, parts in enumerate(self.runs):
            if parts:
                if r not in self.files:
                    self.files[r] = self.scratch.name()
                with open(self.files[r], "ab") as f:
                    for p in parts:
                        p.tofile(f)
                parts.clear()
        self.held = 0

    def pop(self, r: int) -> np.ndarray:
        parts = self.runs[r]
        self.runs[r] = []
        self.held -= sum(p.nbytes for p in parts)
        if r in self.files:
            name = self.files.pop(r)
            parts = [np.fromfile(name, np.int64), *parts]
            os.unlink(name)
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (the last one is)."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rise[-1] = 1
    known = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _ranges(counts: np.ndarray, size: int) -> np.ndarray:
    """The range of each symbol: neighbours together up to ``size`` suffixes; a symbol with
    more has a range of its own."""
    before = np.cumsum(counts) - counts
    big = counts > size
    cut = np.zeros(len(counts), bool)
    cut[1:] = (before[1:] // size != before[:-1] // size) | big[1:] | big[:-1]
    return np.cumsum(cut)


def induce(text: np.ndarray, roots: np.ndarray, want: np.ndarray, sigma: int, scratch: Scratch, size: int = RANGE, memory: int = MEMORY) -> np.ndarray:
    """Sorted suffixes where ``want`` holds, induced in ascending order from ``roots``,
    which are sorted and come after wanted ones with the same first symbol."""
    counts = np.bincount(text[want], minlength=sigma) + np.bincount(text[roots], minlength=sigma)
    where = _ranges(counts, size)
    firsts = np.flatnonzero(np.diff(where, prepend=-1))
    lasts = np.append(firsts[1:], sigma)
    root_at = np.searchsorted(text[roots], np.append(firsts, sigma))
    queue = RangeQueue(len(firsts), scratch, memory)
    out, filled = scratch.array(int(want.sum()), np.int64), 0

    def before(at: np.ndarray) -> np.ndarray:
        prev = at[at > 0] - 1
        return prev[want[prev]]

    def push(prev: np.ndarray) -> None:
        queue.push(prev, where[text[prev]])

    def one_symbol(symbol: int, cur: np.ndarray, own: np.ndarray) -> None:
        """A single symbol: what is induced inside it forms generations, each after the last."""
        while len(cur):
            later = []
            for i in range(0, len(cur), size):
                part = cur[i : i + size]
                emit(part)
                prev = before(part)
                same = text[prev] == symbol
                push(prev[~same])
                later.append(prev[same])
            cur = np.concatenate(later)
        for i in range(0, len(own), size):
            push(before(own[i : i + size]))

    def emit(at: np.ndarray) -> None:
        nonlocal filled
        out[filled : filled + len(at)] = at
        filled += len(at)

    for r, (low, high) in enumerate(zip(firsts.tolist(), lasts.tolist())):
        base, own = queue.pop(r), roots[root_at[r] : root_at[r + 1]]
        if not len(base) and not len(own):
            continue
        if high - low == 1:
            one_symbol(low, base, own)
            continue
        at, source = [base, own], [np.full(len(base) + len(own), -1)]
        cur, index = np.concatenate(at), np.arange(len(base) + len(own))
        total = len(cur)
        while len(cur):
            keep = cur > 0
            prev, src = cur[keep] - 1, index[keep]
            inside = want[prev] & (text[prev] < high)
            cur, src = prev[inside], src[inside]
            index = np.arange(total, total + len(cur))
            total += len(cur)
            at.append(cur)
            source.append(src)
        pos, link = np.concatenate(at), np.concatenate(source)
        given = len(base) + len(own)
        is_root = np.zeros(total, bool)
        is_root[len(base) : given] = True
        # base before what is induced here before roots; then each by what induced it, the
        # reach doubling until every chain has come to a given tuple
        kind = np.ones(total, np.int64)
        kind[: len(base)], kind[len(base) : given] = 0, 2
        place = np.zeros(total, np.int64)
        place[: len(base)], place[len(base) : given] = np.arange(len(base)), np.arange(len(own))
        link[:given] = np.arange(given)
        rank = _dense(place, kind, text[pos].astype(np.int64))
        while (link >= given).any():
            follow = np.where(np.arange(total) < given, 0, rank[link])
            rank, link = _dense(follow, rank), link[link]
        follow = np.where(np.arange(total) < given, 0, rank[link])
        order = np.lexsort([follow, rank])
        pos, is_root = pos[order], is_root[order]
        emit(pos[~is_root])
        prev = before(pos)
        push(prev[text[prev] >= high])
    assert filled == len(out), "not every suffix was induced"
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks by the last key, then the one before, and so on; equal rows rank alike."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _same_stretch(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether text[a : a + length] equals text[b : b + length], row by row."""
    equal = np.ones(len(a), bool)
    for i in range(0, len(a), RANGE):
        n = length[i : i + RANGE]
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        differ = text[a[i : i + RANGE][row] + step] != text[b[i : i + RANGE][row] + step]
        equal[i + np.unique(row[differ])] = False
    return equal


def _sorted_stars(text: np.ndarray, rising: np.ndarray, mirror: np.ndarray, sigma: int, scratch: Scratch, size: int, memory: int) -> np.ndarray:
    """The S* suffixes in order, by recursion on the text of their names."""
    n = len(text)
    star = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    # the stretches between S* suffixes in order, from S* suffixes in order of their first symbol
    falling = induce(text, star[np.argsort(text[star], kind="stable")], ~rising, sigma, scratch, size, memory)
    up = induce(mirror, falling[::-1], _but_last(rising), sigma, scratch, size, memory)[::-1]
    is_star = np.zeros(n, bool)
    is_star[star] = True
    ordered = np.concatenate([[n - 1], up[is_star[up]]])
    length = np.zeros(n, np.int64)
    length[star] = np.append(np.diff(star) + 1, 1)
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    same[same] = _same_stretch(text, a[same], b[same], length[a[same]])
    name = np.zeros(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    names = name[star]
    if len(star) > int(names.max()) + 1:  # some stretches are equal: the text of names decides
        return star[sort_suffixes(names, int(names.max()) + 1, scratch, size, memory)]
    return star[np.argsort(names)]


def sort_suffixes(text: np.ndarray, sigma: int, scratch: Scratch, size: int = RANGE, memory: int = MEMORY) -> np.ndarray:
    """Suffix array of ``text``, symbols 0..sigma-1, whose last symbol is 0 and no other is."""
    if len(text) <= 2:
        return np.arange(len(text) - 1, -1, -1, dtype=np.int64)
    rising, mirror = types(text), sigma - 1 - text
    stars = _sorted_stars(text, rising, mirror, sigma, scratch, size, memory)
    falling = induce(text, stars, ~rising, sigma, scratch, size, memory)
    up = induce(mirror, falling[::-1], _but_last(rising), sigma, scratch, size, memory)[::-1]
    return _merged(text, falling, np.concatenate([[len(text) - 1], up]))[0]


def _merged(text: np.ndarray, falling: np.ndarray, rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both kinds together, by first symbol, falling before rising; and how they interleave."""
    heads = np.concatenate([text[falling].astype(np.int64) * 2, text[rising].astype(np.int64) * 2 + 1])
    order = np.argsort(heads, kind="stable")
    return np.concatenate([falling, rising])[order], order


def _run(text: np.ndarray, at: int, cap: int) -> int:
    """How often the first symbol of a suffix repeats at its start."""
    n = 1
    while n < cap and text[at + n] == text[at]:
        n += 1
    return n


def _between(text: np.ndarray, falling: int, rising: int, cap: int) -> int:
    """What a falling and a rising suffix of one first symbol share: the shorter run of it."""
    return min(_run(text, int(falling), cap), _run(text, int(rising), cap))


def neighbours_share(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order``, up to ``cap``."""
    shared = np.zeros(len(order), np.uint8)
    live = np.arange(1, len(order))
    for k in range(cap):
        live = live[text[order[live - 1] + k] == text[order[live] + k]]
        if not len(live):
            break
        shared[live] = k + 1
    return shared


def induce_prefixes(text: np.ndarray, roots: np.ndarray, root_shares: np.ndarray, want: np.ndarray, sigma: int, cap: int, scratch: Scratch, size: int = RANGE, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """As ``induce``, and for each suffix the symbols that it shares with the one before it
    (up to ``cap``, at most 255).

    Tuples in the queue carry their common prefix: what is pushed shares one symbol more
    with the last that was pushed to the same symbol than what pushed them share, which is
    the least of the values in between. A symbol is a range of its own here."""
    root_at = np.searchsorted(text[roots], np.arange(sigma + 1))
    queue = RangeQueue(sigma, scratch, memory)
    least = np.full(sigma, cap, np.int64)  # since the last push to each symbol
    total = int(want.sum())
    out, out_shares, filled = scratch.array(total, np.int64), scratch.array(total, np.uint8), 0

    def feed(at: np.ndarray, shares: np.ndarray) -> None:
        for i in range(0, len(at), size):
            part, own = at[i : i + size], shares[i : i + size].astype(np.int64)
            prev = part - 1
            index = np.flatnonzero((part > 0) & want[prev])
            symbols = text[prev[index]]
            order = np.argsort(symbols, kind="stable")
            index, symbols = index[order], symbols[order]
            cuts = [0, *(np.flatnonzero(np.diff(symbols)) + 1).tolist(), len(index)] if len(index) else [0]
            after = np.minimum(least, own.min())
            values = np.empty(len(index), np.int64)
            for x, y in zip(cuts, cuts[1:]):
                d, mine = int(symbols[x]), index[x:y]
                last = int(mine[-1]) + 1
                v = np.minimum.reduceat(own[:last], np.concatenate([[0], mine[:-1] + 1]))
                v[0] = min(v[0], least[d])
                values[x:y] = v
                after[d] = own[last:].min() if last < len(own) else cap
            least[:] = after
            queue.push(prev[index] << 8 | np.minimum(values + 1, cap), symbols)

    for symbol in range(sigma):
        begun, own = filled, roots[root_at[symbol] : root_at[symbol + 1]]
        while len(cur := queue.pop(symbol)):  # what a symbol induces in itself comes as the next generation
            at, shares = cur >> 8, cur & 255
            if filled == begun:
                shares[0] = 0
            out[filled : filled + len(at)], out_shares[filled : filled + len(at)] = at, shares
            filled += len(at)
            feed(at, shares)
        if len(own):
            shares = root_shares[root_at[symbol] : root_at[symbol + 1]].astype(np.int64)
            shares[0] = _between(text, out[filled - 1], own[0], cap) if filled > begun else 0
            feed(own, shares)
    assert filled == total, "not every suffix was induced"
    return out, out_shares


def suffixes_and_prefixes(text: np.ndarray, sigma: int, cap: int, scratch: Scratch, size: int = RANGE, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array as by ``sort_suffixes``, and the symbols that each suffix shares with the
    one before it, up to ``cap``; for small alphabets."""
    n = len(text)
    if n <= 2:
        order = sort_suffixes(text, sigma, scratch)
        return order, np.zeros(n, np.uint8)
    rising, mirror = types(text), sigma - 1 - text
    stars = _sorted_stars(text, rising, mirror, sigma, scratch, size, memory)
    falling, shares = induce_prefixes(text, stars, neighbours_share(text, stars, cap), ~rising, sigma, cap, scratch, size, memory)
    turned = np.concatenate([[0], shares[:0:-1]]).astype(np.uint8)[: len(falling)]
    down, down_shares = induce_prefixes(mirror, falling[::-1], turned, _but_last(rising), sigma, cap, scratch, size, memory)
    up = np.concatenate([[n - 1], down[::-1]])
    up_shares = np.concatenate([[0, 0], down_shares[:0:-1]]).astype(np.uint8)[: len(up)]
    order, places = _merged(text, falling, up)
    shared = np.concatenate([shares, up_shares])[places]
    # where the rising suffixes of a symbol begin after falling ones
    kind = places >= len(falling)
    for i in (np.flatnonzero(kind[1:] & ~kind[:-1]) + 1).tolist():
        shared[i] = _between(text, order[i - 1], order[i], cap) if text[order[i - 1]] == text[order[i]] else 0
    return order, shared


def _but_last(mask: np.ndarray) -> np.ndarray:
    """The end mark is induced by nothing: it is placed by hand."""
    out = mask.copy()
    out[-1] = False
    return out
