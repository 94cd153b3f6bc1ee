"""Byte-pair merging of many words at once.

Words are rows of symbol ids. In each round every word merges its best pair, the leftmost of equals, as an agenda
would; words without a pair left are done. Very long words go through an agenda of their own, whose work does not
grow with the square of their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

NONE = np.int32(2**31 - 1)
_LONG = 256
_ROUNDS = 4  # after so many, the gaps that merges leave are closed
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """(left, right) -> (rank, merged id), lower ranks first; a hash table in flat arrays."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.int64) << 24 | np.asarray(right, np.int64)).astype(np.uint64)
        self.bits = max(10, int(len(keys) * 8).bit_length())
        size = 1 << self.bits
        self.keys, self.rank = np.full(size, np.iinfo(np.uint64).max, np.uint64), np.full(size, NONE)
        self.merged = np.zeros(size, np.int32)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        slot, todo, self.reach = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.reach += 1
            free = todo[self.keys[slot[todo]] == np.iinfo(np.uint64).max]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.rank[slot[first]], self.merged[slot[first]] = keys[first], rank[first], merged[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)
        self._at = None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where there is no pair) and places in `merged`."""
        keys = left.astype(np.uint64) << np.uint64(24) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank = np.where(self.keys[slot] == keys, self.rank[slot], NONE)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != np.iinfo(np.uint64).max))
        for _ in range(self.reach):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[todo]]
            hit = seen == keys[todo]
            rank[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (seen != np.iinfo(np.uint64).max)]
        return rank, slot


Skip = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def merge(symbols: np.ndarray, at: np.ndarray, pairs: Pairs, skip: Skip | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of word i are symbols[at[i]:at[i + 1]]; returns the merged symbols in the same form.

    skip(word, start, left, right) says which candidate merges never happen: those of the word's symbols `left`,
    beginning at character `start` of the word, and `right`.
    """
    count = np.diff(at)
    words = np.flatnonzero(count > 0)
    long = words[count[words] > _LONG]
    done: list[tuple[np.ndarray, np.ndarray]] = []  # (word, symbol), words in order within each part
    for w in long.tolist():
        out = np.array(agenda(symbols[at[w]:at[w + 1]].tolist(), pairs, w, skip), np.int64)
        done.append((np.full(len(out), w, np.int64), out))
    owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
    start = (np.arange(len(symbols)) - np.repeat(at[:-1], count)).astype(np.int32)
    x = symbols.astype(np.int32)
    if len(long):
        kept = count[owner] <= _LONG
        owner, start, x = owner[kept], start[kept], x[kept]

    def ranked(i: np.ndarray) -> None:
        """Sets rank and merged id of the pairs that begin at positions i."""
        rank[i] = NONE
        p = i[after[i] >= 0]
        left, right = x[p], x[after[p]]
        found, slot = pairs.find(left, right)
        if skip is not None:
            some = np.flatnonzero(found < NONE)
            found[some[skip(owner[p[some]], start[p[some]], left[some], right[some])]] = NONE
        rank[p], into[p] = found, pairs.merged[slot]

    def laid_out() -> tuple[np.ndarray, ...]:
        """Where words begin and how long they are; for each position the next and the one before in its word, or -1."""
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        after, before = np.arange(1, len(x) + 1, dtype=np.int32), np.arange(-1, len(x) - 1, dtype=np.int32)
        before[heads] = after[heads[1:] - 1] = after[-1:] = -1
        return heads, np.diff(np.concatenate([heads, [len(x)]])), after, before

    rank, into = np.full(len(x), NONE), np.zeros(len(x), np.int32)
    if len(x):
        heads, sizes, after, before = laid_out()
        ranked(np.arange(len(x)))
    rounds = 0
    while len(x):
        best = np.minimum.reduceat(rank, heads)
        going = best < NONE
        rounds += 1
        # merged symbols stay where they are, marked, and words that have ended too, until it pays to close the gaps
        if rounds % _ROUNDS == 0 or 4 * np.count_nonzero(going) < 3 * len(going):
            there, on = x >= 0, np.repeat(going, sizes)
            ended = there & ~on
            done.append((owner[ended], x[ended]))
            on = np.flatnonzero(on & there)
            x, owner, start, rank, into = (v[on] for v in (x, owner, start, rank, into))
            if not len(x):
                break
            heads, sizes, after, before = laid_out()
            best = best[going]
            going = np.ones(len(best), bool)
        here = np.flatnonzero(rank == np.repeat(np.where(going, best, np.int32(-1)), sizes))
        if len(here) > 1:
            here = here[np.concatenate([[True], owner[here[1:]] != owner[here[:-1]]])]
        gone = after[here]
        x[here], x[gone], rank[gone] = into[here], -1, NONE
        beyond = after[gone]
        after[here] = beyond
        some = beyond >= 0
        before[beyond[some]] = here[some]
        previous = before[here]
        ranked(np.concatenate([here, previous[previous >= 0]]))
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word, symbol = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
    order = np.argsort(word, kind="stable")
    return symbol[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(count)))])


def agenda(symbols: list[int], pairs: Pairs, word: int = 0, skip: Skip | None = None) -> list[int]:
    """One word by a priority queue of candidate merges: best rank first, leftmost of equals; skipped ones are dropped."""
    if pairs._at is None:
        used = np.flatnonzero(pairs.rank < NONE)
        pairs._at = dict(zip(pairs.keys[used].tolist(), zip(pairs.rank[used].tolist(), pairs.merged[used].tolist())))
    x, known = list(symbols), pairs._at
    after, before, heap = list(range(1, len(x) + 1)), list(range(-1, len(x) - 1)), []

    def offer(i: int) -> None:
        j = after[i] if 0 <= i else len(x)
        if i < 0 or j >= len(x):
            return
        found = known.get(x[i] << 24 | x[j])
        if found is None or skip is not None and skip(*(np.array([v], np.int64) for v in (word, i, x[i], x[j])))[0]:
            return
        heapq.heappush(heap, (found[0], i, x[i], x[j], found[1]))

    for i in range(len(x)):
        offer(i)
    while heap:
        _, i, left, right, into = heapq.heappop(heap)
        j = after[i]
        if x[i] != left or j >= len(x) or x[j] != right:
            continue
        x[i], x[j] = into, -1
        after[i] = after[j]
        if after[j] < len(x):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [s for s in x if s >= 0]


def gather(flat: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows named by `index` one after the other, and where each begins."""
    size = np.diff(at)[index]
    out_at = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(at[:-1][index] - out_at[:-1], size) + np.arange(out_at[-1])], out_at
