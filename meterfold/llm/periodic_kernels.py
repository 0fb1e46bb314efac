"""Dyadic square catching over word sequences, in numpy."""

import itertools
import sys

import numpy as np
import pyarrow as pa

from meterfold.llm.common import ship

STREAM_WORDS = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def _values(words):
    """A 64-bit value for every word number (the finaliser of splitmix64)."""
    x = words.astype(np.uint64) + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base, start, n):
    """base**start, ..., base**(start + n - 1) modulo 2**64."""
    first = pow(base, start, 1 << 64)
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = first
    return np.cumprod(out, dtype=np.uint64)


class SquareCatchers:
    """Repetitions of a word sequence that grows at its end.

    A completed block of ``size`` words (a power of two) is watched by two catchers, for the periods from
    twice to four times its size: a square of such a period has a whole block in its left half, and the
    block returns one period later. Every appended word completes a window of each size, whose name (a
    hash of its words) is compared with the blocks that are 2 and 3 sizes back. A match starts a
    suffix comparison to its left, by names of any length; to its right the comparison stays open and
    every append advances it. When what agrees is as long as the period a square is complete; longer
    stretches of the same period are one run.

    Names of equal words are equal, so nothing is missed; they may collide, so ``runs`` looks at every
    reported run word by word.
    """

    def __init__(self, times=4, least=6, max_period=None):
        self.times, self.least, self.max_period = times, least, max_period
        self.words = np.empty(0, np.int64)
        self.sums = np.zeros(1, np.uint64)  # of value * base**place
        self.unit = np.empty(0, np.uint64)  # base**-place
        none = np.empty(0, np.int64)
        # Stretches of words that equal the word one period before them: [low, high) and the period.
        self.low, self.high, self.period = none, none, none

    def _name(self, start, size):
        return (self.sums[start + size] - self.sums[start]) * self.unit[start]

    def _sizes(self):
        # A window with a block two sizes before it ends after three sizes.
        size, longest = 1, 2 * len(self.words) // 3 if self.max_period is None else self.max_period
        while size == 1 or 2 * size <= longest:
            yield size
            size *= 2

    def append(self, words):
        """Take further words; afterwards all runs of the words so far are known."""
        words, old = np.asarray(words, np.int64), len(self.words)
        if not len(words):
            return
        n = old + len(words)
        self.words = np.concatenate([self.words, words])
        terms = _values(words) * _powers(_BASE, old, len(words))
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(terms, dtype=np.uint64)])
        self.unit = np.concatenate([self.unit, _powers(pow(_BASE, -1, 1 << 64), old, len(words))])
        self._advance(old, n)
        found = [self._caught(size, back, old, n) for size in self._sizes()
                 for back in ((1, 2, 3) if size == 1 else (2, 3))]
        at, period, size = (np.concatenate(part) for part in zip(*found))
        low = at - self._common(at, at - period, at - period, -1)
        high = at + size + self._common(at + size, at + size - period, n - at - size, 1)
        self._merge(low, high, period, n)

    def _advance(self, old, n):
        """Move the comparisons on that agreed up to the end."""
        at = np.flatnonzero(self.high == old)
        high, period = self.high[at], self.period[at]
        self.high[at] = high + self._common(high, high - period, n - high, 1)

    def _caught(self, size, back, old, n):
        """Windows that a catcher ``back`` sizes before them knows: (start, period, size), one per stretch."""
        lowest = max(old - size + 1, back * size)
        base = lowest // size * size  # the first window's row of blocks
        stop = n - size + 1
        if lowest >= stop:
            return (np.empty(0, np.int64),) * 3
        at = np.arange(base, stop)
        blocks = self._name(np.arange(base - back * size, stop - back * size, size), size)
        same = np.repeat(blocks, size)[:len(at)] == self._name(at, size)
        # The window one size earlier tells of the same stretch; windows before ``lowest`` are not new.
        first = same.copy()
        first[size:] &= ~same[:-size]
        first[:lowest - base] = False
        where = np.flatnonzero(first)
        return at[where], back * size + where % size, np.full(len(where), size)

    def _common(self, a, b, limit, side):
        """How many words agree going from a and b to the right (1), or before them to the left (-1)."""
        low, high = np.zeros(len(a), np.int64), np.maximum(limit, 0)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                return low
            mid = (low[todo] + high[todo] + 1) // 2
            x, y = (a[todo], b[todo]) if side > 0 else (a[todo] - mid, b[todo] - mid)
            same = self._name(x, mid) == self._name(y, mid)
            low[todo[same]] = mid[same]
            high[todo[~same]] = mid[~same] - 1

    def _merge(self, low, high, period, n):
        """Add stretches; those that end can no longer grow and stay only if they hold a run."""
        low, high, period = (np.concatenate(pair) for pair in (
            (self.low, low), (self.high, high), (self.period, period)))
        keep = (high == n) | self._long(high - low + period, period)
        low, high, period = low[keep], high[keep], period[keep]
        order = np.lexsort((-high, low, period))
        low, high, period = low[order], high[order], period[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (period[1:] != period[:-1])
        self.low, self.high, self.period = low[new], high[new], period[new]

    def _long(self, length, period):
        return length >= np.maximum(self.least, self.times * period)

    def runs(self):
        """(start, length, period) of every run so far, by start, then period; the period is the smallest."""
        start, stop, period = self._smallest(self.low - self.period, self.high, self.period)
        if self._differ(start, stop, period):
            start, stop, period = self._smallest(*self._sought_again())
        order = np.lexsort((period, start))
        return start[order], (stop - start)[order], period[order]

    def _smallest(self, start, stop, period):
        """Long stretches; one that also has multiples of its smallest period counts once."""
        long = self._long(stop - start, period)
        start, stop, period = start[long], stop[long], period[long]
        order = np.lexsort((period, stop, start))
        start, stop, period = start[order], stop[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
        return start[new], stop[new], period[new]

    def _differ(self, start, stop, period):
        """Whether a stretch holds a word that differs from the one a period later: a name collided."""
        length = stop - start - period
        place = np.arange(length.sum()) + np.repeat(start + length - np.cumsum(length), length)
        return (self.words[place] != self.words[place + np.repeat(period, length)]).any()

    def _sought_again(self):
        """All stretches of the caught periods, found without names."""
        start, stop, period = [], [], []
        for q in np.unique(self.period):
            same = np.concatenate([[False], self.words[q:] == self.words[:-q], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            start.append(edges[::2])
            stop.append(edges[1::2] + q)
            period.append(np.full(len(edges) // 2, q))
        return np.concatenate(start), np.concatenate(stop), np.concatenate(period)


def _numbered(texts):
    """Words of every text as bytes, and their numbers (equal words, equal numbers)."""
    numbers, counter, out = {}, itertools.count(), []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        out.append((words, np.fromiter(map(numbers.setdefault, words, counter), np.int64, len(words))))
    return out


def _caught(numbered, times, least):
    """Per text (start, length, period) of its runs; texts of like length share one stream of words."""
    out = [None] * len(numbered)
    classes = {}
    for i, (_, numbers) in enumerate(numbered):
        if len(numbers) >= max(least, times):
            classes.setdefault(len(numbers).bit_length(), []).append(i)
    for members in classes.values():
        longest = max(len(numbered[i][1]) for i in members)
        catchers = SquareCatchers(times, least, max(1, longest // times))
        parts, starts, at = [], [], 0
        for k, i in enumerate(members):
            starts.append(at)
            parts += [numbered[i][1], np.array([-1 - k])]  # a border equals no other word
            at += len(numbered[i][1]) + 1
        catchers.append(np.concatenate(parts))
        start, length, period = catchers.runs()
        owner = np.searchsorted(starts, start, "right") - 1
        cut = np.searchsorted(owner, np.arange(len(members) + 1))
        for k, i in enumerate(members):
            a, b = cut[k], cut[k + 1]
            if a < b:
                out[i] = (start[a:b] - starts[k], length[a:b], period[a:b])
    return out


def _best(start, length, period):
    """The run of the greatest exact exponent; of equal ones the first, then the shortest period."""
    best = 0
    for k in range(1, len(start)):
        if int(length[k]) * int(period[best]) > int(length[best]) * int(period[k]):
            best = k
    return best


def _kept(words, start, length, period):
    """The words outside every run or in the first period of all runs that hold them."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return list(itertools.compress(words, np.cumsum(edges[:-1]) == 0))


def _chunks(texts):
    """Neighbouring texts with about ``STREAM_WORDS`` words (guessed from their length) at most."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > 6 * STREAM_WORDS:
            yield texts[begin:i]
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield texts[begin:]


def runs_of(times, least):
    """mapInArrow over (doc_id, text): doc_id, n_words, runs, best, kept."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run_batches(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_words, runs, best, kept = [], [], [], []
            for chunk in _chunks(texts):
                numbered = _numbered(chunk)
                for (words, _), found in zip(numbered, _caught(numbered, times, least)):
                    n_words.append(len(words))
                    rows = [] if found is None else [
                        {"start": s, "length": n, "period": p} for s, n, p in zip(*(x.tolist() for x in found))]
                    runs.append(rows)
                    best.append(rows[_best(*found)] if rows else None)
                    kept.append(b" ".join(_kept(words, *found) if rows else words))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run)),
                pa.array(best, run), pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "best", "kept"])

    return run_batches


ship(sys.modules[__name__])
