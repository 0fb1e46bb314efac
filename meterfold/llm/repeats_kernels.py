"""Recompression of word sequences in numpy: naming runs and pairs, and windows to verify."""

import sys

import numpy as np
import pyarrow as pa
import xxhash

from meterfold.llm.common import ship

ROUNDS = 6
NONE = np.uint64(2**64 - 1)
GROUP = 1 << 17  # words parsed at once
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_P1, _P2 = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)


def mixed(x):
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text):
    return (text or "").encode().split()


def names_of(words):
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Level:
    """Symbols of one round: names, where they start, and the words they depend on.

    A symbol with dependence [low, high) stands at the same place in every text that holds the words
    low..high: what made it, and what kept its neighbours from joining it, lies inside. Texts stand
    in one array, a border symbol before the first and after each; what depends on a border can be
    relied on nowhere.
    """

    def __init__(self, name, start, low, high, border):
        self.name, self.start, self.low, self.high, self.border = name, start, low, high, border

    def _grouped(self, first, seed, depends_before, depends_after):
        """Groups of neighbours as symbols of the next level, named by what they are made of."""
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(first)) - 1
        size = last - at + 1
        made = mixed(self.name[at] * _M1 + mixed(self.name[last] + size.astype(np.uint64) * _M2) + seed)
        name = np.where(size == 1, self.name[at], made)
        low, high = np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at)
        for need, other in ((depends_before(at, size), np.maximum(at - 1, 0)),
                            (depends_after(at, size), np.minimum(last + 1, len(first) - 1))):
            k = np.flatnonzero(need)
            low[k] = np.minimum(low[k], self.low[other[k]])
            high[k] = np.maximum(high[k], self.high[other[k]])
        return Level(name, self.start[at], low, high, self.border[at])

    def runs(self, seed):
        """Runs of one symbol become one symbol named by the symbol and the length.

        A quarter of all symbols has its turn in a round. That their runs end there depends on both
        neighbours; the other symbols depend on nothing new.
        """
        turn = ((mixed(self.name ^ seed) >> np.uint64(62)) == 0) & ~self.border
        first = np.ones(len(self.name), bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | ~turn[1:] | ~turn[:-1]
        here = lambda at, size: turn[at]
        return self._grouped(first, seed, here, here)

    def pairs(self, seed):
        """Every left-class symbol joins a right-class symbol that follows it.

        A right-class symbol alone depends on what is before it, a left-class one on what follows; a
        pair depends on nothing but itself.
        """
        side = (mixed(self.name + seed) >> np.uint64(63)).astype(bool)
        left, right = side & ~self.border, ~side & ~self.border
        first = np.ones(len(self.name), bool)
        first[1:] = ~(left[:-1] & right[1:])
        return self._grouped(first, seed, lambda at, size: (size == 1) & right[at],
                             lambda at, size: (size == 1) & left[at])


def spread(lo, hi, n):
    """How many of the ranges lo..hi hold each of 0..n-1."""
    return np.cumsum(np.bincount(lo, minlength=n + 1)[:n + 1] - np.bincount(hi + 1, minlength=n + 1)[:n + 1])[:n]


def least(lo, hi, value, n, longest):
    """The least value of all ranges lo..hi (at most ``longest`` wide) over each of 0..n-1."""
    depth = int(longest).bit_length()
    size = np.maximum(hi - lo + 1, 1)
    power = np.frexp(size.astype(np.float64))[1] - 1  # 2 ** power <= size
    table = np.full((depth, n), NONE)
    np.minimum.at(table, (power, lo), value)
    np.minimum.at(table, (power, hi + 1 - (1 << power)), value)
    for k in range(depth - 1, 0, -1):
        half = 1 << (k - 1)
        np.minimum(table[k - 1], table[k], out=table[k - 1])
        np.minimum(table[k - 1, half:], table[k, :-half], out=table[k - 1, half:])
    return table[0]


class Texts:
    """Several texts as one array of word names, a border before the first and after each."""

    def __init__(self, names, window):
        self.window = window
        self.sizes = np.array([len(x) for x in names])
        self.begins = np.cumsum(self.sizes + 1) - self.sizes
        zero = np.zeros(1, np.uint64)
        self.names = np.concatenate([zero, *(x for n in names for x in (n, zero))])
        self.border = np.zeros(len(self.names), bool)
        self.border[0] = self.border[self.begins + self.sizes] = True
        self.text_of = np.concatenate(([0], np.repeat(np.arange(len(names)), self.sizes + 1)))

    def anchors(self, rounds):
        """(anchor, valid) for the window that starts at each word.

        A symbol with dependence [low, high) is certain in the windows that start at high - window ..
        low. A window's anchor is its longest certain symbol of the highest level that has one, down to
        the words themselves; ties go by the hash of the name. It depends on the window's words alone.
        """
        n, window = len(self.names), self.window
        last = (self.begins + self.sizes - window)[self.text_of]
        at = np.arange(n)
        valid = (at <= last) & ~self.border
        anchor, free = np.full(n, NONE), valid.copy()
        far = np.iinfo(np.int64).max
        level = Level(self.names, at, np.where(self.border, -1, at), np.where(self.border, far, at + 1), self.border)
        levels = [level]
        for r in range(rounds):
            seed = mixed(np.array([r + 1], np.uint64))[0]
            levels.append(levels[-1].runs(seed).pairs(seed ^ _M2))
        for depth in range(rounds, -1, -1):
            level = levels[depth]
            sure = np.flatnonzero((level.low >= 0) & (level.high < far) & (level.high - level.low <= window))
            if depth < rounds:
                open_ = np.concatenate(([0], np.cumsum(free)))
            text = self.text_of[level.start[sure]]
            lo = np.maximum(level.high[sure] - window, self.begins[text])
            hi = np.minimum(level.low[sure], self.begins[text] + self.sizes[text] - window)
            keep = lo <= hi
            if depth < rounds:
                keep[keep] = open_[hi[keep] + 1] > open_[lo[keep]]
            sure, lo, hi = sure[keep], lo[keep], hi[keep]
            span = np.diff(np.append(level.start, n))[sure]
            name = mixed(level.name[sure] + np.uint64(depth))
            order = (np.uint64(255) - np.minimum(span, 255).astype(np.uint64)) << np.uint64(56)
            found = least(lo, hi, order | (name >> np.uint64(8)), n, window)
            served = free & (found != NONE)
            anchor[served] = found[served]
            free &= ~served
            if not free.any():
                break
        return anchor, valid


    def keys(self, places):
        """Two 64-bit hashes of the windows that start at ``places``."""
        out = []
        for p in (_P1, _P2):
            powers = np.full(len(self.names), p)
            powers[0] = 1
            back = np.full(len(self.names), np.uint64(pow(int(p), -1, 1 << 64)))
            back[0] = 1
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
                mixed(self.names ^ p) * np.multiply.accumulate(powers))))
            out.append(mixed((sums[places + self.window] - sums[places]) * np.multiply.accumulate(back)[places]))
        return out


def groups(batch, window):
    """(rows, Texts): texts of a batch that are long enough, some at a time."""
    rows, names, size = [], [], 0
    texts = batch.column("text")
    for k in range(batch.num_rows):
        words = words_of(texts[k].as_py())
        if len(words) >= window:
            rows.append(k)
            names.append(names_of(words))
            size += len(words)
        if size >= GROUP:
            yield np.array(rows), Texts(names, window)
            rows, names, size = [], [], 0
    if rows:
        yield np.array(rows), Texts(names, window)


def symbols(window, rounds):
    """Batches of (text_hash, text) to the distinct (name, text_hash) of the anchors of all windows."""

    def run(batches):
        for batch in batches:
            for rows, texts in groups(batch, window):
                anchor, valid = texts.anchors(rounds)
                new = valid.copy()
                new[1:] &= (anchor[1:] != anchor[:-1]) | (texts.text_of[1:] != texts.text_of[:-1])
                name, text = anchor[new], texts.text_of[new]
                order = np.lexsort((name, text))
                name, text = name[order], text[order]
                new = np.ones(len(name), bool)
                new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[new].view(np.int64)), batch.column("text_hash").take(pa.array(rows[text[new]]))],
                    names=["name", "text_hash"])

    return run


def candidates(window, rounds):
    """Batches of (doc_id, text_hash, text, names) to the windows whose anchors are in ``names``."""

    def run(batches):
        for batch in batches:
            for rows, texts in groups(batch, window):
                known = [batch.column("names")[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                         for k in rows.tolist()]
                # A name counts for its own text only.
                own = np.concatenate([mixed(x + np.uint64(k)) for k, x in enumerate(known)])
                anchor, valid = texts.anchors(rounds)
                place = np.flatnonzero(valid)
                seen = mixed(anchor[place] + texts.text_of[place].astype(np.uint64))
                place = place[np.isin(seen, own)]
                if len(place):
                    h1, h2 = texts.keys(place)
                    text = texts.text_of[place]
                    at = pa.array(rows[text])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column("doc_id").take(at),
                         batch.column("text_hash").take(at), pa.array(place - texts.begins[text])],
                        names=["h1", "h2", "doc_id", "text_hash", "place"])

    return run


def removals(window):
    """Batches of (doc_id, text, copy, places) to (doc_id, n_words, n_removed, kept).

    ``copy``: the whole text is a later copy of another; ``places``: starts of repeated windows.
    """

    def run(batches):
        for batch in batches:
            texts, copies, places = (batch.column(c) for c in ("text", "copy", "places"))
            sizes, removed, kept = [], [], []
            for k in range(batch.num_rows):
                words = words_of(texts[k].as_py())
                n = len(words)
                gone = np.zeros(n, bool)
                if copies[k].as_py() and n >= window:
                    gone[:] = True
                elif places[k].is_valid:
                    at = places[k].values.to_numpy(zero_copy_only=False)
                    gone = spread(at, at + window - 1, n) > 0
                sizes.append(n)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


ship(sys.modules[__name__])
