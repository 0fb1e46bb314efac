"""Per-partition suffix arrays over document shards, searched with test suffixes."""

import sys

import numpy as np
import pyarrow as pa

from meterfold.llm.common import ship

SHARD_BYTES = 4 << 20  # text per suffix array; a longer document is a shard of its own
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words_of(text):
    return (text or "").encode().translate(_WORD).split()


class TestSet:
    """Benchmark items as word numbers: every distinct window, and the suffix at every position."""

    def __init__(self, items, window):
        """items: (item number, text) pairs."""
        self.vocab, seqs, self.items = {}, [], []
        for number, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if ids:
                seqs.append(ids)
                self.items.append(number)
        self.window = window
        windows = {}
        for k, ids in enumerate(seqs):
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1):
                windows.setdefault(tuple(ids[at:at + size]), set()).add(self.items[k])
        self.owners = [np.array(sorted(x)) for x in windows.values()]
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.grams = np.zeros((len(windows), window), np.int64)
        for k, w in enumerate(windows):
            self.grams[k, :len(w)] = w
        self.least = int(self.sizes.min()) if windows else 0
        # All item texts in one array, each closed by a zero.
        self.text = np.array([x for ids in seqs for x in [*ids, 0]], np.int64)
        self.item_at = np.array([i for i, ids in zip(self.items, seqs) for _ in [*ids, 0]], np.int64)
        starts = np.cumsum([0, *[len(ids) + 1 for ids in seqs]])[:-1] if seqs else np.array([], np.int64)
        self.place = np.arange(len(self.text)) - np.repeat(starts, [len(ids) + 1 for ids in seqs])


def suffix_array(text):
    """Order of all suffixes of ``text`` by prefix doubling; zeros end a suffix and sort first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) if n else text
    if n and text.min() > 0:
        rank += 1
    step = 1
    while n:
        ahead = np.zeros(n, np.int64)
        ahead[:max(0, n - step)] = rank[step:]
        key = np.where(rank > 0, rank * (n + 2) + ahead, 0)
        order, new = np.unique(key, return_inverse=True)
        new = new.astype(np.int64) + (order[0] > 0)
        if len(order) == (rank.max() + (rank.min() == 0)) or np.array_equal(new, rank):
            break
        rank, step = new, step * 2
    return np.argsort(rank, kind="stable")


class Shard:
    """Suffix array of the runs of a shard's words that a test word sequence could match."""

    def __init__(self, ids, least):
        """ids: word numbers, zero for words no test item has and between documents."""
        known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        # Runs long enough, each closed by a zero; ``home`` maps back to the shard.
        sizes = ends - starts + 1
        total = int(sizes.sum())
        offset = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if total else starts
        self.home = np.arange(total) + offset
        self.text = np.where(self.home < np.repeat(ends, sizes), ids[np.minimum(self.home, max(len(ids) - 1, 0))], 0) if total else np.array([], np.int64)
        order = suffix_array(self.text)
        self.order = order[self.text[order] > 0]

    def _bound(self, grams, sizes, upper):
        """First place in the suffix array whose prefix is not below (or is above) each gram."""
        lo = np.zeros(len(grams), np.int64)
        hi = np.full(len(grams), len(self.order), np.int64)
        padded = np.concatenate((self.text, np.zeros(grams.shape[1] + 1, np.int64)))
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            at, below, undecided = self.order[mid], np.zeros(len(open_), bool), np.arange(len(open_))
            for k in range(grams.shape[1]):
                # A gram that ends here equals the prefix: it is below the upper bound only.
                ended = sizes[open_[undecided]] <= k
                below[undecided[ended]] = upper
                undecided = undecided[~ended]
                if not len(undecided):
                    break
                x, y = padded[at[undecided] + k], grams[open_[undecided], k]
                below[undecided[x < y]] = True
                undecided = undecided[x == y]
            below[undecided] = upper
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]

    def find(self, tests):
        """(window number, position in the shard) of every occurrence of every test window."""
        if not len(self.order) or not len(tests.grams):
            return np.array([], np.int64), np.array([], np.int64)
        lo = self._bound(tests.grams, tests.sizes, False)
        hi = self._bound(tests.grams, tests.sizes, True)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return which, self.home[self.order[place]]

    def longest(self, tests, depth, rank):
        """For the suffix at every test position: (length, position in the shard) of its longest match.

        ``rank``: a number per position of the shard; of equally long matches the least is given.
        """
        n = len(tests.text)
        if not len(self.order) or not n:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        padded = np.concatenate((tests.text, np.zeros(depth, np.int64)))
        grams = np.lib.stride_tricks.sliding_window_view(padded, depth)[:n]
        grams = np.where(np.cumprod(grams > 0, axis=1), grams, 0)
        at = self._bound(grams, np.maximum(1, (grams > 0).sum(1)), False)
        text = np.concatenate((self.text, np.zeros(depth, np.int64)))
        best, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for near in (at - 1, at):
            place = self.order[np.clip(near, 0, len(self.order) - 1)]
            alive, size = (near >= 0) & (near < len(self.order)) & (tests.text > 0), np.zeros(n, np.int64)
            for k in range(depth):
                alive = alive & (grams[:, k] > 0) & (text[place + k] == grams[:, k])
                if not alive.any():
                    break
                size += alive
            best = np.maximum(best, size)
        met = np.flatnonzero(best)
        if len(met):
            prefix = np.where(np.arange(depth) < best[met, None], grams[met], 0)
            lo = self._bound(prefix, best[met], False)
            hi = self._bound(prefix, best[met], True)
            by_rank = np.argsort(rank, kind="stable")
            turn = np.empty(len(rank), np.int64)
            turn[by_rank] = np.arange(len(rank))
            where[met] = by_rank[_least(turn[self.home[self.order]], lo, hi)]
        return best, where


def _least(values, lo, hi):
    """The least of values[lo:hi] for every (not empty) range."""
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1  # 2 ** power <= hi - lo
    out = np.zeros(len(lo), np.int64)
    for k in range(int(power.max()) + 1):
        if k:
            half = 1 << (k - 1)
            values = np.minimum(values[:-half], values[half:])
        q = np.flatnonzero(power == k)
        out[q] = np.minimum(values[lo[q]], values[hi[q] - (1 << k)])
    return out


def shards(batch, tests):
    """(rows, ids, starts): groups of a batch's documents as word numbers, a zero after each."""
    rows, parts, starts, size, at = [], [], [], 0, 0
    get = tests.vocab.get
    texts = batch.column("text")
    for k in range(batch.num_rows):
        words = words_of(texts[k].as_py())
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        rows.append(k)
        starts.append(at)
        parts += [ids, np.zeros(1, np.int64)]
        at += len(ids) + 1
        size += 8 * len(ids)
        if size >= SHARD_BYTES:
            yield np.array(rows), np.concatenate(parts), np.array([*starts, at])
            rows, parts, starts, size, at = [], [], [], 0, 0
    if rows:
        yield np.array(rows), np.concatenate(parts), np.array([*starts, at])


def _cover(places, sizes):
    """Non-overlapping [start, end) ranges that cover the given windows."""
    order = np.argsort(places, kind="stable")
    lo, hi = places[order], np.maximum.accumulate(places[order] + sizes[order])
    first = np.concatenate(([True], lo[1:] > hi[:-1]))
    last = np.concatenate((first[1:], [True]))
    return lo[first], hi[last]


def hits(items, window, names):
    """Batches of (doc_id, text) to (doc_id, n_words, hit_from, hit_to, items)."""

    def run(batches):
        tests = TestSet(items, window)
        for batch in batches:
            n_words, starts, ends, owners = [], [], [], []
            for rows, ids, begins in shards(batch, tests):
                which, at = Shard(ids, tests.least).find(tests)
                doc = np.searchsorted(begins, at, side="right") - 1
                order = np.argsort(doc, kind="stable")
                which, at, doc = which[order], at[order], doc[order]
                cuts = np.searchsorted(doc, np.arange(len(rows) + 1))
                for k in range(len(rows)):
                    n_words.append(int(begins[k + 1] - begins[k] - 1))
                    mine = slice(cuts[k], cuts[k + 1])
                    if cuts[k] == cuts[k + 1]:
                        starts.append([]), ends.append([]), owners.append([])
                        continue
                    lo, hi = _cover(at[mine] - begins[k], tests.sizes[which[mine]])
                    starts.append(lo.tolist()), ends.append(hi.tolist())
                    owners.append(np.unique(np.concatenate(
                        [tests.owners[w] for w in np.unique(which[mine])])).tolist())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()),
                pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                pa.array([[names[i] for i in x] for x in owners], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "hit_from", "hit_to", "items"])

    return run


def longest(items, window, names, least):
    """Batches of documents to the longest match, of ``least`` words or more, of every test suffix in every shard."""

    def run(batches):
        tests = TestSet(items, window)
        depth = int(tests.place.max()) + 1 if len(tests.place) else 1
        for batch in batches:
            out = [[], [], [], [], []]
            ids_of = batch.column("doc_id").to_pylist()
            for rows, ids, begins in shards(batch, tests):
                # Positions in the order of (doc_id, doc_pos), null ids first.
                number = {x: i for i, x in enumerate(sorted({ids_of[k] for k in rows}, key=lambda x: (x is not None, x)))}
                doc = np.repeat(np.array([number[ids_of[k]] for k in rows]), np.diff(begins))
                rank = doc * (len(ids) + 1) + np.arange(len(ids)) - np.repeat(begins[:-1], np.diff(begins))
                size, at = Shard(ids, least).longest(tests, depth, rank)
                for q in np.flatnonzero(size >= max(1, least)):
                    k = int(np.searchsorted(begins, at[q], side="right") - 1)
                    row = (names[tests.item_at[q]], int(tests.place[q]), int(size[q]),
                           ids_of[rows[k]], int(at[q] - begins[k]))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                pa.array(out[3], batch.column("doc_id").type), pa.array(out[4], pa.int64())],
                names=["item", "item_pos", "length", "doc_id", "doc_pos"])

    return run


ship(sys.modules[__name__])
