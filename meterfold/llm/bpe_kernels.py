"""Rank-synchronous merging of byte-pair pieces over ragged numpy arrays."""

import heapq
import re
import sys

import numpy as np
import pyarrow as pa
import sentencepiece

from meterfold.llm.common import ship

SPACE = "▁"
LONG = 192  # symbols; a longer pre-token is merged by a queue, in n log n
CACHE = 1 << 20
BATCH = 1 << 15
# A run of spaces belongs to the word after it: no piece has a space after another character.
_PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
NONE = np.int32(2**31 - 1)


class Pieces:
    """Symbols, merge ranks and surviving-symbol costs of a BPE model with byte fallback."""

    def __init__(self, path):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        bad = [p for p in pieces if SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1)]
        if bad:
            raise ValueError(f"pieces that cross pre-tokens: {bad[:5]}")
        order = sorted(set(pieces.values()), reverse=True)
        rank = {score: k for k, score in enumerate(order)}  # equal scores merge from the left
        self.number, self.cost = {}, []
        for p in pieces:
            self.number[p], _ = len(self.cost), self.cost.append(1)
        for p in list(pieces):
            for c in p:
                self.symbol(c)
        left, right, to, ranks = [], [], [], []
        for p, score in pieces.items():
            for k in range(1, len(p)):
                a, b = self.number.get(p[:k]), self.number.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(self.number[p]), ranks.append(rank[score])
        self.known = len(self.cost)
        self.pair = {(a, b): (r, t) for a, b, r, t in zip(left, right, ranks, to)}
        keys = np.array(left, np.int64) * (1 << 32) + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.to = np.array(to, np.int32)[order]
        bits = int(len(keys) * 4).bit_length()
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[self._slot(self.keys)] = np.arange(len(keys))

    def symbol(self, c):
        """Number of a character; one without a piece of its own costs its bytes."""
        if c not in self.number:
            self.number[c] = len(self.cost)
            self.cost.append(len(c.encode()))
        return self.number[c]

    def _slot(self, keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def lookup(self, a, b):
        """(rank, merged symbol) of pairs; rank NONE where the pair does not merge."""
        key = a.astype(np.int64) * (1 << 32) + b
        at = self.table[self._slot(key)]
        miss = np.flatnonzero(self.keys[at] != key)
        if len(miss):
            place = np.minimum(np.searchsorted(self.keys, key[miss]), len(self.keys) - 1)
            at[miss] = np.where(self.keys[place] == key[miss], place, -1)
        return np.where(at >= 0, self.ranks[at], NONE), self.to[at]

    def count_long(self, symbols):
        """Tokens of one long sequence: the same merges, lowest rank first, from a queue."""
        n, s = len(symbols), list(symbols)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.pair[p][0], i, p) for i, p in enumerate(zip(s, s[1:])) if p in self.pair]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = nxt[i] if s[i] is not None else n
            if j >= n or (s[i], s[j]) != p:
                continue
            s[i], s[j] = self.pair[p][1], None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (s[a], s[b]) in self.pair:
                    heapq.heappush(heap, (self.pair[(s[a], s[b])][0], a, (s[a], s[b])))
        return sum(self.cost[x] for x in s if x is not None)

    def count(self, tokens):
        """Surviving symbols of each pre-token: every sequence merges its lowest-rank pair at once.

        A merge shortens a sequence by one, so the sequences of one current length stay a matrix: the
        sweep goes from the longest length down, and sequences join it at their own length.
        """
        out = np.zeros(len(tokens), np.int64)
        get, symbol = self.number.get, self.symbol
        flat, by_size = [], {}
        for k, t in enumerate(tokens):
            ids = [x if (x := get(c)) is not None else symbol(c) for c in t]
            if len(ids) > LONG:
                out[k] = self.count_long(ids)
            else:
                rows, flat = by_size.setdefault(len(ids), ([], []))
                rows.append(k)
                flat.extend(ids)
        if not by_size:
            return out
        cost = np.array(self.cost, np.int64)
        rows = np.zeros(0, np.int64)
        symbols = rank = None
        for size in range(max(by_size), 0, -1):
            if size in by_size:
                new_rows, flat = by_size[size]
                new = np.array(flat, np.int32).reshape(-1, size)
                new_rank = self.lookup(new[:, :-1].ravel(), new[:, 1:].ravel())[0].reshape(len(new), size - 1)
                joined = len(rows) > 0
                rows = np.concatenate((rows, new_rows)) if joined else np.array(new_rows)
                symbols = np.concatenate((symbols, new)) if joined else new
                rank = np.concatenate((rank, new_rank)) if joined else new_rank
            if not len(rows):
                continue
            if size == 1:
                out[rows] = cost[symbols[:, 0]]
                break
            at = rank.argmin(axis=1)  # the leftmost pair of lowest rank
            done = rank[np.arange(len(rows)), at] == NONE
            out[rows[done]] = cost[symbols[done]].sum(axis=1)
            rows, symbols, rank, at = rows[~done], symbols[~done], rank[~done], at[~done]
            if not len(rows):
                continue
            n, r = len(rows), np.arange(len(rows))
            _, to = self.lookup(symbols[r, at], symbols[r, at + 1])
            symbols[r, at] = to
            keep = np.ones(symbols.shape, bool)
            keep[r, at + 1] = False
            symbols = symbols[keep].reshape(n, size - 1)
            keep = keep[:, 1:] if size > 1 else keep
            rank = rank[keep].reshape(n, size - 2)
            if size > 2:
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 2)
                p = at[left]
                rank[left, p - 1], _ = self.lookup(symbols[left, p - 1], symbols[left, p])
                p = at[right]
                rank[right, p], _ = self.lookup(symbols[right, p], symbols[right, p + 1])
        return out


class Counter:
    def __init__(self, path):
        self.pieces, self.cache = Pieces(path), {}

    def tokens(self, texts):
        """Token count of every text."""
        # A text gets a space in front; the library writes a space as this sign, and reads it as one.
        cut = [_PRETOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        new = {p for tokens in cut for p in tokens if p not in cache}
        new = list(new)
        for k in range(0, len(new), BATCH):
            part = new[k:k + BATCH]
            cache.update(zip(part, self.pieces.count(part).tolist()))
        out = [sum(map(cache.__getitem__, tokens)) for tokens in cut]
        if len(cache) > CACHE:
            cache.clear()
        return out


def counts(path, limit):
    """Batches of (doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit)."""

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            texts, sizes, totals, group, size = batch.column("text"), [], [], [], 0
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                group.append(text)
                size += len(text)
                sizes.append(len(text.encode()))
                if size >= 1 << 20:
                    totals += counter.tokens(group)
                    group, size = [], 0
            totals += counter.tokens(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array([n > limit for n in totals], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


ship(sys.modules[__name__])
