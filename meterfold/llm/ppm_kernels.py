"""Byte context trees: counting, frozen code lengths, and scoring of whole texts in numpy."""

import re
import sys

import numpy as np
import pyarrow as pa

from meterfold.llm.common import ship

ORDER = 3
CHUNK = 1 << 20
MERGE = 1 << 22
_DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))
_START = b"\n" * ORDER
_LETTER = re.compile(r"[^\W\d_]")


def folded(text):
    """Lower case, any digit as 0, in bytes."""
    return text.lower().encode().translate(_DIGITS)


def grams(data):
    """Every byte with the ORDER bytes before it, as one number; ``data`` starts with a start context."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def _merged(codes, counts):
    codes, at = np.unique(np.concatenate(codes), return_inverse=True)
    return codes, np.bincount(at, np.concatenate(counts), len(codes)).astype(np.int64)


def count(batches):
    """Batches of (text, lang) to (lang, code, n): how often each byte follows each context."""
    held = {}
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang").to_pylist()
        waiting = {}
        for k, lang in enumerate(langs):
            waiting.setdefault(lang, []).append(_START + folded(texts[k].as_py()))
        for lang, docs in waiting.items():
            codes, counts = held.setdefault(lang, ([], []))
            group, size = [], 0
            for k, doc in enumerate(docs):
                group.append(doc)
                size += len(doc)
                if size >= CHUNK or k == len(docs) - 1:
                    # A context never reaches back into the document before: such codes are left out.
                    ends = np.cumsum([len(d) for d in group])[:-1]
                    all_ = grams(b"".join(group))
                    crossing = (ends[:, None] - ORDER + np.arange(ORDER)[None, :]).ravel()
                    found = np.unique(np.delete(all_, crossing), return_counts=True)
                    codes.append(found[0])
                    counts.append(found[1])
                    group, size = [], 0
            if sum(map(len, codes)) > MERGE:
                held[lang] = tuple([x] for x in _merged(codes, counts))
    for lang, (codes, counts) in held.items():
        codes, counts = _merged(codes, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)],
            names=["lang", "code", "n"])


class Level:
    """Codes of one order with a row of bits per language each, behind a hash table."""

    def __init__(self, codes, rows):
        self.codes, self.rows = codes.astype(np.uint32), rows
        bits = max(10, int(len(codes) * 8).bit_length())
        self.shift = np.uint32(32 - min(bits, 24))
        self.table = np.full(1 << min(bits, 24), -1, np.int32)
        self.table[self._slot(self.codes)] = np.arange(len(codes), dtype=np.int32)

    def _slot(self, codes):
        return (codes * np.uint32(2654435769)) >> self.shift

    def find(self, codes):
        """Row of every code, -1 where there is none."""
        at = self.table[self._slot(codes)]
        wrong = np.flatnonzero((at < 0) | (self.codes[at] != codes)) if len(self.codes) else np.arange(len(codes))
        if len(wrong):
            if not len(self.codes):
                return np.full(len(codes), -1, np.int32)
            # Another code may have the slot: look among all of them.
            place = np.minimum(np.searchsorted(self.codes, codes[wrong]), len(self.codes) - 1)
            at[wrong] = np.where(self.codes[place] == codes[wrong], place, -1)
        return at


class Model:
    """Frozen trees of all languages: code length of a byte after its context, in bits.

    In a language's tree a byte seen after a context costs -log2(n / (N + t)), where the context was
    seen N times with t different bytes. A byte not seen there costs the escape -log2(t / (N + t)) and
    is coded after the context without its first byte; a context not seen costs nothing. Below the
    empty context all 256 bytes are equally likely.
    """

    def __init__(self, langs, lang, code, n):
        """lang: index into ``langs`` per row; code: four bytes; n: count."""
        self.langs, width = langs, len(langs)
        self.symbols, self.escapes = [], []
        below = np.full((256, width), 8.0)
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            key = (lang.astype(np.uint64) << np.uint64(32)) | (code.astype(np.uint64) & mask)
            seen, at = np.unique(key, return_inverse=True)
            total = np.bincount(at, n, len(seen))
            s_lang, s_code = (seen >> np.uint64(32)).astype(np.int64), seen & np.uint64(0xFFFFFFFF)
            ctx = (s_lang.astype(np.uint64) << np.uint64(32)) | (s_code >> np.uint64(8))
            ctxs, which = np.unique(ctx, return_inverse=True)
            kinds, size = np.bincount(which, minlength=len(ctxs)), np.bincount(which, total, len(ctxs))
            escape = -np.log2(kinds / (size + kinds)) if len(ctxs) else np.array([])
            # Escape cost of every context any language has.
            c_codes, c_at = np.unique(ctxs & np.uint64(0xFFFFFFFF), return_inverse=True)
            c_rows = np.zeros((len(c_codes), width))
            c_rows[c_at, (ctxs >> np.uint64(32)).astype(np.int64)] = escape
            self.escapes.append(Level(c_codes, c_rows))
            # Cost of every byte in every context any language has seen it in.
            u_codes, u_at = np.unique(s_code, return_inverse=True)
            u_codes32 = u_codes.astype(np.uint32)
            rows = self._escaped(u_codes32, order, below)
            rows[u_at, s_lang] = -np.log2(total / (size[which] + kinds[which]))
            self.symbols.append(Level(u_codes32, rows))

    def _escaped(self, codes, order, uniform=None):
        """Cost of codes that must leave the context of ``order``."""
        ctx = self.escapes[order].find(codes >> np.uint32(8))
        extra = np.where((ctx >= 0)[:, None], self.escapes[order].rows[ctx], 0.0) if len(
            self.escapes[order].rows) else np.zeros((len(codes), len(self.langs)))
        if order == 0:
            return extra + 8.0
        return extra + self._costs(codes & np.uint32((1 << 8 * order) - 1), order - 1)

    def _costs(self, codes, order):
        level = self.symbols[order]
        at = level.find(codes)
        rows = level.rows[at] if len(level.rows) else np.zeros((len(codes), len(self.langs)))
        lost = np.flatnonzero(at < 0)
        if len(lost):
            rows[lost] = self._escaped(codes[lost], order)
        return rows

    def lengths(self, data):
        """Code length of a folded text in every language, in bits."""
        total = np.zeros(len(self.langs))
        data = _START + data
        for k in range(0, len(data) - ORDER, CHUNK):
            total += self._costs(grams(data[k:k + CHUNK + ORDER]), ORDER).sum(axis=0)
        return total

    def many(self, texts):
        """Code lengths of several short texts at once."""
        joined = _START + _START.join(texts) if texts else b""
        costs = self._costs(grams(joined), ORDER)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(np.concatenate(([0], sizes[:-1] + ORDER)))
        # Start contexts between texts are coded too; their rows are left out of the sums.
        ends = starts + sizes
        sums = np.concatenate((np.zeros((1, costs.shape[1])), np.cumsum(costs, axis=0)))
        return sums[ends] - sums[starts]


def maker(langs, lang, code, n):
    """A function that builds the model; it lives here, so that tasks load it without the library."""
    return lambda: Model(langs, lang, code, n)


def predict(make, unknown):
    """Batches of (doc_id, text) to (doc_id, lang_pred, score, bits_per_byte, bits)."""

    def run(batches):
        model = make()
        for batch in batches:
            preds, scores, rates = [unknown] * batch.num_rows, [0.0] * batch.num_rows, [None] * batch.num_rows
            lengths = [None] * batch.num_rows
            texts, rows, group, size = batch.column("text"), [], [], 0

            def settle():
                if not rows:
                    return
                bits = model.many(group) if len(group) > 1 or len(group[0]) < CHUNK else model.lengths(
                    group[0])[None, :]
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(rows)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                for i, k in enumerate(rows):
                    preds[k], scores[k] = model.langs[best[i]], float(share[i])
                    rates[k], lengths[k] = float(least[i] / len(group[i])), float(least[i])

            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if text is None or not model.langs or not _LETTER.search(text):
                    continue
                data = folded(text)
                if rows and size + len(data) > CHUNK:
                    settle()
                    rows, group, size = [], [], 0
                rows.append(k)
                group.append(data)
                size += len(data) + ORDER
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rates, pa.float64()), pa.array(lengths, pa.float64())],
                names=["doc_id", "lang_pred", "score", "bits_per_byte", "bits"])

    return run


ship(sys.modules[__name__])
