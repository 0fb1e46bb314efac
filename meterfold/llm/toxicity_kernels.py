"""Folding, word counting and Aho-Corasick scoring of texts."""

import math
import re
import sys
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash

from meterfold.llm.common import ship

# Letters that look like Latin ones, and digits written for letters. The letters
# i and l and the digit 1 look alike and fold to one sign, in the lexicon as in the texts.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "ɡ": "g", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ⅼ": "i", "l": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
HIDDEN = {c: None for c in "­​‌‍⁠﻿"}
_TABLE = str.maketrans({**HOMOGLYPHS, **DIGITS, **HIDDEN})
HELD = 1 << 20
_GAP = re.compile(r"[\W_]+")


def folded(text):
    """Words of a text in folded form, one space before, between and after them."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return " " + _GAP.sub(" ", text.lower().translate(_TABLE)).strip() + " "


def word_counts(batches):
    """Batches of (text, toxic) to (word, pair, clean, toxic), to be summed by word and pair.

    Rows without a pair count documents; the others name a pair of neighbours that the word has in a
    toxic document, by its hash. What a task holds is sent on when it has ``HELD`` entries.
    """
    seen, pairs = {}, set()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = folded(text or "").split()
            for word in set(words):
                seen.setdefault(word, [0, 0])[1 if toxic else 0] += 1
            if toxic:
                for a, word, b in zip(["", *words], words, [*words[1:], ""]):
                    pairs.add((word, f"{a} {b}"))
            if len(seen) + len(pairs) >= HELD:
                yield _counted(seen, pairs)
                seen, pairs = {}, set()
    yield _counted(seen, pairs)


def _counted(seen, pairs):
    hashes = [xxhash.xxh64_intdigest(p) - (1 << 63) for _, p in pairs]
    none = [0] * len(pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array([*seen, *(w for w, _ in pairs)], pa.string()),
         pa.array([None] * len(seen) + hashes, pa.int64()),
         pa.array([x[0] for x in seen.values()] + none, pa.int64()),
         pa.array([x[1] for x in seen.values()] + none, pa.int64())],
        names=["word", "pair", "clean", "toxic"])


def phrase_counts(words):
    """Batches of (text, toxic) to (phrase, toxic): two-word phrases around lexicon words, per document."""
    lexicon = set(words)

    def run(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = folded(text or "").split()
                out += [(p, toxic) for p in {f"{a} {b}" for a, b in zip(found, found[1:])
                                             if a in lexicon or b in lexicon}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())],
                names=["phrase", "toxic"])

    return run


class Lexicon:
    """Aho-Corasick automaton over weighted words and exception phrases."""

    def __init__(self, weights, exceptions):
        self.automaton = ahocorasick.Automaton()
        for word, weight in weights.items():
            self.automaton.add_word(f" {word} ", (len(word), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase), None))
        self.empty = not weights
        if not self.empty:
            self.automaton.make_automaton()

    def measure(self, text):
        """(sum of weights, normalised sum) of a text."""
        if not text or self.empty:
            return 0.0, 0.0
        line = folded(text)
        hits, excused = [], []
        for end, (size, weight) in self.automaton.iter(line):
            (excused if weight is None else hits).append((end - size, end, weight))
        if not hits:
            return 0.0, 0.0
        if excused:
            reach, at, best, kept = excused, 0, -1, []
            reach.sort()
            for start, end, weight in sorted(hits):
                while at < len(reach) and reach[at][0] <= start:
                    best, at = max(best, reach[at][1]), at + 1
                if best < end:
                    kept.append((start, end, weight))
            hits = kept
        total = math.fsum(h[2] for h in hits)
        return total, math.log1p(total / math.log(math.e + line.count(" ") - 1))


def measured(weights, exceptions):
    """Batches of (text, toxic) to (x, toxic)."""

    def run(batches):
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            x = [lexicon.measure(t)[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("toxic")],
                                             names=["x", "toxic"])

    return run


def fit(x, y, weight, rounds=50, ridge=1e-3):
    """Logistic regression of y on x: (intercept, slope)."""
    a = np.zeros(2)
    design = np.stack((np.ones(len(x)), x), axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * a
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        a += np.clip(np.linalg.solve(curve, gradient), -4, 4)
    return a


def scores(weights, exceptions, intercept, slope):
    """Batches of (doc_id, text) to (doc_id, score, weight_sum)."""

    def run(batches):
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            pairs = [lexicon.measure(t.as_py()) for t in batch.column("text")]
            z = np.clip(intercept + slope * np.array([p[1] for p in pairs], np.float64), -30, 30)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z))),
                 pa.array([p[0] for p in pairs], pa.float64())], names=["doc_id", "score", "weight_sum"])

    return run


ship(sys.modules[__name__])
