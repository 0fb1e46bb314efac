"""Pivot tables and bound-ordered evaluation of vector blocks."""

import sys

import numpy as np
import pyarrow as pa

from meterfold.llm.common import ship

STEP = 256  # candidates evaluated between two looks at the stopping rule
EXACT = float(1 << 53)


def distances(vectors, pivots):
    """Euclidean distances between two sets of rows."""
    a, b = (vectors * vectors).sum(1), (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(0.0, a[:, None] + b[None, :] - 2 * vectors @ pivots.T))


def choose_pivots(vectors, count):
    """Farthest-first choice among sample rows."""
    chosen, gap = [], np.full(len(vectors), np.inf)
    for _ in range(min(count, len(vectors))):
        k = int(np.argmax(gap)) if chosen else 0
        if chosen and gap[k] <= 0:
            break
        chosen.append(k)
        gap = np.minimum(gap, distances(vectors, vectors[k:k + 1])[:, 0])
    return vectors[chosen]


def pack(pivots, width):
    """A group of rows (block, vec_id, copies, key, v) to one row of arrays with its pivot table."""

    def run(table):
        n = table.num_rows
        lists = table.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        vectors = np.zeros((n, width), np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py():lists.offsets[-1].as_py()]
        vectors[np.arange(width)[None, :] < sizes[:, None]] = flat
        near = distances(vectors.astype(np.float64), pivots)
        cell = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        number = lambda c: table.column(c).to_numpy().astype(np.int64)
        return pa.Table.from_arrays(
            [table.column("block").combine_chunks()[:1], cell(number("vec_id")), cell(number("copies")),
             cell(number("key")), cell(vectors), cell(near.astype(np.float32))],
            names=["block", "ids", "copies", "keys", "vectors", "near"])

    return run


def _best(score, ids, k):
    """Places of the k best: highest score, then smallest id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


def nearest(query, q_norm, q_near, mine, x, k):
    """(scores, ids) of the k best candidates of a block for one query."""
    lower = np.zeros(len(x["ids"]), np.float32)
    for p in range(x["near"].shape[0]):
        np.maximum(lower, np.abs(x["near"][p] - q_near[p]), out=lower)
    # A distance of at least ``lower`` bounds the product: 2<q,x> = |q|^2 + |x|^2 - |q - x|^2.
    slack = np.float32(2e-6) * (x["reach"] + np.abs(q_near).max(initial=0))
    lower = np.maximum(lower - slack, 0).astype(np.float64)
    upper = (q_norm + x["norm"] - lower * lower) * (0.5 + 1e-9) + 1e-6
    upper[mine] = -np.inf
    order = np.argsort(-upper, kind="stable")
    order = order[:len(order) - len(mine)]
    score, ids, at = np.zeros(0), np.zeros(0, np.int64), 0
    while at < len(order):
        if len(score) == k and upper[order[at]] < score[-1]:
            break
        some = order[at:at + STEP]
        score = np.concatenate((score, x["vectors"][some] @ query))
        ids = np.concatenate((ids, x["ids"][some]))
        best = _best(score, ids, k)
        score, ids, at = score[best], ids[best], at + STEP
    return score, ids


def _wide(vectors):
    """Exact arithmetic for the data at hand: float64 if no product can lose a bit, else Python's."""
    most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
    return vectors.astype(np.float64) if most * most * max(vectors.shape[1], 1) < EXACT / 4 else vectors.astype(object)


def search(k, width, n_pivots):
    """Batches of (query block, candidate block) pairs to (query_id, query_key, copies, vec_id, score)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[row].as_py(), t)
                vectors = _wide(get("vectors", np.int64).reshape(-1, width))
                queries = _wide(get("q_vectors", np.int64).reshape(-1, width))
                ids, keys, copies = get("ids", np.int64), get("keys", np.int64), get("copies", np.int64)
                near = get("near", np.float32).reshape(-1, n_pivots)
                x = {"ids": ids, "vectors": vectors, "near": np.ascontiguousarray(near.T),
                     "norm": (vectors * vectors).sum(1).astype(np.float64),
                     "reach": near.max(initial=0)}
                q_near = get("q_near", np.float32).reshape(-1, n_pivots)
                q_ids, q_keys, q_copies = (get(c, np.int64) for c in ("q_ids", "q_keys", "q_copies"))
                own = {}
                for place in np.flatnonzero(np.isin(ids, q_ids)):
                    own.setdefault((int(ids[place]), int(keys[place])), []).append(place)
                out = [[], [], [], [], []]
                for j in range(len(q_ids)):
                    # One copy of the query's own row takes no part; ``copies`` numbers equal rows.
                    mine = [p for p in own.get((int(q_ids[j]), int(q_keys[j])), ()) if copies[p] == 1]
                    q = queries[j]
                    score, found = nearest(q, float((q * q).sum()), q_near[j], np.array(mine, np.int64), x, k)
                    for column, value in zip(out, (q_ids[j], q_keys[j], q_copies[j])):
                        column.append(np.full(len(found), value))
                    out[3].append(found)
                    out[4].append(np.array([int(s) for s in score], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out],
                    names=["query_id", "query_key", "copies", "vec_id", "score"])

    return run


ship(sys.modules[__name__])
