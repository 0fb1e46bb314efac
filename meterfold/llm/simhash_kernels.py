"""Per-partition numpy work of SimHash near-dedup."""

import sys

import numpy as np
import pyarrow as pa
import xxhash

from meterfold.llm.common import ship

SEED = 42
CHUNK = 1 << 18
ROWS = 512  # rows of a tile compared at once: bounds the matrix of differences
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, width):
    """SimHash of a text as an unsigned 64-bit integer; 0 without words."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    ends = ends[width - 1:]
    n, ones = len(ends), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(
            starts[k:k + CHUNK].tolist(), ends[k:k + CHUNK].tolist())], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in range(64) if 2 * ones[j] > n)


def fingerprints(width):
    """Batches of (doc_id, text) to (doc_id, fp)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def roots(u, v, n):
    """Smallest node of each node's component, for edges between 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def tile_links(left, right, same, radius):
    """Linked pairs between two tiles as (u, v) arrays; at most a spanning star per component."""
    found_u, found_v = [], []
    for k in range(0, len(left), ROWS):
        near = np.bitwise_count(left[k:k + ROWS, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        i = i + k
        if same:
            i, j = i[i < j], j[i < j]
        found_u.append(i)
        found_v.append(j)
    u, v = np.concatenate(found_u), np.concatenate(found_v)
    if len(u) <= len(left) + len(right):
        return left[u], right[v]
    nodes, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    root = roots(at[:len(left)][u], at[len(left):][v], len(nodes))
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def links(radius):
    """Batches of tile pairs (own, visitor, same) to links (u, v) between fingerprints."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            own, visitor = batch.column("own"), batch.column("visitor")
            same = batch.column("same").to_pylist()
            for k in range(batch.num_rows):
                a = own[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = visitor[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                u, v = tile_links(a, b, same[k], radius)
                if len(u):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return run


ship(sys.modules[__name__])
