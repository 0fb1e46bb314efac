"""Moments of vectors, refined eigenvectors and whitening in numpy."""

import decimal
import sys

import numpy as np
import pyarrow as pa

from meterfold.llm.common import ship

CHUNK = 4096  # rows multiplied at once
EXACT = 2.0**53


def _matrix(column, width, lattice):
    """Vectors as rows of at least ``width`` components, missing ones as zero, and their lengths.

    With ``lattice`` (scale, shift) a component c becomes the integer floor(scale * c) + shift.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = np.asarray(column.flatten(), np.float64)
    widest = max(width, int(lengths.max(initial=0)))
    if len(values) == len(lengths) * widest:
        rows = values.reshape(len(lengths), widest)
    else:
        rows = np.zeros((len(lengths), widest))
        rows[np.arange(widest) < lengths[:, None]] = values
    if lattice is not None:
        scale, shift = lattice
        rows = np.floor(rows * scale)
        if np.abs(rows).max(initial=0) >= 2.0**62:
            raise OverflowError("a component leaves the range of long")
        rows = rows.astype(np.int64) + shift
    return rows, lengths


def totals(lattice):
    """mapInArrow over one array column: (place, n, total) of a task; place -1 counts the vectors."""

    def run(batches):
        count, n, total = 0, np.zeros(0, np.int64), np.zeros(0, np.int64 if lattice else np.float64)
        for batch in batches:
            rows, lengths = _matrix(batch.column(0), len(n), lattice)
            grown = rows.shape[1] - len(n)
            n, total = np.pad(n, (0, grown)), np.pad(total, (0, grown))
            held = np.arange(rows.shape[1]) < lengths[:, None]
            n += held.sum(axis=0)
            total += np.where(held, rows, 0).sum(axis=0)
            count += len(lengths)
        if count:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(-1, len(n)), pa.int32()), pa.array(np.concatenate([[count], n]), pa.int64()),
                pa.array(np.concatenate([np.zeros(1, total.dtype), total]))], ["place", "n", "total"])

    return run


def products(middle, lattice):
    """mapInArrow over one array column: (row, products) of a task, for vectors less ``middle``.

    On a lattice all sums below 2**53 are exact.
    """
    middle = np.asarray(middle)

    def run(batches):
        gram = np.zeros((len(middle), len(middle)))
        seen = False
        for batch in batches:
            rows, _ = _matrix(batch.column(0), len(middle), lattice)
            seen = seen or len(rows) > 0
            for at in range(0, len(rows), CHUNK):
                part = (rows[at:at + CHUNK] - middle).astype(np.float64)
                gram += part.T @ part
        if seen:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(middle)), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))],
                ["row", "products"])

    return run


def _rounding(a):
    """What rounding may leave in a product with ``a``."""
    return 4 * len(a) * np.finfo(a.dtype).eps * np.sqrt((a**2).sum())


def _step(a, x):
    """One correction of approximate eigenvectors by matrix products (Ogita and Aishima).

    Returns the corrected vectors, their eigenvalues, the gap that can be told apart, and the size of the
    correction. Gaps of the size of rounding errors are never told apart.
    """
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    # Exactly symmetric: divided by a small gap, a rounding difference would cost orthogonality.
    s, r = (s + s.T) / 2, (r + r.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    gap = 2 * (np.sqrt((off**2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum())) + _rounding(a)
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    change = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ change, values, gap, np.abs(change).max()


def _solve_clusters(a, x, values, gap):
    """Turn the vectors of eigenvalues that lie closer than ``gap`` by a small eigenproblem of their own.

    The cluster's mean is taken off first, so the small problem sees the differences alone.
    """
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    for members in np.split(order, cuts):
        if len(members) > 1:
            part, mean = x[:, members], values[members].mean()
            inner = part.T @ (a @ part - mean * part)
            scale = np.abs(inner).max()
            if scale > _rounding(a):
                turn = np.linalg.eigh(((inner + inner.T) / (2 * scale)).astype(np.float64))[1]
                x[:, members] = part @ turn.astype(x.dtype)
    return x


def eigen(matrix, rounds=12):
    """(values, vectors) of a symmetric matrix, values falling, vectors as unit columns.

    Start: eigenvectors in float32. Corrections: matrix products in float64, then in extended
    precision, until they no longer change anything; clusters are solved apart after every step.
    """
    a = np.asarray(matrix, np.longdouble)
    scale = np.abs(a).max(initial=0)
    if not len(a) or scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        work, x = a.astype(kind), x.astype(kind)
        for _ in range(rounds):
            x, values, gap, change = _step(work, x)
            if change <= 8 * len(a) * np.finfo(kind).eps:
                break
            x = _solve_clusters(work, x, values, gap)
    x = x / np.sqrt((x**2).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def whiten(model, lattice, key):
    """mapInArrow over (key, vector): key, whitened, deviation (exact; null without a lattice)."""
    middle, rest, axes, live = model.middle, model.rest, model.axes, model.live
    n, sums = model.n, model.sums

    def deviations(rows):
        if lattice is None:
            return [None] * len(rows)
        span = int(np.abs(rows - middle).max(initial=0)) + 1
        if n * span < 2**62 and (n * span) ** 2 * len(middle) < 2**62:
            # n * x - S = n * (x - middle) - (S - n * middle), all in range of int64.
            apart = n * (rows - middle) - np.array([s - n * int(m) for s, m in zip(sums, middle)], np.int64)
            return [decimal.Decimal(d) for d in (apart * apart).sum(axis=1).tolist()]
        exact = np.array(sums, object)
        return [decimal.Decimal(int(((n * row.astype(object) - exact) ** 2).sum())) for row in rows]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rows, _ = _matrix(part.column(1), len(middle), lattice)
                white = ((rows - middle).astype(np.float64) - rest) @ axes
                white = pa.array(white.ravel(), pa.float64(), mask=np.tile(~live, len(rows)))
                ends = pa.array(np.arange(0, len(white) + 1, len(live)) if len(live) else np.zeros(len(rows) + 1, int), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.ListArray.from_arrays(ends, white),
                    pa.array(deviations(rows), pa.decimal128(38, 0))], [key, "whitened", "deviation"])

    return run


ship(sys.modules[__name__])
