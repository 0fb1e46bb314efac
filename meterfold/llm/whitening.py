"""Embedding whitening by mixed-precision refinement of the covariance's eigenvectors.

1. One pass counts the vectors and sums every component, one row per component and task.
2. A second pass multiplies the vectors less the (rounded) mean; one matrix per task, added by Spark. On
   a lattice of integers all sums are exact up to 2**53, and what rounding the mean left is taken off at the end.
3. The matrix, whose size is that of a vector squared whatever the number of vectors, is decomposed on the
   driver: float32 eigenvectors, corrected by Ogita-Aishima iterations (matrix products only) in float64 and then
   in extended precision; eigenvalues too close to be told apart are solved in a small problem of their own.
4. A map projects every vector.

All passes are maps with sums per task, so no key can skew them, and what is sent to the driver does not
grow with the rows.

Defined cases: vectors that are null or hold a null or non-finite component take no part and are not
returned; shorter vectors (also empty ones) are filled with zeros; repeated rows and rows without a key
count like any other; further columns are ignored; an empty table gives an empty one. A component without
variance (fewer vectors than components) has null whitened values. ``deviation`` is a decimal of 38 digits;
``whitening_report`` gives it as a long, null beyond that range.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from meterfold.llm import whitening_kernels as kernels
from meterfold.llm.common import written

COMPONENTS = 8
# floor(1024 * c) + 100000
LATTICE = (1024, 100_000)


@dataclass(frozen=True)
class Moments:
    """Number, sums and covariance (divisor n) of vectors; ``middle`` is their rounded mean."""

    n: int
    sums: list
    middle: np.ndarray
    covariance: np.ndarray


@dataclass(frozen=True)
class Whitening:
    """``axes`` maps a vector less ``middle`` less ``rest`` to its whitened components."""

    n: int
    sums: list
    middle: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    live: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def usable(vectors: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return vectors.where(x.isNotNull() & F.forall(
        x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))))


def moments(vectors: DataFrame, column: str, lattice: tuple[int, int] | None = None) -> Moments:
    """Two passes over the vectors of a column."""
    only = usable(vectors, column).select(column)
    kind = "long" if lattice else "double"
    places = only.mapInArrow(kernels.totals(lattice), f"place int, n long, total {kind}").groupBy("place").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("place").collect()
    n = places[0].n if places else 0
    absent = lattice[1] if lattice else 0
    sums = [r.total + (n - r.n) * absent for r in places[1:]]
    mean = [s // n if lattice else s / n for s in sums]
    middle = np.array(mean, np.int64 if lattice else np.float64)
    parts = only.mapInArrow(kernels.products(middle, lattice), "row int, products array<double>")
    rows = parts.select("row", F.posexplode("products")).groupBy("row", "pos").agg(F.sum("col").alias("total"))
    gram = np.zeros((len(sums), len(sums)), np.longdouble)
    for r in rows.collect():  # width squared, whatever the number of vectors
        gram[r.row, r.pos] = r.total
    if n:
        rest = np.array([np.longdouble(s - n * m) for s, m in zip(sums, middle.tolist())], np.longdouble) / n
        gram = gram / n - np.outer(rest, rest)
    return Moments(n, sums, middle, gram)


def fit(found: Moments, components: int = COMPONENTS) -> Whitening:
    """The whitening of the components with the largest eigenvalues."""
    values, vectors = kernels.eigen(found.covariance)
    trace = float(np.trace(found.covariance))
    top, axes = values[:components], vectors[:, :components]
    live = top > len(values) * np.finfo(np.float64).eps * (values[0] if len(values) else 0)
    scaled = axes / np.sqrt(np.where(live, top, 1))
    rest = np.array([np.longdouble(s - found.n * m) / max(found.n, 1)
                     for s, m in zip(found.sums, found.middle.tolist())], np.float64)
    return Whitening(found.n, found.sums, found.middle, rest, scaled, live, top, top / trace if trace else top * 0)


def whiten(vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding",
           lattice: tuple[int, int] | None = None) -> DataFrame:
    """key, whitened (one value per component), deviation: sum of (n * x - S)**2 over the components."""
    kind = vectors.schema[key].dataType.simpleString()
    return usable(vectors, column).select(key, column).mapInArrow(
        kernels.whiten(model, lattice, key), f"{key} {kind}, whitened array<double>, deviation decimal(38,0)")


def whitening_report(embeddings: DataFrame, components: int = COMPONENTS,
                     lattice: tuple[int, int] = LATTICE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, one row per vector and component."""
    model = fit(moments(embeddings, "embedding", lattice), components)
    rows = written(whiten(embeddings, model, lattice=lattice))
    # The whitened rows themselves are measured.
    live = rows.select(F.filter("whitened", lambda w: w.isNotNull()).alias("whitened"))
    covariance = moments(live, "whitened").covariance
    error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return rows.select(
        "vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"),
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
