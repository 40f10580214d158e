"""The leading eigenpair of a Hermitian matrix by a restarted Krylov (Lanczos) projection.

A cycle starts from a vector v and its residual r = h v - theta v, and spans v, r, h r, h^2 r, ...
in the basis of Chebyshev polynomials over the spectrum seen so far, which stays well conditioned.
The basis is a table: one row per frame with the frame's entry of every vector. A product with h is
one join and one sum, several of them in one job. The inner products of all vectors, a small
matrix, go to the driver, which orthogonalises the whole basis at once and solves the projected
problem; the best vector starts the next cycle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from phasemill.functions import cplx

#: Products with the matrix in a cycle, and in one job.
DEGREE, CHAIN = 24, 8
#: Directions of the basis with less than this share of the largest one's weight are left out.
RANK = 1e-13


class Pair(NamedTuple):
    """vector (fid, re, im) of unit norm, its value, |h v - value v|, the products with h that it took, and the written table that holds the vector."""

    vector: DataFrame
    value: float
    residual: float
    products: int
    source: DataFrame


def with_own(h: DataFrame, frames: DataFrame) -> DataFrame:
    """(i, j, re, im, own): the entries of h and one row for each frame on its own, which carries its vectors along."""
    fid = F.col("fid")
    own = frames.select(fid.alias("i"), fid.alias("j"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), F.lit(True).alias("own"))
    return h.select("i", "j", "re", "im", F.lit(False).alias("own")).unionByName(own)


def times(h: DataFrame, basis: DataFrame) -> DataFrame:
    """basis (fid, re, im; arrays) with h times its last vector as w_re, w_im; h as from with_own. Reads basis once."""
    state = basis.selectExpr("fid AS j", "re AS b_re", "im AS b_im", "element_at(re, -1) AS v_re", "element_at(im, -1) AS v_im")
    sums = ("sum(re * v_re - im * v_im) AS w_re", "sum(re * v_im + im * v_re) AS w_im", "first(if(own, b_re, null), true) AS re", "first(if(own, b_im, null), true) AS im")
    return state.join(h, "j").groupBy(F.col("i").alias("fid")).agg(*map(F.expr, sums))


def stretched(h: DataFrame, low: float, high: float) -> DataFrame:
    """2 (h - centre) / half of the interval, with the shift in the frames' own rows: what a Chebyshev step multiplies with."""
    centre, half = (high + low) / 2, (high - low) / 2
    return h.select("i", "j", F.when(F.col("own"), -2 * centre / half).otherwise(F.col("re") * (2 / half)).alias("re"), (F.col("im") * (2 / half)).alias("im"), "own")


def chain(h: DataFrame, basis: DataFrame, first: bool, count: int) -> DataFrame:
    """basis with `count` more Chebyshev vectors by a stretched h; first: the last of it is that of degree 0."""
    for k in range(count):
        new = "concat({0}, array(w_{0} / 2)) AS {0}" if first and k == 0 else "concat({0}, array(w_{0} - element_at({0}, -2))) AS {0}"
        basis = times(h, basis).selectExpr("fid", *(new.format(c) for c in ("re", "im")))
    return basis


def inner_products(basis: DataFrame) -> np.ndarray:
    """All inner products of a table of vectors (fid, re, im; arrays of one length): summed in tasks, then by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                a = _complex(batch, 0)
                total = a.conj().T @ a + (0 if total is None else total)
        if total is not None:
            flat = np.concatenate([total.real.ravel(), total.imag.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["g"])

    sums = basis.select("re", "im").mapInArrow(partial, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    flat = np.array([r["s"] for r in sums])
    n = int(round((len(flat) / 2) ** 0.5))
    return (flat[: n * n] + 1j * flat[n * n :]).reshape(n, n)


def _complex(batch: pa.RecordBatch, at: int) -> np.ndarray:
    re, im = (batch.column(at + k).flatten().to_numpy(zero_copy_only=False) for k in range(2))
    return (re + 1j * im).reshape(batch.num_rows, -1)


def combined(weights: np.ndarray) -> tuple[Column, Column]:
    """The sum of a row's vectors by complex weights, as (re, im)."""
    terms = [(k, float(w.real), float(w.imag)) for k, w in enumerate(weights) if w != 0]
    part = lambda c, k: F.get(F.col(c), F.lit(k))
    re = sum((part("re", k) * a - part("im", k) * b for k, a, b in terms), F.lit(0.0))
    im = sum((part("re", k) * b + part("im", k) * a for k, a, b in terms), F.lit(0.0))
    return re, im


def projected(gram: np.ndarray, low: float, high: float) -> tuple[float, np.ndarray, np.ndarray, float, float]:
    """Of the inner products of v, h v and the Chebyshev vectors: the value of largest modulus in their span, its vector's weights and those of h times it, and the smallest and largest values."""
    n = len(gram) - 3  # vectors whose product with h is in the span too, besides v
    centre, half = (high + low) / 2, (high - low) / 2
    b, hb = np.zeros((n + 3, n + 1)), np.zeros((n + 3, n + 1))
    b[0, 0] = hb[1, 0] = 1
    for k in range(n):
        b[2 + k, 1 + k] = 1
        hb[2 + k, 1 + k] = centre
        hb[3 + k, 1 + k] += half if k == 0 else half / 2
        if k:
            hb[1 + k, 1 + k] += half / 2
    g, t = b.T @ gram @ b, b.T @ gram @ hb
    size = 1 / np.sqrt(np.maximum(g.diagonal().real, np.finfo(float).tiny))
    g, t = g * size[:, None] * size, (t + t.conj().T) / 2 * size[:, None] * size
    weight, axes = np.linalg.eigh(g)
    held = weight > RANK * weight.max()
    axes = axes[:, held] / np.sqrt(weight[held])
    values, vectors = np.linalg.eigh(axes.conj().T @ t @ axes)
    best = int(np.argmax(np.abs(values)))
    y = size * (axes @ vectors[:, best])
    y = y / np.sqrt((y.conj() @ (b.T @ gram @ b) @ y).real)
    return float(values[best]), b @ y, hb @ y, float(values[0]), float(values[-1])


def leading_pair(h: DataFrame, start: DataFrame, keep: Callable[[DataFrame], DataFrame], tol: float = 1e-9, cycles: int = 100, degree: int = DEGREE, per_job: int = CHAIN) -> Pair:
    """The eigenpair of largest modulus of a Hermitian h (i, j, re, im; both triangles), from a start vector (fid, re, im).

    Ends at a residual of tol, or after so many cycles. start has a row for every frame; one without
    an entry in h has a zero row there. keep writes a table and reads it again. A zero start, and no
    frames, give value 0 and the start as it is.
    """
    seen, at = Observation(), lambda c, k: F.get(F.col(c), F.lit(k))
    first = times(with_own(h, start), start.select("fid", *(F.array(c).alias(c) for c in ("re", "im"))))
    source = first.select("fid", *(F.concat(c, F.array(F.col(f"w_{c}"))).alias(c) for c in ("re", "im")))  # v and h v
    source = keep(source.observe(seen, F.sum(at("re", 0) ** 2 + at("im", 0) ** 2).alias("total"), F.sum(at("re", 0) * at("re", 1) + at("im", 0) * at("im", 1)).alias("dot")))
    total = seen.get["total"] or 0.0
    if not total:
        return Pair(start.select("fid", "re", "im"), 0.0, 0.0, 0, start)
    value, done = seen.get["dot"] / total, 1
    state = source.select("fid", *(F.array(*(at(c, k) / total**0.5 for k in range(2))).alias(c) for c in ("re", "im")))
    for cycle in range(cycles + 1):
        off = [at(c, 1) - value * at(c, 0) for c in ("re", "im")]
        square = F.sum(off[0] * off[0] + off[1] * off[1]).alias("off")
        if cycle == 0:
            residual = (state.agg(square).first()["off"] or 0.0) ** 0.5
        else:
            seen = Observation()
            state = source = keep(state.observe(seen, square))
            residual = (seen.get["off"] or 0.0) ** 0.5
        if residual <= tol or cycle == cycles:
            break
        if cycle == 0:  # a start that is an eigenvector needs none of this
            h = keep(with_own(h, start))
            reach = h.groupBy("i").agg(F.sum(F.sqrt(cplx.abs2(cplx.pair()))).alias("r")).agg(F.max("r")).first()[0] or 1.0
            low, high = -reach, reach
        count = min(degree, 8) if cycle == 0 else degree  # the spectrum is known only roughly at first
        basis = state.select("fid", *(F.concat(c, F.array(o / residual)).alias(c) for c, o in zip(("re", "im"), off, strict=True)))
        scaled = stretched(h, low, high)
        for k in range(0, count, per_job):
            basis = keep(chain(scaled, basis, k == 0, min(per_job, count - k)))
        done += count
        value, v, hv, smallest, largest = projected(inner_products(basis), low, high)
        pairs = [combined(v), combined(hv)]
        state = basis.select("fid", F.array(*(p[0] for p in pairs)).alias("re"), F.array(*(p[1] for p in pairs)).alias("im"))
        margin = 0.05 * (largest - smallest) + 1e-12 * reach
        low, high = smallest - margin, largest + margin
    vector = state.select("fid", at("re", 0).alias("re"), at("im", 0).alias("im"))
    return Pair(vector, value, residual, done, source)
