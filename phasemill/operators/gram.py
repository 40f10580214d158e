"""Frame pairs, the Gram matrix of overlapping frames, and phase synchronisation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.functions import cplx
from phasemill.operators import agreement, dense, krylov, tiles
from phasemill.operators.tiles import Tiling


def wrapped(d: Column, width: int) -> Column:
    """A displacement of the shortest length on a circle, with its sign turned as the pairs need it."""
    half = width / 2
    return -(d + F.when(d < -half, width).when(d > half, -width).otherwise(0))


def pairs(scan: DataFrame, n: int, width: int, border: int = 0) -> DataFrame:
    """(i, j, dx, dy), i <= j: pairs of frames whose windows overlap, and where j's window begins seen from i's.

    Frames meet by cells of the lattice instead of all with all: each frame is dealt to its own cell
    and looked up from the cells around it, so the work grows with the overlaps.
    """
    reach = n - 2 * border
    cells = max(1, width // reach)
    size = width / cells  # cells of at least the reach, equal around the circle
    cell = lambda c: F.least(F.floor(F.pmod(F.col(c), F.lit(width)) / size).cast("long"), F.lit(cells - 1))
    left = scan.select(F.col("fid").alias("i"), F.col("tx").alias("ax"), F.col("ty").alias("ay"), cell("tx").alias("cx"), cell("ty").alias("cy"))
    steps = F.array(*(F.lit(s) for s in (-1, 0, 1)))
    near = left.withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps)).select("i", "ax", "ay", F.pmod(F.col("cx") + F.col("sx"), F.lit(cells)).alias("cx"), F.pmod(F.col("cy") + F.col("sy"), F.lit(cells)).alias("cy"))
    if cells < 3:  # neighbours on both sides are the same cell
        near = near.distinct()
    right = scan.select(F.col("fid").alias("j"), F.col("tx").alias("bx"), F.col("ty").alias("by"), cell("tx").alias("cx"), cell("ty").alias("cy"))
    met = near.join(right, ["cx", "cy"]).filter("i <= j")
    d = met.select("i", "j", wrapped(F.col("bx") - F.col("ax"), width).cast("long").alias("dx"), wrapped(F.col("by") - F.col("ay"), width).cast("long").alias("dy"))
    return d.filter((F.abs("dx") < reach) & (F.abs("dy") < reach))


def gram(left: DataFrame, right: DataFrame, of: DataFrame, n: int, border: int = 0) -> DataFrame:
    """(i, j, re, im), i <= j: sums of conj(left_i[p]) * right_j[p + d] over the overlap, less a border."""
    inside = lambda a, d: F.col(a).between(F.greatest(F.lit(0), -F.col(d)) + border, F.least(F.lit(n), n - F.col(d)) - border - 1)
    l_ = left.select(F.col("fid").alias("i"), "y", "x", F.col("re").alias("l_re"), F.col("im").alias("l_im"))
    r_ = right.select(F.col("fid").alias("j"), F.col("y").alias("ry"), F.col("x").alias("rx"), F.col("re").alias("r_re"), F.col("im").alias("r_im"))
    cells = of.join(l_, "i").filter(inside("y", "dy") & inside("x", "dx")).withColumns({"ry": F.col("y") + F.col("dy"), "rx": F.col("x") + F.col("dx")})
    re, im = cplx.conj_mul(cplx.pair("l_"), cplx.pair("r_"))
    return cells.join(r_, ["j", "ry", "rx"]).groupBy("i", "j").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def chunk_pairs(plan: DataFrame, tiling: Tiling) -> DataFrame:
    """(r, c, part, pair, other): each chunk's place in the pairs of chunks of one tile or of neighbours; other: it is the second of two."""
    here = plan.select("r", "c", "part").distinct()
    steps = F.array(*(F.lit(s) for s in (-1, 0, 1)))
    turn = lambda c, s: F.pmod(F.col(c) + F.col(s), F.lit(tiling.count)).alias(f"q{c}")
    near = here.withColumn("sr", F.explode(steps)).withColumn("sc", F.explode(steps)).select("r", "c", "part", turn("r", "sr"), turn("c", "sc")).distinct()
    there = here.select(F.col("r").alias("qr"), F.col("c").alias("qc"), F.col("part").alias("qpart"))
    first, second = F.struct("r", "c", "part"), F.struct(F.col("qr").alias("r"), F.col("qc").alias("c"), F.col("qpart").alias("part"))
    met = near.join(there, ["qr", "qc"]).select(first.alias("p"), second.alias("q")).filter("p <= q")
    sides = met.select("p", "q", F.explode(F.when(F.col("p") == F.col("q"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("other"))
    own, facing = F.when(F.col("other"), F.col("q")).otherwise(F.col("p")), F.when(F.col("other"), F.col("p")).otherwise(F.col("q"))
    return sides.select(own.alias("own"), F.struct("p", "q").alias("pair"), "other", facing["r"].alias("fr"), facing["c"].alias("fc")).select("own.*", "pair", "other", "fr", "fc")


def tiled_gram(frames: DataFrame, of: DataFrame, tiling: Tiling, border: int = 0, both: bool = False) -> DataFrame:
    """(i, j, re, im), i <= j: the rows of `gram`, from frames as arrays; with both, both triangles.

    frames: a plan's columns with l_re, l_im and r_re, r_im; of: chunk_pairs of the plan. A frame goes
    to the pairs of its chunk with those within reach, and one task sums all pairs of frames of a pair
    of chunks; pairs of one displacement are summed at once.
    """
    n, width, reach = tiling.n, tiling.width, tiling.n - 2 * border

    def near(t: str, own: str, facing: str) -> Column:
        """Whether frames of the facing tile may overlap this one, along an axis."""
        begin = F.floor(F.col(facing) * width / tiling.count)
        end = F.floor((F.col(facing) + 1) * width / tiling.count)
        return (F.col(own) == F.col(facing)) | (F.pmod(begin - F.col(t), F.lit(width)) < n) | (F.pmod(F.col(t) - end + 1, F.lit(width)) < n)

    dealt = frames.join(of, ["r", "c", "part"]).filter(near("ty", "r", "fr") & near("tx", "c", "fc")).select("pair", "other", "fid", "tx", "ty", "l_re", "l_im", "r_re", "r_im")

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("fid")
        fid, other, tx, ty = (rows.column(c).to_numpy() for c in ("fid", "other", "tx", "ty"))
        pair = rows.column("pair")[0].as_py()
        a = np.flatnonzero(~other)
        b = a if pair["p"] == pair["q"] else np.flatnonzero(other)
        # frames are in order of fid, so the first of two is the one with the smaller place
        low, high = np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])
        dx, dy = (turned(t[high] - t[low], width) for t in (tx, ty))
        met = (np.abs(dx) < reach) & (np.abs(dy) < reach)
        if a is b:
            met &= a[:, None] <= b[None, :]
        i, j, dx, dy = low[met], high[met], dx[met], dy[met]
        left = dense.stack(rows.column("l_re"), n) - 1j * dense.stack(rows.column("l_im"), n)
        right = dense.stack(rows.column("r_re"), n) + 1j * dense.stack(rows.column("r_im"), n)
        out = np.zeros(len(i), dtype=np.complex128)
        order = np.lexsort((dx, dy))
        cuts = np.flatnonzero(np.r_[True, np.diff(dx[order]) != 0] | np.r_[True, np.diff(dy[order]) != 0]) if len(order) else []
        for some in np.split(order, cuts[1:]) if len(order) else []:
            x, y = int(dx[some[0]]), int(dy[some[0]])
            ys, xs = (slice(max(0, -d) + border, min(n, n - d) - border) for d in (y, x))
            to = slice(ys.start + y, ys.stop + y), slice(xs.start + x, xs.stop + x)
            for part in np.array_split(some, max(1, len(some) * n * n // 2_000_000)):
                out[part] = np.einsum("kyx,kyx->k", left[i[part], ys, xs], right[j[part], to[0], to[1]])
        i, j = fid[i], fid[j]
        if both:
            off = i < j
            i, j, out = np.r_[i, j[off]], np.r_[j, i[off]], np.r_[out, out[off].conj()]
        return pa.table({"i": i, "j": j, "re": out.real, "im": out.imag})

    return dealt.groupBy("pair").applyInArrow(work, "i long, j long, re double, im double")


def turned(d: np.ndarray, width: int) -> np.ndarray:
    """wrapped, of numbers."""
    return -(d + width * ((d < -width / 2).astype(np.int64) - (d > width / 2)))


def both_sides(rows: DataFrame) -> DataFrame:
    """Frames of a plan (re, im) as left and right ones alike."""
    return rows.select("fid", "tx", "ty", "r", "c", "part", *(F.col(k).alias(f"{s}_{k}") for s in "lr" for k in ("re", "im")))


def lit_sides(rows: DataFrame, norm: DataFrame, of: DataFrame, tiling: Tiling, probe: np.ndarray, scale_border: int | None = None) -> DataFrame:
    """Left frames conj(probe) * frame and right ones the same over the normalization (tiles of n); of: tiles.chunks of the plan.

    With a scale_border both are over the norm of the frame less that border, and zero where it is zero.
    """

    def work(rows: pa.Table, at: tiles.Place, n: np.ndarray) -> pa.Table:
        f = dense.stack(rows.column("re"), tiling.n) + 1j * dense.stack(rows.column("im"), tiling.n)
        if scale_border is not None:
            inside = slice(scale_border, tiling.n - scale_border)
            size = np.sqrt((np.abs(f[:, inside, inside]) ** 2).sum(axis=(1, 2)))[:, None, None]
            f = np.divide(f, size, out=np.zeros_like(f), where=size > 0)
        f = np.conj(probe) * f
        under = at.windows(n)
        g = np.divide(f, under, out=np.zeros_like(f), where=under > 0)
        named = {"l_re": f.real, "l_im": f.imag, "r_re": g.real, "r_im": g.imag}
        return pa.table({**{c: rows.column(c) for c in ("fid", "tx", "ty", "r", "c", "part")}, **{k: dense.lists(v) for k, v in named.items()}})

    arrays = ", ".join(f"{s}_{k} array<double>" for s in "lr" for k in ("re", "im"))
    return tiles.on_chunks(rows.select("fid", "tx", "ty", "r", "c", "part", "re", "im"), norm, of, tiling, work, "fid long, tx long, ty long, r int, c int, part int, " + arrays, ("n",))


def inverse_norms(rows: DataFrame, n: int, border: int = 0) -> DataFrame:
    """(fid, d): one over the norm of each frame (re, im; arrays) less its border; null where it is zero."""
    inside = lambda _, i: i.between(border * n, (n - border) * n - 1) & (i % n).between(border, n - border - 1)
    of = lambda c: F.filter(c, inside) if border else F.col(c)
    square = sum((F.aggregate(of(c), F.lit(0.0), lambda s, x: s + x * x) for c in ("re", "im")), F.lit(0.0))
    return rows.select("fid", F.try_divide(F.lit(1.0), F.sqrt(square)).alias("d"))


def hermitian(upper: DataFrame) -> DataFrame:
    """Both triangles."""
    mirror = upper.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "re", (-F.col("im")).alias("im"))
    return upper.select("i", "j", "re", "im").unionByName(mirror)


def preconditioned(h: DataFrame, cells: DataFrame, n: int, border: int = 0) -> DataFrame:
    """D h D with D = 1 / norm of each frame less its border; null where a frame is zero."""
    inner = cells.filter(F.col("y").between(border, n - border - 1) & F.col("x").between(border, n - border - 1))
    d = inner.groupBy("fid").agg(F.try_divide(F.lit(1.0), F.sqrt(F.sum(cplx.abs2(cplx.pair())))).alias("d"))
    return scaled(h, d)


def scaled(h: DataFrame, d: DataFrame) -> DataFrame:
    """D h D with the diagonal D (fid, d)."""
    both = h.join(d.select(F.col("fid").alias("i"), F.col("d").alias("di")), "i").join(d.select(F.col("fid").alias("j"), F.col("d").alias("dj")), "j")
    return both.select("i", "j", (F.col("re") * F.col("di") * F.col("dj")).alias("re"), (F.col("im") * F.col("di") * F.col("dj")).alias("im"))


def multiplied(h: DataFrame, v: DataFrame) -> DataFrame:
    """h v: one join and one sum."""
    w = v.select(F.col("fid").alias("j"), F.col("re").alias("v_re"), F.col("im").alias("v_im"))
    re, im = cplx.mul(cplx.pair(), cplx.pair("v_"))
    return h.join(w, "j").groupBy(F.col("i").alias("fid")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def residual(h: DataFrame, v: DataFrame) -> DataFrame:
    """One row (value, residual) of a vector (fid, re, im): its Rayleigh quotient and |h v - value v| / |v|."""
    w = multiplied(h, v).select("fid", F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    both = v.join(w, "fid", "left").fillna(0.0, ["w_re", "w_im"])
    size = F.sum(cplx.abs2(cplx.pair()))
    value = both.agg(F.try_divide(F.sum(cplx.conj_mul(cplx.pair(), cplx.pair("w_"))[0]), size).alias("value"), size.alias("size"))
    off = [F.col(f"w_{c}") - F.col("value") * F.col(c) for c in ("re", "im")]
    return both.crossJoin(F.broadcast(value)).agg(F.first("value").alias("value"), F.sqrt(F.try_divide(F.sum(off[0] * off[0] + off[1] * off[1]), F.first("size"))).alias("residual"))


def eigenvector(h: DataFrame, frames: DataFrame, steps: int, keep=lambda df: df, tol: float | None = None) -> DataFrame:
    """(fid, re, im) of unit norm: the leading eigenvector of a Hermitian h by so many power steps from ones, or fewer where the residual is tol or less before.

    keep: what to do with each step's product so that plans stay short, such as writing it.
    """
    v = frames.select("fid", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    for _ in range(steps):
        if tol is not None and (residual(h, v).first()["residual"] or 0.0) <= tol:
            break
        w = keep(multiplied(h, v))
        size = F.lit(w.agg(F.sqrt(F.sum(cplx.abs2(cplx.pair())))).first()[0])
        v = w.select("fid", F.try_divide("re", size).alias("re"), F.try_divide("im", size).alias("im"))
    return v


def in_phase(v: DataFrame) -> DataFrame:
    """(fid, re, im) of unit modulus: the phases of a vector, turned so that their sum is real and positive; null where it is zero."""
    size = F.sqrt(cplx.abs2(cplx.pair()))
    unit = v.select("fid", F.try_divide("re", size).alias("re"), F.try_divide("im", size).alias("im"))
    total = unit.agg(F.sum("re").alias("t_re"), F.sum("im").alias("t_im"))
    whole = F.sqrt(cplx.abs2(cplx.pair("t_")))
    re, im = cplx.conj_mul(cplx.pair("t_"), cplx.pair())
    return unit.crossJoin(F.broadcast(total)).select("fid", F.try_divide(re, whole).alias("re"), F.try_divide(im, whole).alias("im"))


def leading(h: DataFrame, frames: DataFrame, steps: int, keep=lambda df: df, tol: float | None = None) -> DataFrame:
    """(fid, re, im) of unit modulus: phases of the leading eigenvector by power steps. See eigenvector for steps, keep and tol, in_phase for the turn."""
    return in_phase(eigenvector(h, frames, steps, keep, tol))


@dataclass
class Synchronizer:
    """What synchronising the frames of one scan takes again and again, made once: plan, chunks, pairs of chunks, normalization.

    The eigenvector comes from `steps` power steps, or, with a tolerance, from a Krylov projection
    that starts from the vector of the call before, and at first from the frames' norms with phases
    that agree from cell to cell.
    """

    plan: DataFrame
    of: DataFrame
    pairs: DataFrame
    norm: DataFrame
    tiling: Tiling
    probe: np.ndarray
    keep: Callable[[DataFrame], DataFrame]
    steps: int = 0
    tol: float | None = None
    border: int = 0
    last: krylov.Pair | None = None

    @classmethod
    def of_scan(cls, scan: DataFrame, probe: np.ndarray, width: int, keep: Callable[[DataFrame], DataFrame], **more) -> Synchronizer:
        tiling = Tiling(width, probe.shape[0])
        plan = keep(tiles.planned(scan, tiling))
        return cls(plan, keep(tiles.chunks(plan, tiling)), keep(chunk_pairs(plan, tiling)), keep(tiles.normalization(plan, tiling, probe)), tiling, probe, keep, **more)

    def matrix(self, rows: DataFrame, scale: DataFrame | None = None) -> DataFrame:
        """The scaled Gram matrix of frames (a plan's columns, re, im; arrays), written; scale (fid, d) in place of the frames' norms, by which they are divided before they meet."""
        sides = lit_sides(rows, self.norm, self.of, self.tiling, self.probe, self.border if scale is None else None)
        h = tiled_gram(sides, self.pairs, self.tiling, self.border, both=True)
        return self.keep(h if scale is None else scaled(h, scale))

    def phases(self, rows: DataFrame, scale: DataFrame | None = None) -> DataFrame:
        """(fid, re, im): factors that bring the phases of frames into agreement."""
        if self.tol is None:
            return leading(self.matrix(rows, scale), self.plan, self.steps, self.keep)
        return in_phase(self.pair(rows, scale).vector)

    def pair(self, rows: DataFrame, scale: DataFrame | None = None) -> krylov.Pair:
        """The leading eigenpair of the matrix, to the tolerance."""
        h = self.matrix(rows, scale)
        start = self.last.vector if self.last is not None else self.start(h, rows, scale)
        self.last = krylov.leading_pair(h, start, self.keep, self.tol, self.steps or 100)
        return self.last

    def start(self, h: DataFrame, rows: DataFrame, scale: DataFrame | None = None) -> DataFrame:
        """(fid, re, im): what D, the scale, leaves of a vector of phases, with phases that agree from cell to cell."""
        d = inverse_norms(rows, self.tiling.n, self.border) if scale is None else scale
        sizes = self.plan.select("fid").join(d.select("fid", "d"), "fid", "left").select("fid", F.coalesce(F.try_divide(F.lit(1.0), F.col("d")), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
        return agreement.aligned(h, sizes, agreement.cells(self.plan, self.tiling.width), self.keep)
