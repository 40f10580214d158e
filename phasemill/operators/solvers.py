"""Alternating projections, probe refinement and error measures."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from phasemill.functions import cplx
from phasemill.operators import dense, gram, prox, tiles
from phasemill.operators.tiles import Tiling
from phasemill.sources.store import Store


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row mse: the norm of a - b * phase, with the phase that brings b closest to a; images (pix, re, im)."""
    both = a.select("pix", F.col("re").alias("a_re"), F.col("im").alias("a_im")).join(b.select("pix", F.col("re").alias("b_re"), F.col("im").alias("b_im")), "pix")
    re, im = cplx.conj_mul(cplx.pair("b_"), cplx.pair("a_"))
    sums = both.agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.sum(cplx.abs2(cplx.pair("a_"))).alias("aa"), F.sum(cplx.abs2(cplx.pair("b_"))).alias("bb"))
    # |a - b p|^2 = |a|^2 + |b|^2 - 2 |<b, a>| for the best p, so one pass is enough
    return sums.select(F.sqrt(F.greatest(F.lit(0.0), F.col("aa") + F.col("bb") - 2 * F.sqrt(cplx.abs2(cplx.pair())))).alias("mse"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pix, d): |a| - |b|."""
    size = lambda p: F.sqrt(cplx.abs2(cplx.pair(p)))
    both = a.select("pix", F.col("re").alias("a_re"), F.col("im").alias("a_im")).join(b.select("pix", F.col("re").alias("b_re"), F.col("im").alias("b_im")), "pix")
    return both.select("pix", (size("a_") - size("b_")).alias("d"))


def step_norm(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row r: the norm of a - b over frames in arrays."""
    both = a.join(b.select("fid", F.col("re").alias("b_re"), F.col("im").alias("b_im")), "fid")
    squares = sum((F.aggregate(F.zip_with(k, f"b_{k}", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for k in ("re", "im")), F.lit(0.0))
    return both.agg(F.sqrt(F.sum(squares)).alias("r"))


def norms(data: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """One row: norm of the moduli, the same over sqrt(n * n), and the norm of the truth."""
    total = data.agg(F.sqrt(F.sum(F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x))).alias("frames_norm"))
    size = truth.agg(F.sqrt(F.sum(cplx.abs2(cplx.pair()))).alias("truth_norm"))
    return total.crossJoin(size).select("frames_norm", (F.col("frames_norm") / n).alias("frames_norm_r"), "truth_norm")


def exit_waves(image: DataFrame, scan: DataFrame, probe: np.ndarray, width: int) -> DataFrame:
    """probe * window of the image for each frame, as arrays."""
    tiling = Tiling(width, probe.shape[0])
    return dense.illuminate(tiles.gathered(tiles.planned(scan, tiling), tiles.tiled(image, tiling), tiling), probe)


def array_sum(rows: DataFrame, column: str, fan: int = 32) -> np.ndarray:
    """The sum of a column of arrays of one length, merged in a tree: within tasks, within `fan` tasks more, and the few that are left here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                some = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
                total = some if total is None else total + some
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=[column])

    schema = f"{column} array<double>"
    merged = rows.select(column).mapInArrow(add, schema).repartition(fan).mapInArrow(add, schema)
    found = [np.array(r[column]) for r in merged.collect()]
    return sum(found) if found else np.zeros(0)


def refined_probe(fitted: DataFrame, image: DataFrame, of: DataFrame, tiling: Tiling, probe: np.ndarray, sum_numerator: bool = False) -> np.ndarray:
    """The least-squares probe for frames (a plan's columns, re, im; arrays) and the image (tiles) they came from, regularised by the old one.

    The numerator is a mean over frames like the denominator; sum_numerator takes its sum instead,
    which multiplies the probe by the number of frames.
    """
    n = tiling.n

    def work(rows: pa.Table, at: tiles.Place, re: np.ndarray, im: np.ndarray) -> pa.Table:
        f, s = dense.stack(rows.column("re"), n) + 1j * dense.stack(rows.column("im"), n), at.windows(re + 1j * im)
        a = (np.conj(s) * f).sum(axis=0)
        sums = np.concatenate([a.real.ravel(), a.imag.ravel(), (np.abs(s) ** 2).sum(axis=0).ravel(), [len(f)]])
        return pa.table({"sums": pa.array([sums], pa.list_(pa.float64()))})

    rows = fitted.select("fid", "tx", "ty", "r", "c", "part", "re", "im")
    sums = array_sum(tiles.on_chunks(rows, image, of, tiling, work, "sums array<double>"), "sums")
    if not len(sums):
        return probe
    count, (re, im, size) = sums[-1], sums[:-1].reshape(3, n, n)
    size, eps = size / count, size.max() / count * 1e-2
    top = (re + 1j * im) / (1 if sum_numerator else count)
    return (top + (count if sum_numerator else 1) * eps * probe) / (size + eps)


def lens_masked(probe: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The probe without the frequencies outside a mask; n * n numbers."""
    return np.fft.ifft2(np.fft.fft2(probe) * lens)


class Solution(NamedTuple):
    """What a solver ends with: the image (pix, re, im), the residuals of its steps, the frames (fid, re, im), the probe and its normalization (pix, n), and the seconds that tasks spent in each kind of work (operator, seconds)."""

    image: DataFrame
    residuals: DataFrame
    frames: DataFrame
    probe: np.ndarray
    normalization: DataFrame
    times: DataFrame


RESIDUALS = "iter int, r_truth double, r_data double, r_step double"
#: Kinds of work whose seconds are measured inside tasks.
WORK = ("split", "illuminate", "transform", "prox", "overlap")
_PLACED = "fid long, tx long, ty long, r int, c int, part int, intensity array<double>, re array<double>, im array<double>"
_STEP = "kind int, top int, left int, h int, w int, n array<double>, " + _PLACED + ", off_data double, off_step double, " + ", ".join(f"s_{k} double" for k in WORK)


class _Clock:
    """Seconds of each kind of work in one chunk."""

    def __init__(self) -> None:
        self.seconds, self.at = dict.fromkeys(WORK, 0.0), time.perf_counter()

    def __call__(self, kind: str) -> None:
        now = time.perf_counter()
        self.seconds[kind] += now - self.at
        self.at = now


def _step(rows: DataFrame, image: DataFrame, of: DataFrame, tiling: Tiling, probe: np.ndarray, project: bool, blocks: bool, frames_too: bool) -> DataFrame:
    """One pass over all frames: cut from the image, illuminated and, with project, given the measured moduli.

    Rows of kind 0 are what they add to the image, by tile (blocks), those of kind 1 the frames
    (frames_too). off_data sums the squared distances of moduli from the measured ones, off_step those
    of the new frames from the ones in rows, where rows have them.
    """
    n, has_before = tiling.n, "re" in rows.columns

    def work(rows: pa.Table, at: tiles.Place, re: np.ndarray, im: np.ndarray) -> pa.Table:
        clock = _Clock()
        f = at.windows(re + 1j * im)
        clock("split")
        f = f * probe
        clock("illuminate")
        off_step = off_data = 0.0
        if has_before:
            off_step = float((np.abs(f - dense.stack(rows.column("re"), n) - 1j * dense.stack(rows.column("im"), n)) ** 2).sum())
            clock.at = time.perf_counter()
        if project:
            intensity = dense.stack(rows.column("intensity"), n)
            clock.at = time.perf_counter()
            hat = np.fft.fft2(f)
            clock("transform")
            off_data = float(((np.abs(hat) - np.sqrt(intensity)) ** 2).sum())
            clock.at = time.perf_counter()
            hat = prox.prox(hat, intensity)
            clock("prox")
            f = np.fft.ifft2(hat)
            clock("transform")
        out = []
        if blocks:
            made = at.blocks(at.summed(np.conj(probe) * f), at.summed(np.abs(probe) ** 2))
            clock("overlap")
            out.append(pa.table({"kind": pa.array([0] * len(made["r"]), pa.int32()), **made}))
        if frames_too:
            carried = {c: rows.column(c) for c in ("fid", "tx", "ty", "r", "c", "part", "intensity")}
            out.append(pa.table({"kind": pa.array([1] * len(f), pa.int32()), **carried, "re": dense.lists(f.real), "im": dense.lists(f.imag)}))
        sums = {"off_data": off_data, "off_step": off_step, **{f"s_{k}": v for k, v in clock.seconds.items()}}
        out.append(pa.table({"kind": pa.array([2], pa.int32()), **{k: pa.array([v]) for k, v in sums.items()}}))
        return _filled(pa.concat_tables(out, promote_options="default"))

    return tiles.on_chunks(rows, image, of, tiling, work, _STEP)


def _filled(table: pa.Table) -> pa.Table:
    """All columns of a step, null where the table has none."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    named = [c.split() for c in _STEP.split(", ")]
    return pa.table({c: table.column(c) if c in table.column_names else pa.nulls(table.num_rows, kinds[k]) for c, k in named})


def _rotated(rows: DataFrame, omega: DataFrame, n: int) -> DataFrame:
    """Placed frames times their factors (fid, re, im)."""
    w = omega.select("fid", F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    turn = lambda a, b, sign: F.zip_with(a, b, lambda x, y: x * F.col("w_re") + sign * (y * F.col("w_im")))
    return rows.join(w, "fid").select("fid", "tx", "ty", "r", "c", "part", "intensity", turn("re", "im", -1).alias("re"), turn("im", "re", 1).alias("im"))


def _compared(image: DataFrame, truth: DataFrame) -> DataFrame:
    """Tiles with the inner products of image and truth (tiles) as d_re, d_im, and their squares as aa (truth), bb."""
    both = image.join(truth.select("r", "c", F.col("re").alias("t_re"), F.col("im").alias("t_im")), ["r", "c"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, 4))
            for k in range(batch.num_rows):
                if batch.column(5)[k].is_valid:
                    b, a = (batch.column(i)[k].values.to_numpy() + 1j * batch.column(i + 1)[k].values.to_numpy() for i in (2, 5))
                    seen = ~(np.isnan(a) | np.isnan(b))
                    d = np.vdot(b[seen], a[seen])
                    sums[k] = d.real, d.imag, (np.abs(a[seen]) ** 2).sum(), (np.abs(b[seen]) ** 2).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(sums[:, i]) for i in range(4))], names=["r", "c", "re", "im", "n", "d_re", "d_im", "aa", "bb"])

    return both.select("r", "c", "re", "im", "n", "t_re", "t_im").mapInArrow(work, tiles.TILE + ", d_re double, d_im double, aa double, bb double")


def alternating_projections(
    scan: DataFrame, data: DataFrame, probe: np.ndarray, width: int, steps: int, image: DataFrame, truth: DataFrame | None = None,
    power_steps: int = 0, power_tol: float | None = None, refine_from: int | None = None, lens: np.ndarray | None = None, normalization: DataFrame | None = None, residuals_interval: int = 1, write_frames: bool = True,
) -> Solution:
    """The solution after so many steps from an image (pix, re, im).

    Each step gives the frames the measured moduli, sums them up to an image and cuts frames from it
    anew; with power_steps or power_tol their phases are synchronised before, by an eigenvector from
    so many power steps or, with power_tol, to that residual in so many cycles at most (0: 100). From step refine_from on the probe is refined, and freed of
    frequencies outside lens, and with it its normalization, which is otherwise the given one.
    residuals (iter, r_truth, r_data, r_step), of every residuals_interval-th step from the first (0:
    of none), are relative to the norms of truth, of the moduli and of the frames; r_truth is 0
    without truth.

    Chunks of frames, their data, normalization and, for synchronising, the pairs of chunks are
    written once. A step is one pass over the frames that writes what they add to the image, and one
    over the tiles that adds it up, whatever its number; residuals and times are observed as these are
    written. What a step wrote goes when the next has read it. With no recording or refining, frames
    that were synchronised are added up as they are turned, and without synchronising none are written
    at all until the last pass. Without write_frames that pass is left to who reads the frames, and
    times have nothing of it; residuals need it.
    """
    spark, n = scan.sparkSession, probe.shape[0]
    tiling, synchronising = Tiling(width, n), bool(power_steps) or power_tol is not None
    if residuals_interval and not write_frames:
        raise ValueError("the last residual comes from the frames that are written last")
    seconds, rows_out = dict.fromkeys(WORK, 0.0), []
    with Store(spark) as keep:
        size = norms(data, truth if truth is not None else image, n).first() if residuals_interval else None
        plan = keep(tiles.planned(scan, tiling))
        of = keep(tiles.chunks(plan, tiling))
        given = normalization is not None
        norm = keep(tiles.tiled(normalization, tiling, ("n",)) if given else tiles.normalization(plan, tiling, probe))
        true = keep(tiles.tiled(truth, tiling)) if truth is not None else None
        placed = keep(plan.join(data.select("fid", "intensity"), "fid").select("fid", "tx", "ty", "r", "c", "part", "intensity"))
        sync = gram.Synchronizer(plan, of, keep(gram.chunk_pairs(plan, tiling)), norm, tiling, probe, keep, power_steps, power_tol) if synchronising else None
        current = keep(tiles.tiled(image, tiling))
        fixed, before = [plan, of, true, placed, sync.pairs if sync else None], None

        def observed(df: DataFrame) -> tuple[DataFrame, dict]:
            seen = Observation()
            out = keep(df.observe(seen, *(F.sum(c).alias(c) for c in ("off_data", "off_step", *(f"s_{k}" for k in WORK)))))
            for k in WORK:
                seconds[k] += seen.get[f"s_{k}"] or 0.0
            if before is not None and rows_out:
                rows_out[-1][3] = (seen.get["off_step"] or 0.0) ** 0.5 / size["frames_norm_r"] if size["frames_norm_r"] else None
            return out, seen.get

        for i in range(steps):
            recorded = bool(residuals_interval) and i % residuals_interval == 0
            refining = refine_from is not None and i >= refine_from
            out, got = observed(_step(before if before is not None else placed, current, of, tiling, probe, True, not synchronising, recorded or refining or synchronising))
            fitted = out.filter("kind = 1").select(*(c.split()[0] for c in _PLACED.split(", ")))
            if synchronising:
                fitted = _rotated(fitted, sync.phases(fitted), n)
                fitted = keep(fitted) if recorded or refining else fitted
                sums = tiles.placed_sum(fitted, tiling, probe)
            else:
                sums = tiles.merged(out.filter("kind = 0"), tiling)
            moved = tiles.divided(sums, norm if given else None)
            off = 0.0
            if true is not None and recorded:
                seen = Observation()
                compared = _compared(moved, true).observe(seen, *(F.sum(c).alias(c) for c in ("d_re", "d_im", "aa", "bb")))
                current = keep(compared.select("r", "c", "re", "im", "n"))
                d = {c: seen.get[c] or 0.0 for c in ("d_re", "d_im", "aa", "bb")}
                off = max(0.0, d["aa"] + d["bb"] - 2 * (d["d_re"] ** 2 + d["d_im"] ** 2) ** 0.5) ** 0.5
            else:
                current = keep(moved)
            if refining:
                probe = refined_probe(fitted, current, of, tiling, probe)
                probe = probe if lens is None else lens_masked(probe, lens)
                given, norm = False, keep(tiles.normalization(plan, tiling, probe))
                if sync:
                    sync.norm, sync.probe = norm, probe
            if recorded:
                rows_out.append([i, off / size["truth_norm"] if size["truth_norm"] else None, (got["off_data"] or 0.0) ** 0.5 / size["frames_norm"] if size["frames_norm"] else None, None])
            before = fitted if recorded else None
            keep.drop_but(*fixed, norm, current, out if not synchronising and recorded else None, fitted if recorded else None, sync.last.source if sync and sync.last else None)
        last = _step(before if before is not None else placed, current, of, tiling, probe, False, False, True)
        if write_frames:
            waves, _ = observed(last)
            keep.drop_but(norm, current, waves)
        else:
            waves = last
            keep.drop_but(norm, current, of, placed)
    times = spark.createDataFrame([(k, float(v)) for k, v in seconds.items()], "operator string, seconds double")
    return Solution(
        tiles.pixels(current, tiling, "re", "im"), spark.createDataFrame(rows_out, RESIDUALS), waves.filter("kind = 1").select("fid", "re", "im"), probe,
        normalization if given else tiles.pixels(norm, tiling, "n"), times,
    )


def shares(times: DataFrame, name: str, seconds: str) -> DataFrame:
    """(name, share): each name's part of all seconds; null where there are none."""
    by = times.groupBy(name).agg(F.sum(seconds).alias("seconds"))
    total = by.agg(F.sum("seconds").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(name, F.try_divide("seconds", "total").alias("share"))
