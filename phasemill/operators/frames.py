"""Gather and scatter between an image and its overlapping frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.functions import cplx
from phasemill.operators import geometry


def split(pixels: DataFrame, image: DataFrame) -> DataFrame:
    """(fid, y, x, re, im): each frame's window of the image; a join on the pixel."""
    return pixels.join(image.select("pix", "re", "im"), "pix").select("fid", "y", "x", "re", "im")


def overlap(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """(pix, re, im): sums of frames over the pixels they cover; frames without a place are left out."""
    return cells.join(pixels, ["fid", "y", "x"]).groupBy("pix").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def placed(cells: DataFrame, scan: DataFrame, width: int) -> DataFrame:
    """cells with their pixel, by the frame's translation alone: one small join instead of one per pixel."""
    w = F.lit(width)
    pix = F.pmod(F.col("ty") + F.col("y"), w) * w + F.pmod(F.col("tx") + F.col("x"), w)
    return cells.join(scan, "fid").select("fid", "y", "x", "re", "im", pix.alias("pix"))


def summed(at: DataFrame) -> DataFrame:
    """(pix, re, im) of placed cells: one shuffle, summed before it where frames of a task overlap."""
    return at.groupBy("pix").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def normalization(pixels: DataFrame, probe: np.ndarray) -> DataFrame:
    """(pix, n): sums of the probe's squared modulus."""
    return with_probe(pixels, probe).groupBy("pix").agg(F.sum(cplx.abs2(cplx.pair("p_"))).alias("n"))


def projected(cells: DataFrame, scan: DataFrame, probe: np.ndarray, width: int, norm: DataFrame | None = None) -> DataFrame:
    """(pix, re, im): sum of conj(probe) * frame over sum of |probe|^2, both in one aggregation, or over a given norm (pix, n); null where nothing lies."""
    lit = with_probe(placed(cells, scan, width), probe)
    p = cplx.pair("p_")
    re, im = cplx.conj_mul(p, cplx.pair())
    sums = lit.groupBy("pix").agg(F.sum(re).alias("a"), F.sum(im).alias("b"), F.sum(cplx.abs2(p)).alias("n"))
    if norm is not None:
        sums = sums.drop("n").join(norm.select("pix", "n"), "pix")
    return sums.select("pix", F.try_divide("a", "n").alias("re"), F.try_divide("b", "n").alias("im"))


def with_probe(cells: DataFrame, probe: np.ndarray) -> DataFrame:
    """cells with the probe's value at their place as p_re, p_im; the probe's n * n rows are broadcast, whatever the scan."""
    p = geometry.probe_table(cells.sparkSession, probe).select("y", "x", F.col("re").alias("p_re"), F.col("im").alias("p_im"))
    names = [F.col(c) for c in cells.columns]
    return cells.join(F.broadcast(p), ["y", "x"]).select(*names, "p_re", "p_im")


def illuminated(cells: DataFrame, probe: np.ndarray) -> DataFrame:
    re, im = cplx.mul(cplx.pair("p_"), cplx.pair())
    return with_probe(cells, probe).select("fid", "y", "x", re.alias("re"), im.alias("im"))


def replicated(frames: DataFrame, probe: np.ndarray) -> DataFrame:
    """(fid, y, x, re, im): the probe once for each frame."""
    n = probe.shape[1]
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long")))
    cells = frames.select("fid", cell.alias("i")).select("fid", F.expr(f"i div {n}").alias("y"), F.expr(f"i % {n}").alias("x"))
    return with_probe(cells, probe).select("fid", "y", "x", F.col("p_re").alias("re"), F.col("p_im").alias("im"))


def frame_sum(cells: DataFrame) -> DataFrame:
    """(y, x, re, im): the sum of all frames."""
    return cells.groupBy("y", "x").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def stacked(cells: DataFrame, omega: DataFrame) -> DataFrame:
    """Each frame times its own factor (fid, re, im)."""
    w = omega.select("fid", F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    re, im = cplx.mul(cplx.pair("w_"), cplx.pair())
    return cells.join(w, "fid").select("fid", "y", "x", re.alias("re"), im.alias("im"))


def plan(scan: DataFrame, n: int, width: int):
    """(Split, Overlap) as functions of an image and of cells."""
    pixels = geometry.frame_pixels(scan, n, width)
    return (lambda image: split(pixels, image)), (lambda cells: summed(placed(cells, scan, width)))
