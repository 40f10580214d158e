"""Scan lattices, frame-to-image maps, probes, crops and shifts.

Conventions: pixel id = y * width + x with periodic wrap on both axes; frames have n x n
pixels (y = row, x = column); translations are integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def translations(frames: DataFrame, step: int, across: int, fid: str = "fid") -> DataFrame:
    """(fid, tx, ty): a close-packed lattice, `across` frames a row, every other row shifted by half a step."""
    k = F.col(fid)
    row, column = F.expr(f"`{fid}` div {across}"), F.pmod(k, F.lit(across))
    return frames.select(k.alias("fid"), (step * column + (step // 2) * F.pmod(row + 1, F.lit(2))).cast("long").alias("tx"), (step * row).cast("long").alias("ty"))


def extent(scan: DataFrame) -> DataFrame:
    """One row: the image width that the scan spans."""
    return scan.agg(F.ceil(F.max("tx") - F.min("tx")).cast("long").alias("width"))


def grid(spark: SparkSession, n: int) -> DataFrame:
    """(y, x) of an n x n frame."""
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("y"), F.expr(f"id % {n}").alias("x"))


def frame_pixels(scan: DataFrame, n: int, width: int) -> DataFrame:
    """(fid, y, x, pix): where each pixel of each frame lies in the image; a projection, no shuffle."""
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long")))
    cells = scan.select("fid", "tx", "ty", cell.alias("i")).select("fid", "tx", "ty", F.expr(f"i div {n}").alias("y"), F.expr(f"i % {n}").alias("x"))
    w = F.lit(width)
    return cells.select("fid", "y", "x", (F.pmod(F.col("ty") + F.col("y"), w) * w + F.pmod(F.col("tx") + F.col("x"), w)).alias("pix"))


def make_probe(n: int, r1: float = 0.03, r2: float = 0.06, fx: float = 0.0, fy: float = 0.0) -> np.ndarray:
    """Probe of an annulus of frequencies with a quadratic phase, largest modulus 1; n even.

    n x n numbers whatever the scan, so it is made on the driver and joins as a small table.
    """
    if n % 2:
        raise ValueError("n must be even")
    f = np.fft.fftfreq(n) * n
    radius = np.hypot(f[:, None], f[None, :])
    lit = (radius >= r1 * n) & (radius <= r2 * n)
    if not lit.any():
        raise ValueError("no frequency lies between the radii")
    phase = np.pi * (fx * (f[:, None] / n) ** 2 + fy * (f[None, :] / n) ** 2)
    probe = np.fft.fftshift(np.fft.ifft2(np.where(lit, np.exp(1j * phase), 0)))
    return probe / np.abs(probe).max()


def probe_table(spark: SparkSession, probe: np.ndarray) -> DataFrame:
    """(y, x, re, im) of a probe."""
    y, x = np.indices(probe.shape)
    return spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "re": probe.real.ravel(), "im": probe.imag.ravel()}), "y long, x long, re double, im double")


def cropped(image: DataFrame, start: Column, size: Column) -> DataFrame:
    """The window [start, start + size) of both axes, counted from 0 there."""
    inside = F.col("y").between(start, start + size - 1) & F.col("x").between(start, start + size - 1)
    return image.filter(inside).withColumns({"y": F.col("y") - start, "x": F.col("x") - start})


def crop_center(image: DataFrame, width: int, size: int) -> DataFrame:
    return cropped(image, F.lit(width // 2 - size // 2), F.lit(size))


def crop_to(image: DataFrame, width: int, size: int) -> DataFrame:
    """Like crop_center, but an even width and an odd size begin one pixel earlier."""
    return cropped(image, F.lit((width - size) // 2), F.lit(size))


def shifted(frames: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """fftshift of frames, or its inverse: pixel i goes to i + n//2, or i - n//2, modulo n."""
    by = -(n // 2) if inverse else n // 2
    return frames.withColumns({a: F.pmod(F.col(a) + F.lit(by), F.lit(n)) for a in ("y", "x")})


def transmission(g: Column) -> tuple[Column, Column]:
    """exp(0.69 (-1 + 0.5i) g) as (re, im)."""
    size = F.exp(-0.69 * g)
    return size * F.cos(0.345 * g), size * F.sin(0.345 * g)


def resolution(wavelength: float, distance: float, n: int, pixel: float) -> float:
    return wavelength * distance / (n * pixel)
