"""Frames as arrays: one row per frame, re and im of n * n numbers each, y-major.

Fourier transforms and what goes with them run in NumPy on Arrow batches of whole frames, so
they need no shuffle; everything that sums over frames is left to Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "fid long, re array<double>, im array<double>"


def stack(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Arrays of n * n numbers as frames."""
    values = column.combine_chunks().flatten().to_numpy() if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), n, n)


def lists(values: np.ndarray) -> pa.Array:
    """Frames as arrays of numbers."""
    flat = np.ascontiguousarray(values.reshape(len(values), -1), dtype=np.float64)
    ends = np.arange(len(values) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))


def on_frames(frames: DataFrame, n: int, change: Callable[..., np.ndarray], *others: str) -> DataFrame:
    """frames with change(complex frames, *arrays of the other columns) in place of re and im; other columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = stack(batch.column(1), n) + 1j * stack(batch.column(2), n)
            out = change(f, *(stack(batch.column(3 + k), n) for k in range(len(others))))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(out.real), lists(out.imag)], names=["fid", "re", "im"])

    return frames.select("fid", "re", "im", *others).mapInArrow(run, SCHEMA)


def propagate(frames: DataFrame, n: int) -> DataFrame:
    """Two-dimensional Fourier transform of each frame, DC at (0, 0)."""
    return on_frames(frames, n, np.fft.fft2)


def back_propagate(frames: DataFrame, n: int) -> DataFrame:
    """Its inverse, with 1 / n^2."""
    return on_frames(frames, n, np.fft.ifft2)


def rows_transformed(frames: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """One-dimensional transform along x."""
    return on_frames(frames, n, np.fft.ifft if inverse else np.fft.fft)


def illuminate(frames: DataFrame, probe: np.ndarray, conjugate: bool = False) -> DataFrame:
    """Each frame times the probe or its conjugate."""
    p = np.conj(probe) if conjugate else probe
    return on_frames(frames, probe.shape[0], lambda f: f * p)


def along(frames: DataFrame, probe: np.ndarray) -> DataFrame:
    """(fid, re, im): the factor by which the probe comes closest to each frame, its inner product with the frame over its own square."""
    n, square = probe.shape[0], float((np.abs(probe) ** 2).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = stack(batch.column(1), n) + 1j * stack(batch.column(2), n)
            c = np.einsum("yx,kyx->k", np.conj(probe), f) / square
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.real), pa.array(c.imag)], names=["fid", "re", "im"])

    return frames.select("fid", "re", "im").mapInArrow(run, "fid long, re double, im double")


def filtered(frames: DataFrame, mask: np.ndarray) -> DataFrame:
    """Each frame with the frequencies outside the mask removed."""
    return on_frames(frames, mask.shape[0], lambda f: np.fft.ifft2(np.fft.fft2(f) * mask))


def aperture(probe: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Frequencies at which the probe has more than a share of its largest modulus."""
    size = np.abs(np.fft.fft2(probe))
    return size / size.max() > share


def intensities(frames: DataFrame, n: int) -> DataFrame:
    """(fid, intensity): squared moduli of the transforms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.fft.fft2(stack(batch.column(1), n) + 1j * stack(batch.column(2), n))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.abs(f) ** 2)], names=["fid", "intensity"])

    return frames.select("fid", "re", "im").mapInArrow(run, "fid long, intensity array<double>")


def long(frames: DataFrame, n: int) -> DataFrame:
    """(fid, y, x, re, im)."""
    cells = frames.select("fid", F.posexplode(F.arrays_zip("re", "im")).alias("i", "v"))
    return cells.select("fid", F.expr(f"bigint(i div {n})").alias("y"), F.expr(f"bigint(i % {n})").alias("x"), "v.re", "v.im")


def packed(cells: DataFrame, n: int) -> DataFrame:
    """The inverse of long; one shuffle by frame."""
    return cells.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct((F.col("y") * n + F.col("x")).alias("i"), "re", "im"))).alias("v")).select("fid", F.col("v.re").alias("re"), F.col("v.im").alias("im"))
