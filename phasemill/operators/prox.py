"""Data constraints: frames are given the measured moduli of their Fourier transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.operators import dense

#: Regularisation of the modulus projection.
EPS = 1e-2


def prox(f: np.ndarray, intensity: np.ndarray, eps: float = EPS) -> np.ndarray:
    """f * sqrt((intensity + eps) / (|f|^2 + eps))."""
    return f * np.sqrt((intensity + eps) / (np.abs(f) ** 2 + eps))


def prox_reciprocal(f: np.ndarray, r: np.ndarray, eps: float = EPS) -> np.ndarray:
    """The same with r = 1 / (intensity + eps) given."""
    return f / np.sqrt((np.abs(f) ** 2 + eps) * r)


def prox_data(spectra: DataFrame, data: DataFrame, n: int, eps: float = EPS) -> DataFrame:
    """prox of spectra (fid, re, im) with data (fid, intensity)."""
    return dense.on_frames(spectra.join(data, "fid"), n, lambda f, i: prox(f, i, eps), "intensity")


def prox_data_reciprocal(spectra: DataFrame, data: DataFrame, n: int, eps: float = EPS) -> DataFrame:
    r = data.select("fid", F.transform("intensity", lambda x: 1 / (x + eps)).alias("r"))
    return dense.on_frames(spectra.join(r, "fid"), n, lambda f, i: prox_reciprocal(f, i, eps), "r")


def project_data_reciprocal(frames: DataFrame, data: DataFrame, n: int, eps: float = EPS) -> DataFrame:
    """Transform, prox with r = 1 / (intensity + eps) and transform back, in one pass over the frames."""
    r = data.select("fid", F.transform("intensity", lambda x: 1 / (x + eps)).alias("r"))
    return dense.on_frames(frames.join(r, "fid"), n, lambda f, r: np.fft.ifft2(prox_reciprocal(np.fft.fft2(f), r, eps)), "r")


def reciprocal_residual(frames: DataFrame, data: DataFrame, n: int, eps: float = EPS) -> DataFrame:
    """One row r: the norm of transform - 1 / sqrt(r) over all frames, r = 1 / (intensity + eps); the transform itself, not its modulus."""
    gap = dense.on_frames(frames.join(data, "fid"), n, lambda f, i: np.fft.fft2(f) - np.sqrt(i + eps), "intensity")
    return gap.agg(F.sqrt(F.sum(sum((F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) for c in ("re", "im")), F.lit(0.0)))).alias("r"))


def project_data(frames: DataFrame, data: DataFrame, n: int, eps: float = EPS) -> DataFrame:
    """Transform, prox and transform back, in one pass over the frames."""
    return dense.on_frames(frames.join(data, "fid"), n, lambda f, i: np.fft.ifft2(prox(np.fft.fft2(f), i, eps)), "intensity")


def data_residual(frames: DataFrame, data: DataFrame, n: int) -> DataFrame:
    """One row r: the norm of |transform| - sqrt(intensity) over all frames."""
    gap = dense.on_frames(frames.join(data, "fid"), n, lambda f, i: (np.abs(np.fft.fft2(f)) - np.sqrt(i)) + 0j, "intensity")
    return gap.agg(F.sqrt(F.sum(F.aggregate("re", F.lit(0.0), lambda a, x: a + x * x))).alias("r"))
