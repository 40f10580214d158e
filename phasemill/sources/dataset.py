"""A diffraction data set as a folder of Parquet tables.

scan (fid, tx, ty), data (fid, intensity), probe and lens (y, x, ...), truth (pix, re, im) and
one row of physical numbers. Translations are kept in pixels and scaled on the way in and out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.operators import geometry


@dataclass
class Dataset:
    scan: DataFrame
    data: DataFrame
    probe: np.ndarray
    lens: np.ndarray
    truth: DataFrame | None
    width: int
    wavelength: float = 0.1
    distance: float = 1600.0
    pixel: float = 100.0

    @property
    def resolution(self) -> float:
        return geometry.resolution(self.wavelength, self.distance, self.probe.shape[0], self.pixel)


def write(found: Dataset, folder: str) -> None:
    """Every table of the set; translations in units of length."""
    spark = found.scan.sparkSession
    n, r = found.probe.shape[0], found.resolution
    found.scan.select("fid", (F.col("tx") * r).alias("tx"), (F.col("ty") * r).alias("ty")).write.parquet(f"{folder}/scan")
    found.data.write.parquet(f"{folder}/data")
    geometry.probe_table(spark, found.probe).write.parquet(f"{folder}/probe")
    spark.createDataFrame([(i // n, i % n, bool(v)) for i, v in enumerate(found.lens.ravel())], "y long, x long, mask boolean").write.parquet(f"{folder}/lens")
    if found.truth is not None:
        found.truth.select("pix", "re", "im").write.parquet(f"{folder}/truth")
    spark.createDataFrame([(found.width, found.wavelength, found.distance, found.pixel, found.truth is not None)], "width long, wavelength double, distance double, pixel double, has_truth boolean").write.parquet(f"{folder}/physics")


def read(spark: SparkSession, folder: str) -> Dataset:
    """The set of a folder; the probe, n x n numbers, comes to the driver."""
    p = spark.read.parquet(f"{folder}/physics").first()
    cells = spark.read.parquet(f"{folder}/probe").orderBy("y", "x").collect()
    n = round(len(cells) ** 0.5)
    probe = np.array([c["re"] + 1j * c["im"] for c in cells]).reshape(n, n)
    lens = np.array([c["mask"] for c in spark.read.parquet(f"{folder}/lens").orderBy("y", "x").collect()]).reshape(n, n)
    truth = spark.read.parquet(f"{folder}/truth") if p["has_truth"] else None
    out = Dataset(None, spark.read.parquet(f"{folder}/data"), probe, lens, truth, p["width"], p["wavelength"], p["distance"], p["pixel"])
    at = lambda c: F.round(F.col(c) / out.resolution).cast("long").alias(c)
    out.scan = spark.read.parquet(f"{folder}/scan").select("fid", at("tx"), at("ty"))
    return out
