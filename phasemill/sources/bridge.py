"""Ptychographic inputs drawn from the embeddings table: as many frames as it has rows.

Row vec_id of 64 numbers is an 8 x 8 frame: re from its elements in order, im from them in
reverse. The scan is a close-packed lattice of about square shape, so the image grows with
the number of frames; its pixels come from the same numbers through the transmission.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.functions import cplx
from phasemill.operators import geometry, tiles
from phasemill.operators.tiles import Tiling

N = 8
STEP = 5
#: Radii and focus of the probe: at n = 8 the usual smaller radii hold no frequency.
PROBE = {"r1": 0.1, "r2": 0.3, "fx": 20.0, "fy": -20.0}


@dataclass
class Setup:
    spark: SparkSession
    vectors: DataFrame
    scan: DataFrame
    width: int
    probe: np.ndarray

    @property
    def pixels(self) -> DataFrame:
        return geometry.frame_pixels(self.scan, N, self.width)

    @property
    def tiling(self) -> Tiling:
        return Tiling(self.width, N)

    @property
    def plan(self) -> DataFrame:
        """The chunk of each frame."""
        return tiles.planned(self.scan, self.tiling)

    @property
    def placed(self) -> DataFrame:
        """Frames as arrays with their chunks."""
        return self.plan.join(self.frames, "fid")

    @property
    def frames(self) -> DataFrame:
        """(fid, re, im) as arrays."""
        e = F.transform("embedding", lambda x: x.cast("double"))
        return self.vectors.select(F.col("vec_id").alias("fid"), e.alias("re"), F.reverse(e).alias("im"))

    @property
    def cells(self) -> DataFrame:
        from phasemill.operators import dense

        return dense.long(self.frames, N)

    @property
    def image(self) -> DataFrame:
        """(pix, y, x, re, im): row y from vector y, of which there must be as many as the image is wide, column x from element x modulo 64."""
        rows = self.vectors.select(F.col("vec_id").alias("y"), "embedding").filter(F.col("vec_id") < self.width)
        cells = rows.select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.width - 1).cast("long"))).alias("x"), "embedding")
        g = F.element_at("embedding", (F.col("x") % 64 + 1).cast("int")).cast("double")
        return cells.select((F.col("y") * self.width + F.col("x")).alias("pix"), "y", "x", *cplx.named(geometry.transmission(g)))

    @property
    def omega(self) -> DataFrame:
        """(fid, re, im): planted phases."""
        angle = F.lit(2 * math.pi) * ((F.col("fid") * 37) % 101) / 101
        return self.scan.select("fid", *cplx.named(cplx.turn(angle)))


def setup(spark: SparkSession, sf_dir: str) -> Setup:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    across = math.ceil(math.sqrt(vectors.count()))
    scan = geometry.translations(vectors, STEP, across, "vec_id")
    width = geometry.extent(scan).first()["width"]
    return Setup(spark, vectors, scan, width, geometry.make_probe(N, **PROBE))
