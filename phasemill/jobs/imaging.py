"""Simulate a diffraction data set, and reconstruct an image from one.

python -m phasemill.jobs.imaging simulate SF_DIR FOLDER
python -m phasemill.jobs.imaging reconstruct FOLDER OUT [STEPS]
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.operators import dense, geometry, gram, solvers
from phasemill.sources import dataset
from phasemill.sources.bridge import N, Setup, setup
from phasemill.sources.store import kept


def simulate(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Intensities of all frames of the scan over the image that the embeddings give."""
    s = setup(spark, sf_dir)
    waves = solvers.exit_waves(s.image, s.scan, s.probe, s.width)
    dataset.write(dataset.Dataset(s.scan, dense.intensities(waves, N), s.probe, dense.aperture(s.probe), s.image, s.width), folder)


def reconstruct(spark: SparkSession, folder: str, steps: int = 10, refine_from: int | None = None) -> solvers.Solution:
    """The solution from an image of ones; a refined probe keeps to the frequencies of the lens."""
    d = dataset.read(spark, folder)
    pixels = geometry.frame_pixels(d.scan, d.probe.shape[0], d.width).select("pix").distinct()
    ones = pixels.select("pix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return solvers.alternating_projections(d.scan, d.data, d.probe, d.width, steps, kept(ones), d.truth, refine_from=refine_from, lens=d.lens)


def usual_size(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Setup]:
    """Scan and intensities of 256 frames of 128 x 128 over an image of 77 x 77 from the embeddings, and that image: the usual size of a simulation."""
    scan = kept(geometry.translations(spark.range(256).withColumnRenamed("id", "fid"), 5, 16))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    s = Setup(spark, vectors, scan, geometry.extent(scan).first()["width"], geometry.make_probe(128, fx=20.0, fy=-20.0))
    return scan, kept(dense.intensities(solvers.exit_waves(s.image, scan, s.probe, s.width), 128)), s


def solved_usual_size(spark: SparkSession, sf_dir: str, steps: int = 5) -> DataFrame:
    """The image after some steps from ones."""
    scan, data, s = usual_size(spark, sf_dir)
    ones = s.image.select("pix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return solvers.alternating_projections(scan, data, s.probe, s.width, steps, ones, s.image).image


def gram_usual_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaled Gram matrix of its exit waves: all 32,896 pairs overlap."""
    scan, _, s = usual_size(spark, sf_dir)
    sync = gram.Synchronizer.of_scan(scan, s.probe, s.width, kept)
    waves = solvers.exit_waves(s.image, scan, s.probe, s.width)
    return sync.matrix(kept(sync.plan.join(waves, "fid")))


def last_error(residuals: DataFrame) -> DataFrame:
    """One row: the last step's distance from the truth, null where there was no step."""
    return residuals.agg(F.max_by("r_truth", "iter").alias("nmse"))


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    if sys.argv[1] == "simulate":
        simulate(session, sys.argv[2], sys.argv[3])
    else:
        found = reconstruct(session, sys.argv[2], int(sys.argv[4]) if len(sys.argv) > 4 else 10)
        found.image.write.parquet(f"{sys.argv[3]}/image")
        found.frames.write.parquet(f"{sys.argv[3]}/frames")
        geometry.probe_table(session, found.probe).write.parquet(f"{sys.argv[3]}/probe")
        found.residuals.write.parquet(f"{sys.argv[3]}/residuals")
