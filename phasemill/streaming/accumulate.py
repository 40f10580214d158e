"""Frames that arrive as a stream, summed into the image they cover.

Sums are associative, so each micro-batch adds its own sums of conj(probe) * frame and of
|probe|^2 per pixel to a table of partial sums; the image is their total, divided.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phasemill.functions import cplx
from phasemill.operators import dense, frames


def partial_sums(batch: DataFrame, scan: DataFrame, probe: np.ndarray, width: int) -> DataFrame:
    """(pix, a, b, n) of frames in arrays."""
    cells = frames.with_probe(frames.placed(dense.long(batch, probe.shape[0]), scan, width), probe)
    p = cplx.pair("p_")
    re, im = cplx.conj_mul(p, cplx.pair())
    return cells.groupBy("pix").agg(F.sum(re).alias("a"), F.sum(im).alias("b"), F.sum(cplx.abs2(p)).alias("n"))


def accumulate(stream: DataFrame, scan: DataFrame, probe: np.ndarray, width: int, into: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream (fid, re, im); each batch writes its own folder of partial sums, so a batch that runs again replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        partial_sums(batch, scan, probe, width).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def image(partial: DataFrame) -> DataFrame:
    """(pix, re, im) of the partial sums so far."""
    total = partial.groupBy("pix").agg(*(F.sum(c).alias(c) for c in ("a", "b", "n")))
    return total.select("pix", F.try_divide("a", "n").alias("re"), F.try_divide("b", "n").alias("im"))
