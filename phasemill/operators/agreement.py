"""Phases in agreement from the bottom up: within cells of neighbouring frames, then among cells, level by level.

Products with a Hermitian matrix carry phases only from frame to frame, so an eigenvector from a
start without them takes as many more products as the scan is wide. Here each cell solves its own
small problem in a task, a cell is one node of the next level, and the matrix among nodes is what
the cells' vectors leave of the one below. Levels shrink by GROUP; nothing but the last one, of
LIMIT nodes at most, is in one task as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.functions import cplx

#: Nodes of a cell, about, and of one task's problem, at most; a fuller cell is several.
GROUP, LIMIT = 64, 256


def cells(plan: DataFrame, width: int) -> DataFrame:
    """(fid, cy, cx): square cells of a periodic scan (fid, tx, ty), of about GROUP frames each."""
    across = max(1, math.ceil(math.sqrt(plan.count() / GROUP)))
    at = lambda c: F.floor(F.pmod(F.col(c), F.lit(width)) * across / width).cast("long")
    return plan.select("fid", at("ty").alias("cy"), at("tx").alias("cx"))


def labelled(nodes: DataFrame) -> DataFrame:
    """nodes (node, size, cy, cx) with their group, named by its first node, and their share of its norm."""
    parts = nodes.groupBy("cy", "cx").agg(F.ceil(F.count("*") / LIMIT).cast("long").alias("parts"))
    dealt = nodes.join(parts, ["cy", "cx"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    groups = dealt.groupBy("cy", "cx", "part").agg(F.min("node").alias("group"), F.sqrt(F.sum(F.col("size") * F.col("size"))).alias("whole"))
    share = F.coalesce(F.try_divide("size", "whole"), F.lit(0.0)).alias("share")
    return dealt.join(groups, ["cy", "cx", "part"]).select("node", "group", "whole", share, "cy", "cx")


def _leading(rows: pa.Table) -> pa.Table:
    """Phases of the leading eigenvector of one group's matrix."""
    i, j, re, im = (rows.column(c).to_numpy() for c in ("i", "j", "re", "im"))
    names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    matrix = np.zeros((len(names), len(names)), dtype=np.complex128)
    np.add.at(matrix, (at[: len(i)], at[len(i) :]), np.nan_to_num(re) + 1j * np.nan_to_num(im))
    values, vectors = np.linalg.eigh((matrix + matrix.conj().T) / 2)
    v = vectors[:, np.argmax(np.abs(values))]
    phase = np.divide(v, np.abs(v), out=np.ones_like(v), where=np.abs(v) > 0)
    return pa.table({"node": names, "p_re": phase.real, "p_im": phase.imag})


def aligned(h: DataFrame, start: DataFrame, at: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The moduli of start (fid, re, im), with phases in which a Hermitian h (i, j, re, im; both triangles) lets them agree; at: cells.

    Where h has an eigenvector of these moduli that no other value outweighs, as the Gram matrix of
    consistent frames has, this is that vector; else a start near it. Frames without an entry in h
    keep a phase of 1.
    """
    size = F.sqrt(cplx.abs2(cplx.pair()))
    nodes, matrix, levels = start.select(F.col("fid").alias("node"), F.coalesce(size, F.lit(0.0)).alias("size")).join(at.withColumnRenamed("fid", "node"), "node"), h, []
    found_in = "node long, p_re double, p_im double"
    phases = [F.coalesce("p_re", F.lit(1.0)).alias("p_re"), F.coalesce("p_im", F.lit(0.0)).alias("p_im")]
    while True:
        label = keep(labelled(nodes))
        own = lambda s: label.select(F.col("node").alias(s), F.col("group").alias(f"g{s}"))  # noqa: B023, E731
        within = matrix.select("i", "j", "re", "im").join(own("i"), "i").join(own("j"), "j").filter("gi = gj").select("gi", "i", "j", "re", "im")
        level = keep(label.join(within.groupBy("gi").applyInArrow(_leading, found_in), "node", "left").select("node", "group", "share", *phases))
        levels.append(level)
        groups = label.groupBy("group").agg(F.first("whole").alias("size"), F.first("cy").alias("cy"), F.first("cx").alias("cx")).withColumnRenamed("group", "node")
        count = groups.count()
        if count <= 1:
            found = levels.pop().select("node", "p_re", "p_im")
            break
        side = lambda s: level.select(F.col("node").alias(s), F.col("group").alias(f"g{s}"), (F.col("p_re") * F.col("share")).alias(f"{s}_re"), (F.col("p_im") * F.col("share")).alias(f"{s}_im"))  # noqa: B023, E731
        re, im = cplx.conj_mul(cplx.pair("i_"), cplx.mul(cplx.pair(), cplx.pair("j_")))
        turned = matrix.select("i", "j", "re", "im").join(side("i"), "i").join(side("j"), "j")
        matrix = turned.groupBy(F.col("gi").alias("i"), F.col("gj").alias("j")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
        if count <= LIMIT:
            found = groups.select("node").join(matrix.groupBy().applyInArrow(_leading, found_in), "node", "left").select("node", *phases)
            break
        matrix = keep(matrix)
        nodes = groups.withColumns({c: F.expr(f"{c} div 8") for c in ("cy", "cx")})
    while levels:
        above = found.select(F.col("node").alias("group"), F.col("p_re").alias("a_re"), F.col("p_im").alias("a_im"))
        re, im = cplx.mul(cplx.pair("p_"), cplx.pair("a_"))
        found = levels.pop().join(above, "group").select("node", re.alias("p_re"), im.alias("p_im"))
    both = start.select("fid", F.coalesce(size, F.lit(0.0)).alias("size")).join(found.withColumnRenamed("node", "fid"), "fid", "left")
    return keep(both.select("fid", (F.col("size") * F.coalesce("p_re", F.lit(1.0))).alias("re"), (F.col("size") * F.coalesce("p_im", F.lit(0.0))).alias("im")))
