"""Images as two-dimensional tiles, frames dealt to the tile in which they begin.

A tile (r, c) holds its pixels as arrays and is at least as wide as a frame, so a frame lies within
its own tile and the next ones to the right and below: its chunk's canvas. A chunk is a part of the
frames of one tile, small enough for one task; a tile that holds more frames has more chunks, each
with the canvas. Gathering cuts frames from canvases, scattering adds frames to them, in NumPy; what
is shuffled are whole tiles and whole frames, never rows of pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from phasemill.operators.dense import lists, stack

#: Pixels of a tile's side, at least; a frame's side if that is more.
SIDE = 32
#: Frames of a chunk: so many bytes of complex pixels, and so many frames, at most.
CHUNK_BYTES, CHUNK_FRAMES = 8_000_000, 1024
#: Tiles that a task sums up at a time before it sends them.
HELD = 64
_KEY = ["r", "c", "part"]
_BLOCK = "r int, c int, top int, left int, h int, w int, re array<double>, im array<double>, n array<double>"
TILE = "r int, c int, re array<double>, im array<double>, n array<double>"


@dataclass(frozen=True)
class Tiling:
    """Tiles of a square periodic image of `width` pixels a side for frames of n pixels a side; `count` tiles a side, each at least as wide as a frame where there are several."""

    width: int
    n: int
    side: int = SIDE

    @property
    def count(self) -> int:
        return max(1, self.width // max(self.n, self.side))

    def begin(self, k: int) -> int:
        return k * self.width // self.count

    def size(self, k: int) -> int:
        return self.begin(k + 1) - self.begin(k)

    def of(self, x: Column) -> Column:
        """The tile, along one axis, of a coordinate anywhere on the circle."""
        return F.floor(((F.pmod(x, F.lit(self.width)) + 1) * self.count - 1) / self.width).cast("int")

    def canvas(self, k: int) -> int:
        """Pixels along one axis that frames of a tile may cover."""
        return self.size(k) + self.n - 1

    def cut(self, k: int) -> list[tuple[int, int, int, int]]:
        """(tile, first pixel in it, first pixel of the canvas, pixels) of the parts of a canvas along one axis."""
        out, at, tile, inside = [], 0, k, 0
        while at < self.canvas(k):
            some = min(self.size(tile) - inside, self.canvas(k) - at)
            out.append((tile, inside, at, some))
            at, tile, inside = at + some, (tile + 1) % self.count, 0
        return out


def planned(scan: DataFrame, tiling: Tiling) -> DataFrame:
    """(fid, tx, ty, r, c, part): the chunk of each frame. Parts of a tile follow from its number of frames."""
    each = max(1, min(CHUNK_FRAMES, CHUNK_BYTES // (16 * tiling.n**2)))
    at = scan.select("fid", "tx", "ty", tiling.of(F.col("ty")).alias("r"), tiling.of(F.col("tx")).alias("c"))
    parts = at.groupBy("r", "c").agg(F.ceil(F.count("*") / each).cast("long").alias("parts"))
    return at.join(parts, ["r", "c"]).select("fid", "tx", "ty", "r", "c", F.pmod(F.xxhash64("fid"), F.col("parts")).cast("int").alias("part"))


def tiled(image: DataFrame, tiling: Tiling, values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """(r, c, re, im, n): an image (pix and values) as tiles. Pixels without a row, or null, are NaN; n is empty unless it is one of the values, re and im likewise."""
    y, x = F.expr(f"pix div {tiling.width}"), F.col("pix") % tiling.width
    rows = image.select(tiling.of(y).alias("r"), tiling.of(x).alias("c"), y.cast("int").alias("y"), x.cast("int").alias("x"), *(F.col(v).cast("double").alias(v) for v in values))

    def pack(group: pa.Table) -> pa.Table:
        r, c = group.column("r")[0].as_py(), group.column("c")[0].as_py()
        shape = (tiling.size(r), tiling.size(c))
        at = group.column("y").to_numpy() - tiling.begin(r), group.column("x").to_numpy() - tiling.begin(c)
        out = {}
        for name in ("re", "im", "n"):
            dense = np.zeros((1, 0))
            if name in values:
                dense = np.full((1, shape[0] * shape[1]), np.nan)
                dense.reshape(shape)[at] = group.column(name).to_numpy()
            out[name] = lists(dense)
        return pa.table({"r": pa.array([r], pa.int32()), "c": pa.array([c], pa.int32()), **out})

    return rows.groupBy("r", "c").applyInArrow(pack, TILE)


def pixels(tiles: DataFrame, tiling: Tiling, *values: str) -> DataFrame:
    """(pix and values) of the pixels of tiles that aren't NaN; values of re, im, n."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r, c = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                y, x = np.indices((tiling.size(r), tiling.size(c)))
                pix = ((y + tiling.begin(r)) * tiling.width + x + tiling.begin(c)).ravel()
                found = [batch.column(2 + v)[k].values.to_numpy() for v in range(len(values))]
                seen = ~np.isnan(found[0])
                yield pa.RecordBatch.from_arrays([pa.array(pix[seen]), *(pa.array(f[seen]) for f in found)], names=["pix", *values])

    return tiles.select("r", "c", *values).mapInArrow(unpack, "pix long, " + ", ".join(f"{v} double" for v in values))


def chunks(plan: DataFrame, tiling: Tiling) -> DataFrame:
    """(r, c, part, tr, tc): the tiles, four at most, on the canvas of each chunk."""
    ahead = lambda c: F.array_distinct(F.array(F.col(c), F.pmod(F.col(c) + 1, F.lit(tiling.count))))
    return plan.select(*_KEY).distinct().withColumn("tr", F.explode(ahead("r"))).withColumn("tc", F.explode(ahead("c")))


def on_chunks(rows: DataFrame, tiles: DataFrame, of: DataFrame, tiling: Tiling, work: Callable[..., Iterator[pa.Table] | pa.Table], schema: str, values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """work(rows of a chunk, its place, canvases of the values) for all chunks. rows: of a plan, with more columns; of: chunks of the plan."""
    asked = tiles.select(F.col("r").alias("tr"), F.col("c").alias("tc"), *values).join(of.toDF("of_r", "of_c", "of_part", "tr", "tc"), ["tr", "tc"])

    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a chunk of which no row is given
            return nothing
        r, c = left.column("r")[0].as_py(), left.column("c")[0].as_py()
        found = {(a, b): k for k, (a, b) in enumerate(zip(right.column("tr").to_pylist(), right.column("tc").to_pylist(), strict=True))}
        out = [np.zeros((tiling.canvas(r), tiling.canvas(c))) for _ in values]
        for tr, y0, cy, h in tiling.cut(r):
            for tc, x0, cx, w in tiling.cut(c):
                k = found.get((tr, tc))  # a tile without any pixel has no row
                for v, name in enumerate(values):
                    if k is not None:
                        tile = right.column(name)[k].values.to_numpy().reshape(tiling.size(tr), tiling.size(tc))
                        out[v][cy : cy + h, cx : cx + w] = np.nan_to_num(tile[y0 : y0 + h, x0 : x0 + w])
        return work(left, Place(tiling, r, c, left), *out)

    return rows.groupBy(*_KEY).cogroup(asked.groupBy("of_r", "of_c", "of_part")).applyInArrow(run, schema)


class Place:
    """Where the frames of a chunk lie on its canvas."""

    def __init__(self, tiling: Tiling, r: int, c: int, rows: pa.Table) -> None:
        self.tiling, self.r, self.c = tiling, r, c
        self.y = np.mod(rows.column("ty").to_numpy(), tiling.width) - tiling.begin(r)
        self.x = np.mod(rows.column("tx").to_numpy(), tiling.width) - tiling.begin(c)

    def windows(self, canvas: np.ndarray) -> np.ndarray:
        """The part of a canvas that each frame covers."""
        n = np.arange(self.tiling.n)
        return canvas[(self.y[:, None] + n)[:, :, None], (self.x[:, None] + n)[:, None, :]]

    def summed(self, frames: np.ndarray) -> np.ndarray:
        """The canvas on which all frames are added; one frame for all adds it at each place."""
        n = self.tiling.n
        out = np.zeros((self.tiling.canvas(self.r), self.tiling.canvas(self.c)), dtype=frames.dtype)
        for k, (y, x) in enumerate(zip(self.y.tolist(), self.x.tolist(), strict=True)):
            out[y : y + n, x : x + n] += frames if frames.ndim == 2 else frames[k]
        return out

    def blocks(self, total: np.ndarray | None, weight: np.ndarray | None) -> dict[str, pa.Array]:
        """The parts of canvases by tile; columns of _BLOCK."""
        rows: list[tuple] = []
        for tr, y0, cy, h in self.tiling.cut(self.r):
            for tc, x0, cx, w in self.tiling.cut(self.c):
                part = (slice(cy, cy + h), slice(cx, cx + w))
                rows.append((tr, tc, y0, x0, h, w, *(np.zeros(0) if v is None else v[part].ravel() for v in (None if total is None else total.real, None if total is None else total.imag, weight))))
        columns = list(zip(*rows, strict=True))
        return {name: pa.array(v, pa.int32()) for name, v in zip(("r", "c", "top", "left", "h", "w"), columns, strict=False)} | {name: pa.array(list(v), pa.list_(pa.float64())) for name, v in zip(("re", "im", "n"), columns[6:], strict=True)}


def merged(blocks: DataFrame, tiling: Tiling) -> DataFrame:
    """(r, c, re, im, n): blocks added up by tile; one row for each tile and task is shuffled, and added as it comes."""

    def flush(held: dict) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32())]
        columns += [pa.array([v[i].ravel() for v in held.values()], pa.list_(pa.float64())) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["r", "c", "re", "im", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            r, c, top, left, h, w = (batch.column(k).to_pylist() for k in range(6))
            for k in range(batch.num_rows):
                key = (r[k], c[k])
                if key not in held:
                    if len(held) >= HELD:
                        yield flush(held)
                        held.clear()
                    held[key] = [np.zeros((tiling.size(key[0]), tiling.size(key[1])) if len(batch.column(6 + v)[k]) else 0) for v in range(3)]
                for v, total in enumerate(held[key]):
                    if total.size:
                        total[top[k] : top[k] + h[k], left[k] : left[k] + w[k]] += batch.column(6 + v)[k].values.to_numpy().reshape(h[k], w[k])
        if held:
            yield flush(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            r, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                values = [batch.column(2 + v)[k].values.to_numpy() for v in range(3)]
                if (r[k], c[k]) in held:
                    for own, more in zip(held[r[k], c[k]], values, strict=True):
                        own += more
                else:
                    if held:  # rows are in order of tiles
                        yield flush(held)
                    held = {(r[k], c[k]): [v.copy() for v in values]}
        if held:
            yield flush(held)

    partial = blocks.select("r", "c", "top", "left", "h", "w", "re", "im", "n").mapInArrow(add, TILE)
    return partial.repartition("r", "c").sortWithinPartitions("r", "c").mapInArrow(total, TILE)


def gathered(plan: DataFrame, tiles: DataFrame, tiling: Tiling) -> DataFrame:
    """(fid, re, im): each frame's window of an image in tiles, as arrays."""

    def work(rows: pa.Table, at: Place, re: np.ndarray, im: np.ndarray) -> pa.Table:
        return pa.table({"fid": rows.column("fid"), "re": lists(at.windows(re)), "im": lists(at.windows(im))})

    return on_chunks(plan, tiles, chunks(plan, tiling), tiling, work, "fid long, re array<double>, im array<double>")


def scattered(frames: DataFrame, plan: DataFrame, tiling: Tiling, probe: np.ndarray | None = None) -> DataFrame:
    """Tiles of the sum of frames (fid, re, im; arrays) over the pixels they cover, with a probe of conj(probe) * frame and of |probe|^2 as n; frames without a place are left out."""
    return placed_sum(plan.join(frames, "fid"), tiling, probe)


def placed_sum(rows: DataFrame, tiling: Tiling, probe: np.ndarray | None = None) -> DataFrame:
    """scattered, of rows that have a plan's columns."""

    def work(rows: pa.Table) -> pa.Table:
        at = Place(tiling, rows.column("r")[0].as_py(), rows.column("c")[0].as_py(), rows)
        f = stack(rows.column("re"), tiling.n) + 1j * stack(rows.column("im"), tiling.n)
        if probe is None:
            return pa.table(at.blocks(at.summed(f), at.summed(np.ones((tiling.n, tiling.n)))))
        return pa.table(at.blocks(at.summed(np.conj(probe) * f), at.summed(np.abs(probe) ** 2)))

    return merged(rows.groupBy(*_KEY).applyInArrow(work, _BLOCK), tiling)


def normalization(plan: DataFrame, tiling: Tiling, probe: np.ndarray) -> DataFrame:
    """Tiles whose n is the sum of the probe's squared modulus; from the places of frames alone."""

    def work(rows: pa.Table) -> pa.Table:
        at = Place(tiling, rows.column("r")[0].as_py(), rows.column("c")[0].as_py(), rows)
        return pa.table(at.blocks(None, at.summed(np.abs(probe) ** 2)))

    return merged(plan.groupBy(*_KEY).applyInArrow(work, _BLOCK), tiling)


def divided(tiles: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Tiles of re / n and im / n, NaN where n is 0; n from the tiles themselves, or from others."""
    if by is not None:
        tiles = tiles.drop("n").join(by.select("r", "c", "n"), ["r", "c"])
    part = lambda c: F.zip_with(c, "n", lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float("nan")))).alias(c)
    return tiles.select("r", "c", part("re"), part("im"), "n")


def covered(tiles: DataFrame) -> DataFrame:
    """Tiles of sums with NaN where n is 0, where no frame lies."""
    part = lambda c: F.zip_with(c, "n", lambda a, b: F.when(b == 0, float("nan")).otherwise(a)).alias(c)
    return tiles.select("r", "c", *(F.when(F.size(k) > 0, part(k)).otherwise(F.col(k)).alias(k) for k in ("re", "im")), part("n"))


def sparse_rows(plan: DataFrame, tiling: Tiling) -> DataFrame:
    """The overlap matrix in blocks of compressed sparse rows, one a chunk: (r, c, part, fids, starts, entries).

    Row p of a block is pixel p of the chunk's canvas; its entries, from starts[p] on, are the places
    of what is added there among the chunk's frame pixels, in order of fids. Made once for a scan.
    """

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("fid")
        r, c = rows.column("r")[0].as_py(), rows.column("c")[0].as_py()
        at = Place(tiling, r, c, rows)
        pixel = at.windows(np.arange(tiling.canvas(r) * tiling.canvas(c)).reshape(tiling.canvas(r), tiling.canvas(c))).ravel()
        entries = np.argsort(pixel, kind="stable")
        starts = np.searchsorted(pixel[entries], np.arange(tiling.canvas(r) * tiling.canvas(c) + 1))
        one = lambda v, kind: pa.array([v], pa.list_(kind))
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in _KEY}, "fids": one(rows.column("fid").to_numpy(), pa.int64()), "starts": one(starts, pa.int32()), "entries": one(entries, pa.int32())})

    return plan.groupBy(*_KEY).applyInArrow(work, "r int, c int, part int, fids array<long>, starts array<int>, entries array<int>")


def multiplied(matrix: DataFrame, frames: DataFrame, plan: DataFrame, tiling: Tiling) -> DataFrame:
    """Tiles of the sparse overlap matrix times frames (fid, re, im; arrays), all of the plan's."""

    def work(rows: pa.Table, matrix: pa.Table) -> pa.Table:
        if not matrix.num_rows:
            raise ValueError("the matrix is that of another plan")
        rows = rows.sort_by("fid")
        if rows.column("fid").to_pylist() != matrix.column("fids")[0].as_py():
            raise ValueError("frames are missing, or there are too many")
        starts, entries = (matrix.column(k)[0].values.to_numpy() for k in ("starts", "entries"))
        r, c = rows.column("r")[0].as_py(), rows.column("c")[0].as_py()
        at = Place(tiling, r, c, rows)
        values = (stack(rows.column("re"), tiling.n) + 1j * stack(rows.column("im"), tiling.n)).ravel()[entries]
        some = np.flatnonzero(np.diff(starts))
        total = np.zeros(len(starts) - 1, dtype=np.complex128)
        total[some] = np.add.reduceat(values, starts[some]) if len(some) else 0
        shape = (tiling.canvas(r), tiling.canvas(c))
        return pa.table(at.blocks(total.reshape(shape), np.diff(starts).astype(np.float64).reshape(shape)))

    return merged(plan.join(frames, "fid").groupBy(*_KEY).cogroup(matrix.groupBy(*_KEY)).applyInArrow(work, _BLOCK), tiling)
