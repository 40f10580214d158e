"""The registered queries over the ptychographic operators, with the SQL of each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.functions import cplx
from phasemill.operators import dense, frames, geometry, gram, krylov, prox, solvers, tiles
from phasemill.sources import frame_files
from phasemill.sources.bridge import N, Setup, setup
from phasemill.sources.store import folder, kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the SQL side, by the same names as in Setup.
_BASE = """
WITH size AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS nnx FROM embeddings),
scan AS MATERIALIZED (SELECT vec_id AS fid, CAST(5 * (vec_id % nnx) + 2 * ((vec_id // nnx + 1) % 2) AS BIGINT) AS tx, CAST(5 * (vec_id // nnx) AS BIGINT) AS ty FROM embeddings, size),
ext AS MATERIALIZED (SELECT CAST(ceil(max(tx) - min(tx)) AS BIGINT) AS w FROM scan),
g AS MATERIALIZED (SELECT CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x FROM range(64) t(i)),
mapid AS (SELECT fid, y, x, ((ty + y) % w) * w + (tx + x) % w AS pix FROM scan, g, ext),
cells AS (SELECT vec_id AS fid, y, x, CAST(embedding[8 * y + x + 1] AS DOUBLE) AS re, CAST(embedding[64 - 8 * y - x] AS DOUBLE) AS im FROM embeddings, g),
image AS (SELECT y * w + x AS pix, y, x, exp(-0.69 * v) * cos(0.345 * v) AS re, exp(-0.69 * v) * sin(0.345 * v) AS im
  FROM (SELECT vec_id AS y, x, w, CAST(embedding[x % 64 + 1] AS DOUBLE) AS v FROM embeddings, ext, range(w) t(x) WHERE vec_id < w)),
freq AS (SELECT y, x, (y + 4) % 8 - 4 AS fy, (x + 4) % 8 - 4 AS fx FROM g),
lit AS (SELECT y AS v, x AS u, cos(pi() * (20 * (fy / 8.0) ** 2 - 20 * (fx / 8.0) ** 2)) AS re, sin(pi() * (20 * (fy / 8.0) ** 2 - 20 * (fx / 8.0) ** 2)) AS im FROM freq WHERE sqrt(fy * fy + fx * fx) BETWEEN 0.8 AND 2.4),
raw AS (SELECT (y + 4) % 8 AS y, (x + 4) % 8 AS x, sum(re * cos(2 * pi() * (v * y + u * x) / 8) - im * sin(2 * pi() * (v * y + u * x) / 8)) AS re, sum(re * sin(2 * pi() * (v * y + u * x) / 8) + im * cos(2 * pi() * (v * y + u * x) / 8)) AS im FROM lit, g GROUP BY ALL),
probe AS MATERIALIZED (SELECT y, x, re / m AS re, im / m AS im FROM raw, (SELECT max(sqrt(re * re + im * im)) AS m FROM raw)),
omega AS (SELECT fid, cos(2 * pi() * ((fid * 37) % 101) / 101) AS re, sin(2 * pi() * ((fid * 37) % 101) / 101) AS im FROM scan)"""


def _dft(name: str, source: str, sign: int = -1) -> str:
    """Common tables that transform `source` (fid, y, x, re, im) along x, then y."""
    s, scale = ("+" if sign > 0 else "-"), (" / 64" if sign > 0 else "")
    turn = lambda a, b: f"({s}2 * pi() * ({a} * {b}) / 8)"
    return f"""
{name}_x AS (SELECT fid, f.y, k.x, sum(re * cos{turn("f.x", "k.x")} - im * sin{turn("f.x", "k.x")}) AS re, sum(re * sin{turn("f.x", "k.x")} + im * cos{turn("f.x", "k.x")}) AS im FROM {source} f, (SELECT DISTINCT x FROM g) k GROUP BY fid, f.y, k.x),
{name} AS MATERIALIZED (SELECT fid, k.y, f.x, sum(re * cos{turn("f.y", "k.y")} - im * sin{turn("f.y", "k.y")}){scale} AS re, sum(re * sin{turn("f.y", "k.y")} + im * cos{turn("f.y", "k.y")}){scale} AS im FROM {name}_x f, (SELECT DISTINCT y FROM g) k GROUP BY fid, k.y, f.x)"""


_WAVES = """
waves AS MATERIALIZED (SELECT fid, y, x, p.re * i.re - p.im * i.im AS re, p.re * i.im + p.im * i.re AS im FROM mapid JOIN (SELECT pix, re, im FROM image) i USING (pix) JOIN probe p USING (y, x))"""
_DATA = _WAVES + "," + _dft("spectrum", "waves") + """,
data AS MATERIALIZED (SELECT fid, y, x, re * re + im * im AS intensity FROM spectrum)"""


def _round(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _query(sql: str, tables: str = ""):
    def add(f: Callable[[Setup], DataFrame]) -> Callable[[Setup], DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(setup(spark, sf_dir))
        ORACLES[name] = _BASE + ("," + tables if tables else "") + "\n" + sql
        return f

    return add


def _long(f: DataFrame) -> DataFrame:
    return _rounded(dense.long(f, N), "re", "im")


def _waves(s: Setup) -> DataFrame:
    """Exit waves of the true image, as arrays."""
    return solvers.exit_waves(s.image, s.scan, s.probe, s.width)


def _projected(s: Setup, f: DataFrame) -> DataFrame:
    """The image that frames in arrays add up to."""
    return tiles.pixels(tiles.divided(tiles.scattered(f, s.plan, s.tiling, s.probe)), s.tiling, "re", "im")


def _gram(s: Setup, border: int = 0) -> DataFrame:
    """The Gram matrix of the frames with themselves."""
    plan = kept(s.plan)
    rows = plan.join(s.frames, "fid")
    return gram.tiled_gram(gram.both_sides(rows), gram.chunk_pairs(plan, s.tiling), s.tiling, border, both=True)


def _preconditioned(s: Setup, border: int = 0) -> DataFrame:
    return gram.scaled(_gram(s, border), gram.inverse_norms(s.frames, N, border))


def _spun(s: Setup) -> tuple[gram.Synchronizer, DataFrame]:
    """A synchronizer of the scan, and the exit waves turned by the planted phases, with their chunks."""
    sync = gram.Synchronizer.of_scan(s.scan, s.probe, s.width, kept, steps=_STEPS)
    w = s.omega.select("fid", F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    turn = lambda a, b, sign: F.zip_with(a, b, lambda x, y: x * F.col("w_re") + sign * (y * F.col("w_im")))
    waves = dense.illuminate(tiles.gathered(sync.plan, tiles.tiled(s.image, s.tiling), s.tiling), s.probe).join(w, "fid").select("fid", turn("re", "im", -1).alias("re"), turn("im", "re", 1).alias("im"))
    return sync, kept(sync.plan.join(waves, "fid"))


def _data(s: Setup) -> DataFrame:
    return dense.intensities(_waves(s), N)


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM cells WHERE fid >= 7")
def frames_written_and_read(s: Setup) -> DataFrame:
    """All frames to files of fid ranges, and those from 7 on back."""
    frame_files.register(s.spark)
    path = f"{folder(s.spark)}/frames-{uuid.uuid4().hex}"
    s.frames.repartitionByRange("fid").write.format("frames").mode("append").save(path)
    return _long(s.spark.read.format("frames").load(path).filter("fid >= 7"))


@_query("SELECT fid, tx, ty FROM scan")
def make_translations(s: Setup) -> DataFrame:
    return s.scan


@_query("SELECT fid, y, x, pix FROM mapid")
def map_frames(s: Setup) -> DataFrame:
    return s.pixels


@_query("SELECT w AS width FROM ext")
def image_extent(s: Setup) -> DataFrame:
    return geometry.extent(s.scan)


@_query(f"SELECT pix, y, x, {_round('re', 'im')} FROM image")
def object_transform(s: Setup) -> DataFrame:
    return _rounded(s.image, "re", "im")


@_query("SELECT fid, round(tx * 0.1 * 1600 / (8 * 100.0), 6) + 0.0 AS tx, round(ty * 0.1 * 1600 / (8 * 100.0), 6) + 0.0 AS ty FROM scan")
def scaled_translations(s: Setup) -> DataFrame:
    r = geometry.resolution(0.1, 1600.0, N, 100.0)
    return _rounded(s.scan.withColumns({c: F.col(c) * r for c in ("tx", "ty")}), "tx", "ty")


@_query(f"SELECT y - a AS y, x - a AS x, {_round('re', 'im')} FROM image, (SELECT w // 2 - (w // 2) // 2 AS a, w // 2 AS size FROM ext) WHERE y >= a AND y < a + size AND x >= a AND x < a + size")
def crop_center(s: Setup) -> DataFrame:
    return _rounded(geometry.crop_center(s.image, s.width, s.width // 2), "re", "im").select("y", "x", "re", "im")


@_query(f"SELECT y - a AS y, x - a AS x, {_round('re', 'im')} FROM image, (SELECT (w - w // 3) // 2 AS a, w // 3 AS size FROM ext) WHERE y >= a AND y < a + size AND x >= a AND x < a + size")
def crop_to_size(s: Setup) -> DataFrame:
    return _rounded(geometry.crop_to(s.image, s.width, s.width // 3), "re", "im").select("y", "x", "re", "im")


@_query(f"SELECT fid, (y + 4) % 8 AS y, (x + 4) % 8 AS x, {_round('re', 'im')} FROM cells")
def fftshift(s: Setup) -> DataFrame:
    return _rounded(geometry.shifted(s.cells, N), "re", "im")


@_query(f"SELECT fid, (y + 4) % 8 AS y, (x + 4) % 8 AS x, {_round('re', 'im')} FROM cells")
def ifftshift(s: Setup) -> DataFrame:
    return _rounded(geometry.shifted(s.cells, N, inverse=True), "re", "im")


@_query(f"SELECT fid, m.y, m.x, {_round('re', 'im')} FROM mapid m JOIN image USING (pix)")
def split(s: Setup) -> DataFrame:
    return _long(tiles.gathered(s.plan, tiles.tiled(s.image, s.tiling), s.tiling))


@_query("SELECT pix, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im FROM cells JOIN mapid USING (fid, y, x) GROUP BY pix")
def overlap(s: Setup) -> DataFrame:
    return _rounded(tiles.pixels(tiles.covered(tiles.scattered(s.frames, s.plan, s.tiling)), s.tiling, "re", "im"), "re", "im")


@_query("SELECT pix, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im FROM cells JOIN mapid USING (fid, y, x) GROUP BY pix")
def overlap_matvec(s: Setup) -> DataFrame:
    """By the sparse matrix of the scan, made once."""
    matrix = kept(tiles.sparse_rows(s.plan, s.tiling))
    return _rounded(tiles.pixels(tiles.covered(tiles.multiplied(matrix, s.frames, s.plan, s.tiling)), s.tiling, "re", "im"), "re", "im")


@_query("SELECT pix, round(sum(re * re + im * im), 6) + 0.0 AS n FROM mapid JOIN probe USING (y, x) GROUP BY pix")
def normalization(s: Setup) -> DataFrame:
    return _rounded(tiles.pixels(tiles.covered(tiles.normalization(s.plan, s.tiling, s.probe)), s.tiling, "n"), "n")


_PROJECTED = "SELECT pix, sum(p.re * f.re + p.im * f.im) / sum(p.re * p.re + p.im * p.im) AS re, sum(p.re * f.im - p.im * f.re) / sum(p.re * p.re + p.im * p.im) AS im FROM {0} f JOIN mapid USING (fid, y, x) JOIN probe p USING (y, x) GROUP BY pix"


@_query(f"SELECT pix, {_round('re', 'im')} FROM ({_PROJECTED.format('cells')})")
def overlap_projection(s: Setup) -> DataFrame:
    return _rounded(_projected(s, s.frames), "re", "im")


@_query("SELECT fid, y, x, round(p.re * f.re - p.im * f.im, 6) + 0.0 AS re, round(p.re * f.im + p.im * f.re, 6) + 0.0 AS im FROM cells f JOIN probe p USING (y, x)")
def illuminate(s: Setup) -> DataFrame:
    return _rounded(frames.illuminated(s.cells, s.probe), "re", "im")


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM scan, probe")
def replicate_frame(s: Setup) -> DataFrame:
    return _rounded(frames.replicated(s.scan, s.probe), "re", "im")


@_query("SELECT y, x, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im FROM cells GROUP BY y, x")
def sum_frames(s: Setup) -> DataFrame:
    return _rounded(frames.frame_sum(s.cells), "re", "im")


@_query("SELECT fid, y, x, round(o.re * f.re - o.im * f.im, 6) + 0.0 AS re, round(o.re * f.im + o.im * f.re, 6) + 0.0 AS im FROM cells f JOIN omega o USING (fid)")
def stack_frames(s: Setup) -> DataFrame:
    return _rounded(frames.stacked(s.cells, s.omega), "re", "im")


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM f", _dft("f", "cells"))
def propagate(s: Setup) -> DataFrame:
    return _long(dense.propagate(s.frames, N))


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM f", _dft("f", "cells", 1))
def back_propagate(s: Setup) -> DataFrame:
    return _long(dense.back_propagate(s.frames, N))


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM f_x", _dft("f", "cells"))
def fft1d(s: Setup) -> DataFrame:
    return _long(dense.rows_transformed(s.frames, N))


@_query("SELECT fid, y, x, round(re / 8, 6) + 0.0 AS re, round(im / 8, 6) + 0.0 AS im FROM f_x", _dft("f", "cells", 1))
def ifft1d(s: Setup) -> DataFrame:
    return _long(dense.rows_transformed(s.frames, N, inverse=True))


_LENS = _dft("hat", "(SELECT 0 AS fid, * FROM probe)") + """,
lens AS (SELECT y, x, sqrt(re * re + im * im) / m > 0.1 AS mask FROM hat, (SELECT max(sqrt(re * re + im * im)) AS m FROM hat))"""


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM back", _LENS + "," + _dft("f", "cells") + ", cut AS (SELECT fid, y, x, f.re * CAST(mask AS INT) AS re, f.im * CAST(mask AS INT) AS im FROM f JOIN lens USING (y, x))," + _dft("back", "cut", 1))
def lens_filter(s: Setup) -> DataFrame:
    return _long(dense.filtered(s.frames, dense.aperture(s.probe)))


@_query("SELECT fid, y, x, sqrt(re * re + im * im) / m > 0.1 AS mask FROM f JOIN (SELECT fid, max(sqrt(re * re + im * im)) AS m FROM f GROUP BY fid) USING (fid) WHERE abs(sqrt(re * re + im * im) / m - 0.1) > 1e-9", _dft("f", "cells"))
def lens_aperture(s: Setup) -> DataFrame:
    """Frequencies of each frame above a tenth of its largest; those on the limit to 1e-9 are left out."""
    cells = dense.long(dense.propagate(s.frames, N), N)
    size = F.sqrt(cplx.abs2(cplx.pair()))
    top = cells.groupBy("fid").agg(F.max(size).alias("m"))
    share = F.try_divide(size, F.col("m"))
    return cells.join(top, "fid").filter(F.abs(share - 0.1) > 1e-9).select("fid", "y", "x", (share > 0.1).alias("mask"))


@_query(f"SELECT fid, y, x, {_round('intensity')} FROM data", _DATA)
def simulate_intensity(s: Setup) -> DataFrame:
    cells = _data(s).select("fid", F.posexplode("intensity").alias("i", "intensity"))
    return _rounded(cells.select("fid", F.expr(f"bigint(i div {N})").alias("y"), F.expr(f"bigint(i % {N})").alias("x"), "intensity"), "intensity")


_PROX = "SELECT fid, y, x, f.re * sqrt((intensity + 0.01) / (f.re * f.re + f.im * f.im + 0.01)) AS re, f.im * sqrt((intensity + 0.01) / (f.re * f.re + f.im * f.im + 0.01)) AS im FROM {0} f JOIN data USING (fid, y, x)"


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM ({_PROX.format('cells')})", _DATA)
def prox_data(s: Setup) -> DataFrame:
    return _long(prox.prox_data(s.frames, _data(s), N))


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM ({_PROX.format('cells')})", _DATA)
def prox_data_reciprocal(s: Setup) -> DataFrame:
    return _long(prox.prox_data_reciprocal(s.frames, _data(s), N))


_FITTED = _DATA + "," + _dft("f", "cells") + f", fit AS ({_PROX.format('f')})," + _dft("back", "fit", 1)


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM back", _FITTED)
def project_data_reciprocal(s: Setup) -> DataFrame:
    return _long(prox.project_data_reciprocal(s.frames, _data(s), N))


@_query("SELECT round(sqrt(sum((f.re - sqrt(intensity + 0.01)) ** 2 + f.im ** 2)), 6) + 0.0 AS r FROM f JOIN data USING (fid, y, x)", _DATA + "," + _dft("f", "cells"))
def reciprocal_residual(s: Setup) -> DataFrame:
    return _rounded(prox.reciprocal_residual(s.frames, _data(s), N), "r")


@_query(f"SELECT fid, y, x, {_round('re', 'im')} FROM back", _DATA + "," + _dft("f", "cells") + f", fit AS ({_PROX.format('f')})," + _dft("back", "fit", 1))
def project_data(s: Setup) -> DataFrame:
    return _long(prox.project_data(s.frames, _data(s), N))


@_query("SELECT round(sqrt(sum((sqrt(f.re * f.re + f.im * f.im) - sqrt(intensity)) ** 2)), 6) + 0.0 AS r FROM f JOIN data USING (fid, y, x)", _DATA + "," + _dft("f", "cells"))
def data_residual(s: Setup) -> DataFrame:
    return _rounded(prox.data_residual(s.frames, _data(s), N), "r")


_WRAP = "-({0} + w * (CASE WHEN {0} < -w / 2.0 THEN 1 WHEN {0} > w / 2.0 THEN -1 ELSE 0 END))"
_PAIRS = f"""
pairs AS MATERIALIZED (SELECT i, j, dx, dy FROM (SELECT a.fid AS i, b.fid AS j, {_WRAP.format("(b.tx - a.tx)")} AS dx, {_WRAP.format("(b.ty - a.ty)")} AS dy FROM scan a JOIN scan b ON a.fid <= b.fid, ext) WHERE abs(dx) < 8 AND abs(dy) < 8)"""
_GRAM = """
SELECT i, j, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im
FROM pairs JOIN {0} a ON a.fid = i JOIN {1} b ON b.fid = j AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY i, j"""
_FULL = """
upper AS MATERIALIZED ({0}),
h AS MATERIALIZED (SELECT i, j, re, im FROM upper UNION ALL SELECT j, i, re, -im FROM upper WHERE i < j),
d AS (SELECT fid, 1 / sqrt(sum(re * re + im * im)) AS d FROM {1} GROUP BY fid),
dhd AS MATERIALIZED (SELECT i, j, re * a.d * b.d AS re, im * a.d * b.d AS im FROM h JOIN d a ON a.fid = i JOIN d b ON b.fid = j)"""


@_query("SELECT i, j, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy FROM pairs", _PAIRS)
def gram_pairs(s: Setup) -> DataFrame:
    return gram.pairs(s.scan, N, s.width)


@_query(f"SELECT i, j, {_round('re', 'im')} FROM h", _PAIRS + "," + _FULL.format(_GRAM.format("cells", "cells"), "cells"))
def gram_matrix(s: Setup) -> DataFrame:
    return _rounded(_gram(s), "re", "im")


@_query(f"SELECT i, j, {_round('re', 'im')} FROM dhd", _PAIRS + "," + _FULL.format(_GRAM.format("cells", "cells"), "cells"))
def precondition(s: Setup) -> DataFrame:
    return _rounded(_preconditioned(s), "re", "im")


_STEPS = 3
_POWER = "v0 AS (SELECT fid, 1.0 AS re, 0.0 AS im FROM scan)" + "".join(
    f""",
w{k} AS MATERIALIZED (SELECT i AS fid, sum(h.re * v.re - h.im * v.im) AS re, sum(h.re * v.im + h.im * v.re) AS im FROM dhd h JOIN v{k - 1} v ON v.fid = j GROUP BY i),
v{k} AS MATERIALIZED (SELECT fid, re / s AS re, im / s AS im FROM w{k}, (SELECT sqrt(sum(re * re + im * im)) AS s FROM w{k}))"""
    for k in range(1, _STEPS + 1)
) + f""",
u AS MATERIALIZED (SELECT fid, re / sqrt(re * re + im * im) AS re, im / sqrt(re * re + im * im) AS im FROM v{_STEPS}),
t AS (SELECT sum(re) AS re, sum(im) AS im FROM u)"""
_TURNED = "SELECT fid, round((t.re * u.re + t.im * u.im) / sqrt(t.re * t.re + t.im * t.im), 6) + 0.0 AS re, round((t.re * u.im - t.im * u.re) / sqrt(t.re * t.re + t.im * t.im), 6) + 0.0 AS im FROM u, t"


@_query(_TURNED, _PAIRS + "," + _FULL.format(_GRAM.format("cells", "cells"), "cells") + "," + _POWER)
def power_iteration(s: Setup) -> DataFrame:
    return _rounded(gram.leading(kept(_preconditioned(s)), s.scan, _STEPS, kept), "re", "im")


@_query(
    f"SELECT round(value, 6) + 0.0 AS value, round(sqrt(sum((w.re - value * v.re) ** 2 + (w.im - value * v.im) ** 2)), 6) + 0.0 AS residual FROM w JOIN v{_STEPS} v USING (fid), (SELECT sum(v.re * w.re + v.im * w.im) AS value FROM w JOIN v{_STEPS} v USING (fid)) GROUP BY value",
    _PAIRS + "," + _FULL.format(_GRAM.format("cells", "cells"), "cells") + "," + _POWER + f", w AS (SELECT i AS fid, sum(h.re * v.re - h.im * v.im) AS re, sum(h.re * v.im + h.im * v.re) AS im FROM dhd h JOIN v{_STEPS} v ON v.fid = j GROUP BY i)",
)
def eigen_residual(s: Setup) -> DataFrame:
    """How far the vector of power_iteration is from an eigenvector."""
    h = kept(_preconditioned(s))
    return _rounded(gram.residual(h, gram.eigenvector(h, s.scan, _STEPS, kept)), "value", "residual")


_BORDERED = _PAIRS.replace("abs(dx) < 8 AND abs(dy) < 8", "abs(dx) < 6 AND abs(dy) < 6") + "," + _FULL.format(
    _GRAM.format("cells", "cells").replace("GROUP BY i, j", "WHERE a.y BETWEEN greatest(0, -dy) + 1 AND least(8, 8 - dy) - 2 AND a.x BETWEEN greatest(0, -dx) + 1 AND least(8, 8 - dx) - 2 GROUP BY i, j"),
    "cells WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6",
)


@_query(f"SELECT i, j, {_round('re', 'im')} FROM dhd", _BORDERED)
def precondition_border(s: Setup) -> DataFrame:
    """Pairs, Gram matrix and scaling without a border of one pixel."""
    return _rounded(_preconditioned(s, 1), "re", "im")


_LEFT_RIGHT = """
lefts AS MATERIALIZED (SELECT fid, y, x, p.re * f.re + p.im * f.im AS re, p.re * f.im - p.im * f.re AS im FROM {0} f JOIN probe p USING (y, x)),
nrm AS MATERIALIZED (SELECT pix, sum(re * re + im * im) AS n FROM mapid JOIN probe USING (y, x) GROUP BY pix),
rights AS MATERIALIZED (SELECT fid, y, x, re / n AS re, im / n AS im FROM lefts JOIN mapid USING (fid, y, x) JOIN nrm USING (pix))"""
_SYNC = _WAVES + """,
spun AS MATERIALIZED (SELECT fid, y, x, o.re * f.re - o.im * f.im AS re, o.re * f.im + o.im * f.re AS im FROM waves f JOIN omega o USING (fid)),""" + _LEFT_RIGHT.format("spun")


@_query(_TURNED, _SYNC + "," + _PAIRS + "," + _FULL.format(_GRAM.format("lefts", "rights"), "spun") + "," + _POWER)
def synchronize(s: Setup) -> DataFrame:
    sync, rows = _spun(s)
    return _rounded(sync.phases(rows), "re", "im")


_PLANTED = """v0 AS MATERIALIZED (SELECT fid, o.re * size / s AS re, -o.im * size / s AS im FROM omega o JOIN (SELECT fid, sqrt(sum(re * re + im * im)) AS size FROM spun GROUP BY fid) USING (fid), (SELECT sqrt(sum(re * re + im * im)) AS s FROM spun)),
w AS (SELECT i AS fid, sum(h.re * v.re - h.im * v.im) AS re, sum(h.re * v.im + h.im * v.re) AS im FROM dhd h JOIN v0 v ON v.fid = j GROUP BY i)"""


@_query(
    "SELECT round(value, 6) + 0.0 AS value, round(sqrt(sum((w.re - value * v.re) ** 2 + (w.im - value * v.im) ** 2)), 6) + 0.0 AS residual FROM w JOIN v0 v USING (fid), (SELECT sum(v.re * w.re + v.im * w.im) AS value FROM w JOIN v0 v USING (fid)) GROUP BY value",
    _SYNC + "," + _PAIRS + "," + _FULL.format(_GRAM.format("lefts", "rights"), "spun") + "," + _PLANTED,
)
def sync_eigenpair(s: Setup) -> DataFrame:
    """The leading eigenpair to 1e-9; the SQL has the value and residual of the vector that planted phases make."""
    sync, rows = _spun(s)
    sync.tol, sync.steps = 1e-9, 100
    h = sync.matrix(rows)
    return _rounded(gram.residual(h, krylov.leading_pair(h, sync.start(h, rows), kept, sync.tol, sync.steps).vector), "value", "residual")


@_query("SELECT fid, round((t.re * o.re - t.im * o.im) / sqrt(t.re * t.re + t.im * t.im), 3) + 0.0 AS re, round(-(t.re * o.im + t.im * o.re) / sqrt(t.re * t.re + t.im * t.im), 3) + 0.0 AS im FROM omega o, (SELECT sum(re) AS re, -sum(im) AS im FROM omega) t")
def synchronize_converged(s: Setup) -> DataFrame:
    """Phases to convergence: the planted ones, undone."""
    sync, rows = _spun(s)
    sync.tol, sync.steps = 1e-12, 20
    return sync.phases(rows).withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("re", "im")})


def _iterated(steps: int) -> str:
    """The solver's steps from an image of ones, unrolled."""
    out = "i0 AS (SELECT pix, 1.0 AS re, 0.0 AS im FROM image)"
    wave = ", f{0} AS MATERIALIZED (SELECT fid, y, x, p.re * i.re - p.im * i.im AS re, p.re * i.im + p.im * i.re AS im FROM mapid JOIN i{0} i USING (pix) JOIN probe p USING (y, x))"
    out += wave.format(0)
    for k in range(steps):
        out += "," + _dft(f"h{k}", f"f{k}") + f", m{k} AS ({_PROX.format(f'h{k}')})," + _dft(f"b{k}", f"m{k}", 1) + f", i{k + 1} AS MATERIALIZED ({_PROJECTED.format(f'b{k}')})" + wave.format(k + 1)
    return out


def _solved(s: Setup, steps: int, **more) -> solvers.Solution:
    ones = s.image.select("pix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return solvers.alternating_projections(s.scan, kept(_data(s)), s.probe, s.width, steps, ones, s.image, **more)


@_query(f"SELECT pix, {_round('re', 'im')} FROM i1", _DATA + "," + _iterated(1))
def ap_step(s: Setup) -> DataFrame:
    return _rounded(_solved(s, 1).image, "re", "im")


_IN_PHASE = _LEFT_RIGHT.format("b0") + "," + _PAIRS + "," + _FULL.format(_GRAM.format("lefts", "rights"), "b0") + "," + _POWER + f""",
om AS ({_TURNED.replace("round(", "(").replace(", 6) + 0.0", ")")}),
c0 AS (SELECT fid, y, x, o.re * f.re - o.im * f.im AS re, o.re * f.im + o.im * f.re AS im FROM b0 f JOIN om o USING (fid)),
j1 AS ({_PROJECTED.format("c0")})"""


@_query(f"SELECT pix, {_round('re', 'im')} FROM j1", _DATA + "," + _iterated(1) + "," + _IN_PHASE)
def ap_synchronized_step(s: Setup) -> DataFrame:
    return _rounded(_solved(s, 1, power_steps=_STEPS).image, "re", "im")


@_query("SELECT pix, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM image WHERE pix IN (SELECT pix FROM mapid)")
def ap_synchronized_steps(s: Setup) -> DataFrame:
    """Two steps with phases synchronised to convergence, from the true image, which they leave as it is where frames lie; the second starts from the first one's eigenvector."""
    found = solvers.alternating_projections(s.scan, _data(s), s.probe, s.width, 2, s.image, power_steps=20, power_tol=1e-12, residuals_interval=0, write_frames=False)
    return found.image.withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("re", "im")})


_REFINED = _LENS + "," + _iterated(1) + """,
s1 AS MATERIALIZED (SELECT m.y, m.x, avg(i.re * f.re + i.im * f.im) AS a, avg(i.re * f.im - i.im * f.re) AS b, avg(i.re * i.re + i.im * i.im) AS n FROM mapid m JOIN i1 i USING (pix) JOIN b0 f ON f.fid = m.fid AND f.y = m.y AND f.x = m.x GROUP BY m.y, m.x),
q1 AS MATERIALIZED (SELECT 0 AS fid, y, x, (a + e * p.re) / (n + e) AS re, (b + e * p.im) / (n + e) AS im FROM s1 JOIN probe p USING (y, x), (SELECT max(n) * 0.01 AS e FROM s1)),""" + _dft("q1_hat", "q1") + """,
q1_cut AS (SELECT fid, y, x, re * CAST(mask AS INT) AS re, im * CAST(mask AS INT) AS im FROM q1_hat JOIN lens USING (y, x)),""" + _dft("p1", "q1_cut", 1) + """,
g1 AS MATERIALIZED (SELECT m.fid, m.y, m.x, p.re * i.re - p.im * i.im AS re, p.re * i.im + p.im * i.re AS im FROM mapid m JOIN i1 i USING (pix) JOIN p1 p ON p.y = m.y AND p.x = m.x),""" + _dft("g1_hat", "g1") + f""",
g1_fit AS ({_PROX.format("g1_hat")}),""" + _dft("g1_back", "g1_fit", 1) + ", i2 AS MATERIALIZED (" + _PROJECTED.format("g1_back").replace("JOIN probe p", "JOIN (SELECT y, x, re, im FROM p1) p") + ")"


@_query(f"SELECT pix, {_round('re', 'im')} FROM i2", _DATA + "," + _REFINED)
def ap_refined(s: Setup) -> DataFrame:
    """Two steps with the probe refined after the first, within the lens."""
    return _rounded(_solved(s, 2, refine_from=0, lens=dense.aperture(s.probe), residuals_interval=0).image, "re", "im")


@_query("SELECT y, x, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM p1", _DATA + "," + _REFINED)
def ap_refined_probe(s: Setup) -> DataFrame:
    found = _solved(s, 1, refine_from=0, lens=dense.aperture(s.probe))
    return _rounded(geometry.probe_table(s.spark, found.probe), "re", "im")


@_query("SELECT fid, round(sum(p.re * f.re + p.im * f.im) / s, 6) + 0.0 AS re, round(sum(p.re * f.im - p.im * f.re) / s, 6) + 0.0 AS im FROM cells f JOIN probe p USING (y, x), (SELECT sum(re * re + im * im) AS s FROM probe) GROUP BY fid, s")
def make_probe(s: Setup) -> DataFrame:
    """How much of the probe each frame holds, by the probe's own pixels."""
    return _rounded(dense.along(s.frames, s.probe), "re", "im")


_MSE = "SELECT sqrt(greatest(0, aa + bb - 2 * sqrt(re * re + im * im))) AS mse FROM (SELECT sum(b.re * a.re + b.im * a.im) AS re, sum(b.re * a.im - b.im * a.re) AS im, sum(a.re * a.re + a.im * a.im) AS aa, sum(b.re * b.re + b.im * b.im) AS bb FROM {0} a JOIN {1} b USING (pix))"
_NORMS = "(SELECT sqrt(sum(intensity)) AS frames_norm, sqrt(sum(intensity)) / 8 AS frames_norm_r FROM data), (SELECT sqrt(sum(re * re + im * im)) AS truth_norm FROM image)"


@_query(
    " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS iter, round(mse / truth_norm, 6) + 0.0 AS r_truth, round(r / frames_norm, 6) + 0.0 AS r_data, round(st / frames_norm_r, 6) + 0.0 AS r_step FROM ({_MSE.format('image', f'i{k + 1}')}), (SELECT sqrt(sum((sqrt(h.re * h.re + h.im * h.im) - sqrt(intensity)) ** 2)) AS r FROM h{k} h JOIN data USING (fid, y, x)), (SELECT sqrt(sum((a.re - b.re) ** 2 + (a.im - b.im) ** 2)) AS st FROM f{k + 1} a JOIN b{k} b USING (fid, y, x)), {_NORMS}"
        for k in range(2)
    ),
    _DATA + "," + _iterated(2),
)
def ap_residuals(s: Setup) -> DataFrame:
    return _rounded(_solved(s, 2).residuals, "r_truth", "r_data", "r_step")


@_query(f"SELECT round(mse, 6) + 0.0 AS mse FROM ({_MSE.format('image', 'other')})", f"other AS ({_PROJECTED.format('cells')})")
def mse_calc(s: Setup) -> DataFrame:
    return _rounded(solvers.distance(s.image, _projected(s, s.frames)), "mse")


@_query("SELECT pix, round(sqrt(a.re * a.re + a.im * a.im) - sqrt(b.re * b.re + b.im * b.im), 6) + 0.0 AS d FROM image a JOIN other b USING (pix)", f"other AS ({_PROJECTED.format('cells')})")
def difference_image(s: Setup) -> DataFrame:
    return _rounded(solvers.difference(s.image, _projected(s, s.frames)), "d")


@_query("SELECT round(sqrt(sum((a.re - b.re) ** 2 + (a.im - b.im) ** 2)), 6) + 0.0 AS r FROM waves a JOIN cells b USING (fid, y, x)", _WAVES)
def step_residual(s: Setup) -> DataFrame:
    return _rounded(solvers.step_norm(_waves(s), s.frames), "r")


@_query(f"SELECT {_round('frames_norm', 'frames_norm_r', 'truth_norm')} FROM {_NORMS}", _DATA)
def norms(s: Setup) -> DataFrame:
    return _rounded(solvers.norms(_data(s), s.image, N), "frames_norm", "frames_norm_r", "truth_norm")


@_query(
    "SELECT y, x, round((a + e * p.re) / (n + e), 6) + 0.0 AS re, round((b + e * p.im) / (n + e), 6) + 0.0 AS im FROM s JOIN probe p USING (y, x), (SELECT max(n) * 0.01 AS e FROM s)",
    "s AS MATERIALIZED (SELECT m.y, m.x, avg(i.re * f.re + i.im * f.im) AS a, avg(i.re * f.im - i.im * f.re) AS b, avg(i.re * i.re + i.im * i.im) AS n FROM mapid m JOIN image i USING (pix) JOIN cells f ON f.fid = m.fid AND f.y = m.y AND f.x = m.x GROUP BY m.y, m.x)",
)
def refine_illumination(s: Setup) -> DataFrame:
    plan = kept(s.plan)
    found = solvers.refined_probe(plan.join(s.frames, "fid"), tiles.tiled(s.image, s.tiling), tiles.chunks(plan, s.tiling), s.tiling, s.probe)
    return _rounded(geometry.probe_table(s.spark, found), "re", "im")


@_query(f"SELECT round(mse / truth_norm, 6) + 0.0 AS nmse FROM ({_MSE.format('image', 'other')}), (SELECT sqrt(sum(re * re + im * im)) AS truth_norm FROM image)", _WAVES + f", other AS ({_PROJECTED.format('waves')})")
def split_overlap_identity(s: Setup) -> DataFrame:
    """Frames cut from the image and summed up again give the image."""
    back = _projected(s, _waves(s))
    size = s.image.agg(F.sqrt(F.sum(cplx.abs2(cplx.pair()))).alias("size"))
    return solvers.distance(s.image, back).crossJoin(size).select((F.round(F.col("mse") / F.col("size"), 6) + F.lit(0.0)).alias("nmse"))


def operator_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the seconds that tasks of a solver run of three steps spend in each kind of work, measured inside them; another run has other figures."""
    return solvers.shares(_solved(setup(spark, sf_dir), 3).times, "operator", "seconds")


QUERIES["operator_times"] = operator_times


def timer_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.abs("value").alias("value"))
    return _rounded(solvers.shares(events, "event_type", "value"), "share")


QUERIES["timer_shares"] = timer_shares
ORACLES["timer_shares"] = "SELECT event_type, round(s / nullif(sum(s) OVER (), 0), 6) + 0.0 AS share FROM (SELECT event_type, sum(abs(value)) AS s FROM events GROUP BY event_type)"
