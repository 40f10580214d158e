import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemill.jobs import ptychography as P
from phasemill.operators import agreement, dense, frames, geometry, gram, krylov, prox, solvers, tiles
from phasemill.sources import store
from phasemill.sources.bridge import N, setup
from phasemill.streaming import accumulate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def s(spark):
    return setup(spark, SF)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", [n for n in P.ORACLES if n not in ("sync_eigenpair", "synchronize_converged", "ap_synchronized_steps")])  # long runs, whose solvers smaller tests run to convergence too
def test_query_matches_sql(spark, db, name):
    got, want = P.QUERIES[name](spark, SF).toPandas(), db.execute(P.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", ["sync_eigenpair", "synchronize_converged", "ap_synchronized_steps"])
def test_converged_query_takes_few_products(spark, db, name, monkeypatch):
    """From ones it takes 129 products on these 500 frames, and more on more frames."""
    found, solve = [], krylov.leading_pair
    monkeypatch.setattr(krylov, "leading_pair", lambda *a, **k: found.append(solve(*a, **k)) or found[-1])
    got, want = P.QUERIES[name](spark, SF).toPandas(), db.execute(P.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert _rows(got) == _rows(want)
    assert found and all(p.products < 30 and p.residual < 1e-9 for p in found)


def _array(cells, k):
    out = np.zeros((k, N, N), dtype=complex)
    for r in cells.collect():
        out[r.fid, r.y, r.x] = r.re + 1j * r.im
    return out


def _small(spark, step=4, side=4, seed=0, width=None):
    """Scan, image and probe of a 4 x 4 lattice, in Spark and NumPy."""
    scan = geometry.translations(spark.range(side * side).withColumnRenamed("id", "fid"), step, side)
    width = width or geometry.extent(scan).first()["width"]
    rng = np.random.default_rng(seed)
    truth = np.exp(-0.3 * rng.random((width, width))) * np.exp(1j * rng.random((width, width)))
    rows = [(y * width + x, float(truth[y, x].real), float(truth[y, x].imag)) for y in range(width) for x in range(width)]
    at = np.array([[r.ty, r.tx] for r in scan.orderBy("fid").collect()])
    probe = geometry.make_probe(N, 0.1, 0.3, 20.0, 20.0)
    return scan, width, spark.createDataFrame(rows, "pix long, re double, im double"), truth, at, probe


def _frames(spark, f):
    """Frames in arrays."""
    return spark.createDataFrame([(k, x.real.ravel().tolist(), x.imag.ravel().tolist()) for k, x in enumerate(f)], dense.SCHEMA)


def _windows(truth, at):
    y, x = np.meshgrid(np.arange(N), np.arange(N), indexing="ij")
    w = truth.shape[0]
    return np.stack([truth[(ty + y) % w, (tx + x) % w] for ty, tx in at])


def _image(df, width):
    out = np.full(width * width, np.nan, dtype=complex)
    for r in df.collect():
        out[r.pix] = r.re + 1j * r.im
    return out.reshape(width, width)


@pytest.mark.parametrize("n", [4, 5])
def test_shifts_of_even_and_odd_frames(spark, n):
    """The inverse shift is another one where n is odd."""
    f = np.arange(n * n, dtype=float).reshape(n, n)
    rows = spark.createDataFrame([(0, y, x, float(f[y, x]), 0.0) for y in range(n) for x in range(n)], "fid long, y long, x long, re double, im double")
    for inverse, want in ((False, np.fft.fftshift(f)), (True, np.fft.ifftshift(f))):
        got = {(r.y, r.x): r.re for r in geometry.shifted(rows, n, inverse).collect()}
        assert all(got[y, x] == want[y, x] for y in range(n) for x in range(n))
    back = geometry.shifted(geometry.shifted(rows, n), n, inverse=True)
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_round_trip_and_parseval(s):
    f = s.frames.limit(20)
    back = {r.fid: np.array(r.re) + 1j * np.array(r.im) for r in dense.back_propagate(dense.propagate(f, N), N).collect()}
    hat = {r.fid: np.array(r.re) + 1j * np.array(r.im) for r in dense.propagate(f, N).collect()}
    for r in f.collect():
        x = np.array(r.re) + 1j * np.array(r.im)
        assert np.allclose(back[r.fid], x) and np.allclose(hat[r.fid].reshape(N, N), np.fft.fft2(x.reshape(N, N)))
        assert np.isclose((abs(hat[r.fid]) ** 2).sum(), N * N * (abs(x) ** 2).sum())


@pytest.mark.parametrize("step", [5, 4, 3, 2])
def test_split_and_overlap(spark, step):
    """Also where frames wrap around the image or are larger than it."""
    scan, width, image, truth, at, probe = _small(spark, step)
    split, overlap = frames.plan(scan, N, width)
    cells = split(image)
    assert np.allclose(_array(cells, 16), _windows(truth, at))
    lit = frames.illuminated(cells, probe)
    assert np.allclose(_image(frames.projected(lit, scan, probe, width), width), truth)
    # <split a, f> = <a, overlap f>
    f = _array(lit, 16)
    left = np.vdot(_windows(truth, at), f)
    right = np.vdot(truth, _image(overlap(lit), width))
    assert np.isclose(left, right)


def test_probe_is_an_annulus():
    probe = geometry.make_probe(16, 0.1, 0.3)
    hat = np.fft.fft2(np.fft.ifftshift(probe))
    f = np.fft.fftfreq(16) * 16
    radius = np.hypot(f[:, None], f[None, :])
    assert np.allclose(hat[(radius < 1.6) | (radius > 4.8)], 0) and np.isclose(abs(probe).max(), 1)
    for bad in ((8, 0.03, 0.06), (7, 0.1, 0.3)):
        with pytest.raises(ValueError):
            geometry.make_probe(*bad)


def test_crops_differ_for_even_width_and_odd_size(spark):
    image = spark.range(16).select(F.expr("id div 4").alias("y"), (F.col("id") % 4).alias("x"), F.col("id").alias("v"))
    assert [r.v for r in geometry.crop_center(image, 4, 1).collect()] == [10]
    assert [r.v for r in geometry.crop_to(image, 4, 1).collect()] == [5]


@pytest.mark.parametrize(("step", "side"), [(5, 8), (4, 8), (3, 8), (2, 8), (9, 8), (5, 32)])
def test_gram_is_that_of_the_shortest_displacement(spark, step, side, monkeypatch):
    """By rows of pixels and by pairs of chunks, with tiles of several sizes and frames larger than the image."""
    monkeypatch.setattr(tiles, "CHUNK_FRAMES", 5)
    scan, width, _, _, at, _ = _small(spark, step)
    rng = np.random.default_rng(1)
    f = rng.normal(size=(16, N, N)) + 1j * rng.normal(size=(16, N, N))
    cells = spark.createDataFrame([(k, y, x, float(f[k, y, x].real), float(f[k, y, x].imag)) for k in range(16) for y in range(N) for x in range(N)], "fid long, y long, x long, re double, im double")
    pairs = gram.pairs(scan, N, width)
    h = np.zeros((16, 16), dtype=complex)
    for r in gram.hermitian(gram.gram(cells, cells, pairs, N)).collect():
        h[r.i, r.j] += r.re + 1j * r.im
    want = np.zeros_like(h)
    for i in range(16):
        for j in range(16):
            d = at[j] - at[i]
            dy, dx = -(d + width * ((d < -width / 2).astype(int) - (d > width / 2).astype(int)))
            for y in range(max(0, -dy), min(N, N - dy)):
                for x in range(max(0, -dx), min(N, N - dx)):
                    want[i, j] += np.conj(f[i, y, x]) * f[j, y + dy, x + dx]
    upper = np.triu_indices(16)
    assert np.allclose(h[upper], want[upper]) and np.allclose(h, h.conj().T)
    tiling = tiles.Tiling(width, N, side)
    plan = P.kept(tiles.planned(scan, tiling))
    assert plan.select("r", "c", "part").distinct().count() > 1
    sums = gram.tiled_gram(gram.both_sides(plan.join(_frames(spark, f), "fid")), gram.chunk_pairs(plan, tiling), tiling)
    found = {(r.i, r.j): r.re + 1j * r.im for r in sums.collect()}
    assert set(found) == {(r.i, r.j) for r in pairs.collect()} and sums.count() == len(found)
    assert all(np.isclose(v, want[k]) for k, v in found.items())
    assert len(pairs.select("i", "j").distinct().collect()) == pairs.count()


def test_synchronization_finds_planted_phases(spark):
    scan, width, image, truth, at, probe = _small(spark, 4)
    waves = _array(dense.long(solvers.exit_waves(image, scan, probe, width), N), 16)
    angles = np.random.default_rng(2).random(16) * 2 * np.pi
    spun = _frames(spark, waves * np.exp(1j * angles)[:, None, None])
    for more in ({"steps": 30}, {"tol": 1e-10}):
        sync = gram.Synchronizer.of_scan(scan, probe, width, P.kept, **more)
        rows = P.kept(sync.plan.join(spun, "fid"))
        for again in (False, True):  # the second time from the vector of the first
            got = {r.fid: r.re + 1j * r.im for r in sync.phases(rows).collect()}
            product = np.array([got[k] * np.exp(1j * angles[k]) for k in range(16)])
            assert np.allclose(product / product[0], 1, atol=1e-4 if "steps" in more else 1e-8)
            assert not again or "steps" in more or sync.last.products < 10
    scale = rows.select("fid", F.lit(1.0).alias("d"))
    assert sync.matrix(rows, scale).count() == sync.matrix(rows).count()


@pytest.mark.parametrize(("side", "group", "limit"), [(12, 6, 256), (5, 200, 9)])
def test_phases_agree_from_the_bottom_up(spark, monkeypatch, side, group, limit):
    """Planted phases over several levels, and cells that are cut in parts, at the first product."""
    monkeypatch.setattr(agreement, "GROUP", group)
    monkeypatch.setattr(agreement, "LIMIT", limit)
    scan, width, image, truth, at, probe = _small(spark, 4, side)
    waves = _array(dense.long(solvers.exit_waves(image, scan, probe, width), N), side**2)
    angles = np.random.default_rng(2).random(side**2) * 2 * np.pi
    sync = gram.Synchronizer.of_scan(scan, probe, width, P.kept, tol=1e-12)
    rows = P.kept(sync.plan.join(_frames(spark, waves * np.exp(1j * angles)[:, None, None]), "fid"))
    got = {r.fid: r.re + 1j * r.im for r in sync.phases(rows).collect()}
    product = np.array([got[k] * np.exp(1j * angles[k]) for k in range(side**2)])
    assert np.allclose(product / product[0], 1, atol=1e-8)
    assert sync.last.residual <= 1e-12 and np.isclose(sync.last.value, 1)
    if limit == 256:
        assert sync.last.products == 1


def test_frames_that_disagree_still_converge(spark, monkeypatch):
    """Noisy frames, one of them zero, against NumPy: the start is near, the Krylov projection does the rest."""
    monkeypatch.setattr(agreement, "GROUP", 6)
    scan, width, image, truth, at, probe = _small(spark, 4, 6)
    rng = np.random.default_rng(3)
    waves = _array(dense.long(solvers.exit_waves(image, scan, probe, width), N), 36)
    waves = waves * np.exp(2j * np.pi * rng.random(36))[:, None, None] + 0.05 * (rng.normal(size=waves.shape) + 1j * rng.normal(size=waves.shape))
    waves[11] = 0
    sync = gram.Synchronizer.of_scan(scan, probe, width, P.kept, tol=1e-9)
    rows = P.kept(sync.plan.join(_frames(spark, waves), "fid"))
    pair = sync.pair(rows)
    full = np.zeros((36, 36), dtype=complex)
    for r in sync.matrix(rows).filter("re IS NOT NULL").collect():
        full[r.i, r.j] = r.re + 1j * r.im
    values, vectors = np.linalg.eigh(full)
    got = np.zeros(36, dtype=complex)
    for r in pair.vector.collect():
        got[r.fid] = (r.re or 0) + 1j * (r.im or 0)
    assert pair.residual <= 1e-9 and np.isclose(pair.value, values[-1]) and np.isclose(abs(np.vdot(vectors[:, -1], got)), 1)


def test_true_frames_are_a_fixed_point(spark):
    scan, width, image, *_, probe = _small(spark, 4)
    waves = solvers.exit_waves(image, scan, probe, width)
    data = dense.intensities(waves, N)
    assert solvers.step_norm(prox.project_data(waves, data, N), waves).first()["r"] < 1e-9
    assert prox.data_residual(waves, data, N).first()["r"] < 1e-9
    a, b = (_array(dense.long(f(waves, data, N), N), 16) for f in (prox.prox_data, prox.prox_data_reciprocal))
    assert np.allclose(a, b)


def test_alternating_projections_lower_the_residuals(spark):
    scan, width, image, *_, probe = _small(spark, 4)
    data = P.kept(dense.intensities(solvers.exit_waves(image, scan, probe, width), N))
    ones = image.select("pix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    rows = solvers.alternating_projections(scan, data, probe, width, 4, ones, image).residuals
    got = [(r.r_data, r.r_step) for r in rows.orderBy("iter").collect()]
    assert len(got) == 4 and got[-1][0] < got[0][0] and got[-1][1] < got[0][1]


def test_refinement_within_the_solver_keeps_the_scale(spark):
    scan, width, image, _, at, probe = _small(spark, 4)
    data = P.kept(dense.intensities(solvers.exit_waves(image, scan, probe, width), N))
    ones = image.select("pix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    found = solvers.alternating_projections(scan, data, probe, width, 4, ones, image, refine_from=1, residuals_interval=3)
    got = {r.iter: r.r_data for r in found.residuals.collect()}
    assert sorted(got) == [0, 3] and got[3] < got[0]
    assert found.probe.shape == probe.shape and not np.allclose(found.probe, probe)
    norm = _image(found.normalization.select("pix", F.col("n").alias("re"), F.lit(0.0).alias("im")), width).real
    want = np.zeros((width, width))
    for ty, tx in at:
        want[np.ix_((ty + np.arange(N)) % width, (tx + np.arange(N)) % width)] += abs(found.probe) ** 2
    assert np.allclose(norm, want)
    waves = _array(dense.long(found.frames, N), 16)
    assert np.allclose(waves, found.probe * _windows(_image(found.image, width), at))


def test_eigenvector_to_a_tolerance(spark):
    """The leading eigenvector of a Gram matrix, against NumPy."""
    scan, width, image, _, at, probe = _small(spark, 4)
    cells = P.kept(dense.long(solvers.exit_waves(image, scan, probe, width), N))
    h = P.kept(gram.preconditioned(gram.hermitian(gram.gram(cells, cells, gram.pairs(scan, N, width), N)), cells, N))
    v = P.kept(gram.eigenvector(h, scan, 200, P.kept, tol=1e-5))
    found = gram.residual(h, v).first()
    full = np.zeros((16, 16), dtype=complex)
    for r in h.collect():
        full[r.i, r.j] = r.re + 1j * r.im
    values, vectors = np.linalg.eigh(full)
    got = np.zeros(16, dtype=complex)
    for r in v.collect():
        got[r.fid] = r.re + 1j * r.im
    assert found.residual <= 1e-5 and np.isclose(found.value, values[-1])
    assert np.isclose(abs(np.vdot(vectors[:, -1], got)), 1, atol=1e-6) and np.isclose(np.linalg.norm(full @ got - found.value * got), found.residual, atol=1e-8)


def _pair(spark, matrix, start, **more):
    n = len(matrix)
    h = spark.createDataFrame([(i, j, float(matrix[i, j].real), float(matrix[i, j].imag)) for i in range(n) for j in range(n) if matrix[i, j]], "i long, j long, re double, im double")
    v = spark.createDataFrame([(k, float(np.real(x)), float(np.imag(x))) for k, x in enumerate(start)], "fid long, re double, im double")
    found = krylov.leading_pair(h, v, P.kept, **more)
    got = np.zeros(n, dtype=complex)
    for r in found.vector.collect():
        got[r.fid] = r.re + 1j * r.im
    return found, got


def test_krylov_pair_against_numpy(spark):
    """Close leading values, negative ones, to 1e-9."""
    sign = -1
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(60, 60)) + 1j * rng.normal(size=(60, 60)))
    values = sign * np.r_[2.0, 1.9, np.linspace(-1.5, 1.7, 58)]
    matrix = (q * values) @ q.conj().T
    matrix = (matrix + matrix.conj().T) / 2
    found, got = _pair(spark, matrix, np.ones(60), tol=1e-9)
    assert found.residual <= 1e-9 and np.isclose(found.value, 2 * sign, atol=1e-12) and np.isclose(np.linalg.norm(got), 1)
    assert np.linalg.norm(matrix @ got - found.value * got) < 2e-9
    again, _ = _pair(spark, matrix, got, tol=1e-8)
    assert again.products == 1
    few, _ = _pair(spark, matrix, np.ones(60), cycles=1)
    assert few.products == 9 and few.residual > 1e-9


def test_krylov_pair_of_small_matrices(spark):
    found, got = _pair(spark, np.diag([3.0, 0.0, -1.0]), np.ones(3))
    assert np.isclose(found.value, 3) and np.allclose(np.abs(got), [1, 0, 0], atol=1e-9)
    found, got = _pair(spark, np.zeros((2, 2)), np.ones(2))
    assert found.value == 0 and found.residual == 0
    found, got = _pair(spark, np.eye(2), np.zeros(2))
    assert found.value == 0 and not got.any()


@pytest.mark.parametrize(("step", "width", "side"), [(4, None, 8), (2, None, 8), (9, None, 8), (5, 40, 13), (5, None, 64)])
def test_tiles_gather_and_scatter(spark, step, width, side, monkeypatch):
    """Against NumPy: several chunks a tile, frames larger than the image, pixels that no frame covers."""
    monkeypatch.setattr(tiles, "CHUNK_FRAMES", 3)
    monkeypatch.setattr(tiles, "HELD", 2)
    scan, width, image, truth, at, probe = _small(spark, step, width=width)
    tiling = tiles.Tiling(width, N, side)
    plan = P.kept(tiles.planned(scan, tiling))
    assert plan.groupBy("r", "c", "part").count().count() > 4
    assert np.allclose(_image(tiles.pixels(tiles.tiled(image, tiling), tiling, "re", "im"), width), truth)
    windows = tiles.gathered(plan, tiles.tiled(image, tiling), tiling)
    assert np.allclose(_array(dense.long(windows, N), 16), _windows(truth, at))
    rng = np.random.default_rng(6)
    matrix = P.kept(tiles.sparse_rows(plan, tiling))
    y, x = np.meshgrid(np.arange(N), np.arange(N), indexing="ij")
    for _ in range(2):  # one matrix for several sets of frames
        f = rng.normal(size=(16, N, N)) + 1j * rng.normal(size=(16, N, N))
        total, norm, times = np.zeros((width, width), dtype=complex), np.zeros((width, width)), np.zeros((width, width))
        lit = np.zeros((width, width), dtype=complex)
        for k, (ty, tx) in enumerate(at):
            where = (ty + y) % width, (tx + x) % width
            np.add.at(total, where, f[k])
            np.add.at(lit, where, np.conj(probe) * f[k])
            np.add.at(norm, where, np.abs(probe) ** 2)
            np.add.at(times, where, 1)
        total[times == 0] = lit[times == 0] = np.nan
        given = _frames(spark, f)
        for sums in (tiles.scattered(given, plan, tiling), tiles.multiplied(matrix, given, plan, tiling)):
            assert np.allclose(_image(tiles.pixels(tiles.covered(sums), tiling, "re", "im"), width), total, equal_nan=True)
        with np.errstate(invalid="ignore"):
            want = lit / norm
        assert np.allclose(_image(tiles.pixels(tiles.divided(tiles.scattered(given, plan, tiling, probe)), tiling, "re", "im"), width), want, equal_nan=True)
    with pytest.raises(Exception, match="frames are missing"):
        tiles.multiplied(matrix, given.filter("fid > 3"), plan, tiling).collect()


def test_no_row_for_each_pixel_in_the_plans(spark):
    """What is shuffled are tiles and frames: the Gram matrix and exit waves explode no arrays."""
    scan, width, image, *_, probe = _small(spark, 5)
    tiling = tiles.Tiling(width, N, 8)
    plan = tiles.planned(scan, tiling)
    waves = tiles.gathered(plan, tiles.tiled(image, tiling), tiling)
    sums = gram.tiled_gram(gram.both_sides(plan.join(waves, "fid")), gram.chunk_pairs(plan, tiling), tiling)
    text = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in text and "collect_list" not in text


def test_solver_of_many_steps(spark, tmp_path, monkeypatch):
    """Recorded steps as in NumPy, tables of steps deleted, times of the tasks."""
    scan, width, image, truth, at, probe = _small(spark, 4)
    waves = probe * _windows(truth, at)
    intensity = np.abs(np.fft.fft2(waves)) ** 2
    data = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(intensity)], "fid long, intensity array<double>")
    ones = image.select("pix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    monkeypatch.setattr(store, "folder", lambda _: f"file://{tmp_path}")
    found = solvers.alternating_projections(scan, data, probe, width, 5, ones, image, residuals_interval=2)
    y, x = np.meshgrid(np.arange(N), np.arange(N), indexing="ij")
    where = [((ty + y) % width, (tx + x) % width) for ty, tx in at]
    norm = np.zeros((width, width))
    for w in where:
        np.add.at(norm, w, np.abs(probe) ** 2)
    f, want = np.broadcast_to(probe, (16, N, N)), []
    for i in range(5):
        hat = np.fft.fft2(f)
        off = np.linalg.norm(np.abs(hat) - np.sqrt(intensity)) / np.sqrt(intensity.sum())
        fit = np.fft.ifft2(prox.prox(hat, intensity))
        total = np.zeros((width, width), dtype=complex)
        for w, g in zip(where, fit, strict=True):
            np.add.at(total, w, np.conj(probe) * g)
        total /= norm
        f = probe * _windows(total, at)
        turn = np.vdot(total, truth)
        want.append((i, np.linalg.norm(truth - total * turn / abs(turn)) / np.linalg.norm(truth), off, np.linalg.norm(f - fit) / (np.sqrt(intensity.sum()) / N)))
    got = [tuple(r) for r in found.residuals.orderBy("iter").collect()]
    assert np.allclose(got, want[::2], atol=1e-9)
    assert np.allclose(_image(found.image, width), total) and np.allclose(_array(dense.long(found.frames, N), 16), f)
    run, = os.listdir(tmp_path)
    assert len(os.listdir(tmp_path / run)) == 3  # image, frames, normalization
    assert {r.operator for r in found.times.filter("seconds > 0").collect()} == set(solvers.WORK)


def test_synchronised_steps_from_phases_that_were_lost(spark):
    """The solver with synchronisation to a tolerance undoes nothing on consistent data, and its warm start saves products."""
    scan, width, image, truth, at, probe = _small(spark, 4)
    data = P.kept(dense.intensities(solvers.exit_waves(image, scan, probe, width), N))
    found = solvers.alternating_projections(scan, data, probe, width, 2, image, image, power_tol=1e-10)
    assert all(r.r_truth < 1e-7 and r.r_data < 1e-9 for r in found.residuals.collect())


def test_synchronised_steps_write_few_tables(spark, monkeypatch):
    """Each table is a job or several whatever the scan; two steps wrote 25 of them, and the frames before anyone asked."""
    scan, width, image, truth, at, probe = _small(spark, 4)
    data = dense.intensities(solvers.exit_waves(image, scan, probe, width), N)
    written, write = [], store.Store.__call__
    monkeypatch.setattr(store.Store, "__call__", lambda self, df: written.append(df) or write(self, df))
    found = solvers.alternating_projections(scan, data, probe, width, 2, image, power_tol=1e-12, residuals_interval=0, write_frames=False)
    assert len(written) <= 17
    assert np.allclose(_image(found.image, width), truth) and np.allclose(_array(dense.long(found.frames, N), 16), probe * _windows(truth, at))
    with pytest.raises(ValueError, match="residual"):
        solvers.alternating_projections(scan, data, probe, width, 1, image, write_frames=False)


def test_failed_runs_leave_no_tables(spark, tmp_path, monkeypatch):
    scan, width, image, *_, probe = _small(spark, 4)
    monkeypatch.setattr(store, "folder", lambda _: f"file://{tmp_path}")
    short = spark.createDataFrame([(0, [1.0])], "fid long, intensity array<double>")
    with pytest.raises(Exception, match="reshape"):
        solvers.alternating_projections(scan, short, probe, width, 1, image)
    assert os.listdir(tmp_path) == []


def test_folder_of_tables(spark):
    """The session's own where it names one; else one folder of the application, and an error on a cluster."""
    class Context:
        applicationId, master = "app", "local[2]"

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return None

        sparkContext = Context

    assert store.folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert store.folder(Session) == store.folder(Session) != ""
    Context.master = "spark://host"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.folder(Session)


def test_frames_of_the_usual_size(spark):
    """Nine frames of 128 x 128 on an image that is smaller than they are."""
    scan = P.kept(geometry.translations(spark.range(9).withColumnRenamed("id", "fid"), 25, 3))
    probe, width = geometry.make_probe(128), geometry.extent(scan).first()["width"]
    rng = np.random.default_rng(8)
    truth = np.exp(1j * rng.random((width, width)))
    image = spark.createDataFrame([(k, float(v.real), float(v.imag)) for k, v in enumerate(truth.ravel())], "pix long, re double, im double")
    waves = solvers.exit_waves(image, scan, probe, width)
    tiling = tiles.Tiling(width, 128)
    plan = tiles.planned(scan, tiling)
    back = tiles.pixels(tiles.divided(tiles.scattered(waves, plan, tiling, probe)), tiling, "re", "im")
    assert width < 128 and np.allclose(_image(back, width), truth)


def test_plans_of_a_probe_of_full_size(spark):
    """128 x 128, the usual size: the probe travels as a table and not within the plan."""
    import time

    probe = geometry.make_probe(128)
    scan = geometry.translations(spark.range(4).withColumnRenamed("id", "fid"), 5, 2)
    cells = geometry.frame_pixels(scan, 128, 140).select("fid", "y", "x", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    began = time.time()
    plan = frames.projected(cells, scan, probe, 140)
    plan.schema
    assert time.time() - began < 3
    assert plan.count() > 128 * 128


def test_refined_probe(spark):
    scan, width, image, *_, probe = _small(spark, 4)
    tiling = tiles.Tiling(width, N, 8)
    plan = P.kept(tiles.planned(scan, tiling))
    of, held = P.kept(tiles.chunks(plan, tiling)), P.kept(tiles.tiled(image, tiling))
    lit = P.kept(plan.join(solvers.exit_waves(image, scan, probe, width), "fid"))
    for literal, factor in ((False, 1), (True, 16)):
        assert np.allclose(solvers.refined_probe(lit, held, of, tiling, probe, literal), factor * probe)
    assert solvers.refined_probe(lit.limit(0), held, of, tiling, probe) is probe


def test_uncovered_and_empty_images(spark):
    scan, width, image, *_, probe = _small(spark, 4)
    dark = np.zeros_like(probe)
    cells = frames.split(geometry.frame_pixels(scan, N, width), image)
    assert all(r.re is None for r in frames.projected(cells, scan, dark, width).collect())
    assert frames.projected(cells.limit(0), scan, probe, width).count() == 0


def test_stream_of_frames_gives_the_same_image(spark, tmp_path):
    scan, width, image, truth, _, probe = _small(spark, 4)
    solvers.exit_waves(image, scan, probe, width).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(dense.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    accumulate.accumulate(stream, scan, probe, width, f"{tmp_path}/sums", f"{tmp_path}/state").awaitTermination(120)
    assert len(os.listdir(f"{tmp_path}/sums")) > 1
    assert np.allclose(_image(accumulate.image(spark.read.parquet(f"{tmp_path}/sums")), width), truth)


def test_shares(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "op string, sec double")
    assert {r.op: r.share for r in solvers.shares(rows, "op", "sec").collect()} == {"a": 0.75, "b": 0.25}
    assert all(r.share is None for r in solvers.shares(rows.withColumn("sec", F.lit(0.0)), "op", "sec").collect())
