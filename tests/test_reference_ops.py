import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewright.core.cube import Cube
from cubewright.functions import solver as S
from cubewright.operators import fits, grid, maps, moments as M, preprocess as P
from cubewright.plans.recipe import Recipe, aggregate, analyze, run
from cubewright.scan import Scan
from cubewright.sources import store
from cubewright.sources.metadata import fit_length, matching_scans, parse_command
from cubewright.streaming.moments import moments_of_sums, streaming_sums


def make_cube(spark, data, axes=None, names=()):
    """A cube from an array (ny, nx, *grid)."""
    rows = [("s", *map(int, at), int(v)) for at, v in np.ndenumerate(data)]
    index = [f"i{k}" for k in range(data.ndim - 2)]
    df = spark.createDataFrame(rows, "scan_id string, y int, x int, " + "".join(f"{i} int, " for i in index) + "v long")
    axes = axes or tuple(F.col(i).cast("double") for i in index)
    return Cube(df, data.shape[:2], data.shape[2:], axes, names)


def image(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[col]
    return out


def curves(spark, data):
    rows = [("s", i // 16, i % 16, [int(v) for v in y]) for i, y in enumerate(data)]
    return spark.createDataFrame(rows, "scan_id string, y int, x int, v array<long>")


def ordered(df):
    return df.toPandas().sort_values(["y", "x"])


# Layouts and preprocessing


def test_layouts_round_trip(spark):
    data = np.random.default_rng(0).integers(0, 50, (3, 4, 2, 5))
    cube = make_cube(spark, data)
    for back in (cube.from_curves(cube.curves()), cube.from_frames(cube.frames())):
        got = {(r["y"], r["x"], r["i0"], r["i1"]): r["v"] for r in back.voxels.collect()}
        assert all(got[at] == v for at, v in np.ndenumerate(data))
    sparse = cube.with_voxels(cube.voxels.where("i0 + i1 > 0"))
    assert all(r["v"][0] == -1 for r in sparse.curves(fill=-1).collect())
    assert sparse.dense().voxels.count() == data.size


def test_background_modes(spark):
    data = np.random.default_rng(1).poisson(20, (4, 5, 12))
    cube = make_cube(spark, data)
    dark = np.argsort(data.sum(axis=(0, 1)), kind="stable")[:5]
    for mode, want in (("mean", data[..., dark].mean(-1)), ("median", np.median(data[..., dark], -1)), ("pmedian", np.median(data, -1)), ("percentile", np.percentile(data, 10, axis=-1))):
        assert np.array_equal(image(P.estimate_background(cube, mode), "bg", (4, 5)), np.rint(want))
    with pytest.raises(ValueError):
        P.estimate_background(cube, "best")


def test_hot_pixels_match_numpy(spark):
    data = np.random.default_rng(2).poisson(50, (6, 7, 3))
    data[2, 3, 1] = 9000
    got = P.remove_hot_pixels(make_cube(spark, data), min_sigma=1.0).voxels.collect()
    pad = np.pad(data, ((1, 1), (1, 1), (0, 0)), mode="edge")
    med = np.median(np.stack([pad[a : a + 6, b : b + 7] for a in range(3) for b in range(3)]), axis=0)
    diff = data - med
    sigma = np.maximum(1.4826 * np.median(np.abs(diff).reshape(-1, 3), axis=0), 1.0)
    want = np.where(np.abs(diff) > 5 * sigma, med, data).astype(int)
    assert all(want[r["y"], r["x"], r["i0"]] == r["v"] for r in got) and want[2, 3, 1] < 100


def test_closing_and_filling():
    m = np.zeros((12, 12), bool)
    m[3:9, 3:9] = True
    m[5:7, 5:7] = False
    assert P.close_and_fill(m, 0)[5, 5]
    assert not P.close_and_fill(m, 0, fill=False)[5, 5]
    gap = np.zeros((9, 9), bool)
    gap[3:6, 2:4] = gap[3:6, 5:7] = True
    assert P.close_and_fill(gap, 1)[4, 4]


def test_masks_and_polygon(spark):
    data = np.zeros((6, 6, 4), int)
    data[1:4, 2:5] = 10
    cube = make_cube(spark, data)
    assert P.grain_mask(cube, close=0).count() == 9
    assert P.grain_mask(cube, method="otsu", close=0).count() == 9
    assert P.auto_roi(cube, pad=0).first()[1:] == (1, 4, 2, 5)
    assert P.polygon_mask(cube.pixels(), [(0.5, 0.5), (3.5, 0.5), (3.5, 2.5), (0.5, 2.5)]).count() == 6
    flat = make_cube(spark, np.full((2, 2, 3), 5))
    assert P.otsu(P.zsum(flat), "zsum").first()["threshold"] == 15.0
    assert P.grain_mask(flat, method="otsu").count() == 0
    with pytest.raises(ValueError):
        P.support_count(cube, 3, 1)


# Moments, status, maps


def test_moments_match_numpy_and_mask(spark):
    rng = np.random.default_rng(3)
    data = rng.poisson(5, (2, 3, 6, 5))
    data[0, 0] = 0
    axes = (F.col("i0") * 0.1 + 7.0, F.col("i1") * 0.2 - 1.0)
    cube = make_cube(spark, data, axes)
    got = {(r["y"], r["x"]): r for r in M.moments(cube).collect()}
    a, b = np.meshgrid(np.arange(6) * 0.1 + 7, np.arange(5) * 0.2 - 1, indexing="ij")
    for y in range(2):
        for x in range(3):
            w = data[y, x]
            r = got[y, x]
            if w.sum() == 0:
                assert r["mu"] == [0, 0] and r["cov"] == [[0, 0], [0, 0]]
                continue
            mu = np.array([(w * a).sum(), (w * b).sum()]) / w.sum()
            c01 = (w * (a - mu[0]) * (b - mu[1])).sum() / w.sum()
            assert np.allclose(r["mu"], mu) and np.isclose(r["cov"][0][1], c01, atol=1e-12)
    mask = cube.pixels().where("y = 1")
    masked = {(r["y"], r["x"]): r["mu"] for r in M.moments(cube, mask=mask).collect()}
    assert masked[0, 1] == [0.0, 0.0] and masked[1, 1] == got[1, 1]["mu"]
    with pytest.raises(ValueError):
        M.moments(cube, order=3)


def test_fit_status_categories(spark):
    rows = [(5.0, 1.0, True), (0.5, 1.0, True), (10.5, 1.0, True), (20.0, 1.0, True), (5.0, 0.0, True), (5.0, 1.0, False), (float("nan"), 1.0, True)]
    df = spark.createDataFrame(rows, "mu double, ok double, inside boolean")
    got = df.select(M.fit_status([F.col("mu")], F.col("ok"), [(0, 10)], [1.0], F.col("inside")).alias("s")).toPandas()["s"].tolist()
    assert got == [1, 2, 2, 3, 3, 0, 3]


def test_kam_vectors_and_missing(spark):
    rows = [("s", y, x, 3.0 * (y == x == 2), 4.0 * (y == x == 2)) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(rows, "scan_id string, y int, x int, a double, b double")
    got = image(maps.kam(df, [F.col("a"), F.col("b")]), "kam", (5, 5))
    assert got[2, 2] == 5.0 and got[0, 0] == 0.0 and np.isclose(got[1, 1], 5 / 8)
    holes = df.withColumn("a", F.when((F.col("y") == 0) & (F.col("x") == 0), float("nan")).otherwise(F.col("a")))
    assert np.isnan(image(maps.kam(holes, [F.col("a"), F.col("b")]), "kam", (5, 5))[0, 0])


def test_geometry():
    assert np.isclose(maps.pixel_size_um({"obx": 250, "mainx": -5000, "obpitch": 20, "ffsel": -90}), 6.5 / (19 * 2))
    with pytest.warns(UserWarning):
        assert maps.pixel_size_um({}) == 6.5


# Grids and commands


def test_snake_survives_jitter(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6):
        order = range(8) if i % 2 == 0 else range(7, -1, -1)
        rows += [("s", i * 8 + k, i + rng.normal(0, 0.1), j + rng.normal(0, 0.1), i * 100 + j) for k, j in enumerate(order)]
    df = spark.createDataFrame(rows, "scan_id string, frame int, slow double, fast double, tag int")
    assert all(r["i0"] * 100 + r["i1"] == r["tag"] for r in grid.snake_order(df, 8).collect())
    assert grid.acquisition_mode(df, 8).first()["mode"] == "zigzag"
    kept, info = grid.partial_frames(df.where("frame < 30"), "fscan2d", 8, 48)
    assert kept.count() == 24 and info.first()[1:] == (24, 48, False)


def test_commands():
    c = parse_command("fscan2d chi -1.0 0.05 6 mu 2.0 0.01 8 0.1", "1.1")
    assert (c.shape, c.motor_names, c.integrated, c.kind) == ((6, 8), ("chi", "mu"), (False, True), "mosa")
    assert parse_command("ascan mu 0 1 10 0.1").shape == (11,)
    assert parse_command("loopscan 20 0.1").motor_names is None
    assert fit_length([3.0], 4) == [3.0] * 4 and matching_scans(["10.1", "2.1"], ".1") == ["2.1", "10.1"]
    with pytest.raises(ValueError):
        parse_command("wobble mu 1")


# Fits


@pytest.mark.parametrize(
    ("model", "p", "x"),
    [
        (S.gaussian_line, [2, 0.5, 0.1, 0.2, 0.3], np.linspace(-1, 1, 9)),
        (S.two_gaussians_line, [2, 0.5, 0.1, 1, 0.3, -0.4, 0.2, 0.3], np.linspace(-1, 1, 9)),
        (S.pseudo_voigt_line, [2, 0.5, 0.1, 0.4, 0.3, 0.2, 0.3], np.linspace(-1, 1, 9)),
        (S.GaussianND(2, 2), [2, 0.1, 0.2, 1.1, 0.2, 0.9, 1, -0.3, 0.1, 0.8, -0.1, 1.2, 0.1], np.random.default_rng(0).normal(size=(7, 2))),
        (S.FixedGaussian(np.array([[2, 0.3], [0.3, 1.0]]), (1,)), [2, 0.1, 0.2, 1.3, 0.1], np.random.default_rng(1).normal(size=(7, 2))),
    ],
)
def test_derivatives(model, p, x):
    p = np.array([p], float)
    _, jac = model(p, x)
    for i in range(p.shape[1]):
        hi, lo = p.copy(), p.copy()
        hi[0, i] += 1e-6
        lo[0, i] -= 1e-6
        assert np.allclose((model(hi, x)[0] - model(lo, x)[0]) / 2e-6, jac[..., i], atol=1e-5)


def test_fits_find_truths_whatever_the_partitions(spark):
    rng = np.random.default_rng(12)
    x, n = np.linspace(4.7385, 8.6385, 40), 128
    mu, sg, a = rng.uniform(x[5], x[-5], n), rng.uniform(0.1, 0.5, n), rng.uniform(200, 5000, n)
    y = rng.poisson(a[:, None] * np.exp(-0.5 * ((x - mu[:, None]) / sg[:, None]) ** 2) + 30)
    got = ordered(fits.fit_gaussian_1d(curves(spark, y).repartition(1), x))
    again = ordered(fits.fit_gaussian_1d(curves(spark, y).repartition(7), x))
    assert got["success"].mean() > 0.9 and np.median(np.abs(got["mu"] - mu)) < 0.05
    assert np.array_equal(got["mu"], again["mu"])


def test_nd_fits_peaks_and_refits(spark):
    rng = np.random.default_rng(13)
    g = (12, 15)
    c = np.stack(np.meshgrid(np.linspace(-0.5, 0.5, 12), np.linspace(7, 8.2, 15), indexing="ij")).reshape(2, -1)
    n, s = 64, np.array([0.1, 0.12])

    def peak(m):
        return np.exp(-0.5 * (((c.T[None] - m[:, None]) / s) ** 2).sum(axis=2))

    m = np.stack([rng.uniform(-0.1, 0.1, n), rng.uniform(7.4, 7.7, n)], axis=1)
    one = ordered(fits.fit_gaussian_nd(curves(spark, rng.poisson(3000 * peak(m) + 20)), c))
    assert one["success"].mean() > 0.9 and np.abs(np.array(one["mu"].tolist()) - m).max() < 0.05
    odd = np.arange(n) % 2 == 1
    y = rng.poisson(3000 * peak(m - [0.15, 0.25]) + np.where(odd, 2200, 0)[:, None] * peak(m + [0.15, 0.25]) + 20)
    two = ordered(fits.fit_two_gaussians_nd(curves(spark, y), c, g))
    assert (two["n_peaks"].to_numpy() == np.where(odd, 2, 1)).mean() > 0.9
    far = np.stack([rng.uniform(-0.1, 0.1, n), rng.uniform(8.15, 8.25, n)], axis=1)
    edge = curves(spark, rng.poisson(4000 * peak(far) + 15))
    again = ordered(fits.refit_edges(edge, c, g, fits.fit_gaussian_nd(edge, c).withColumn("st", F.lit(2)), "st", np.diag(s**2)))
    assert (again["source"] == 2).mean() > 0.9 and np.median(np.abs(np.array(again["mu"].tolist())[:, 1] - far[:, 1])) < 0.02


def test_degenerate_curves_fail_quietly(spark):
    c = np.stack(np.meshgrid(np.arange(6.0), np.arange(5.0), indexing="ij")).reshape(2, -1)
    spike = np.zeros(30, int)
    spike[7] = 100
    df = curves(spark, np.stack([np.zeros(30, int), np.full(30, 500), spike]))
    got = fits.fit_gaussian_nd(df, c).toPandas()
    assert (got["success"] == 0).all() and (got["A"] == 0).all()
    assert (fits.fit_two_gaussians_nd(df, c, (6, 5)).toPandas()["n_peaks"] == 0).all()
    assert (fits.fit_gaussian_1d(df, np.arange(30.0)).toPandas()["success"][:2] == 0).all()


# Sinks, recipes, façade, streaming


def test_bundle_round_trip_and_guard(spark, tmp_path):
    data = np.random.default_rng(6).poisson(10, (3, 4, 2, 3))
    cube = make_cube(spark, data, names=("chi", "mu"))
    mask = cube.pixels().where("y > 0")
    mom = M.moments(cube)
    store.save_bundle(str(tmp_path / "b"), cube, {"moments": mom}, {"sig_mask": mask}, {"note": "x"}, masked_only=True)
    b = store.load_bundle(spark, str(tmp_path / "b"))
    assert b.shape == (3, 4) and b.grid == (2, 3) and b.attrs == {"note": "x"} and b.curves.count() == 8
    assert b.dense().count() == 12 and b.results["moments"].count() == 12
    assert store.result_kind(b.results["moments"]) == "moments"
    assert store.long_maps(mom, mask=mask).where("isnan(value)").count() == 4 * (2 + 4)
    with pytest.raises(ValueError):
        store.save_maps(str(tmp_path / "RAW_DATA" / "m"), {"m": mom})


def test_recipe_runs_and_resumes(spark, tmp_path):
    data = np.random.default_rng(7).poisson(3, (5, 5, 20))
    data[1:4, 1:4] += (200 * np.exp(-0.5 * ((np.arange(20) - 9) / 2) ** 2)).astype(int)
    spec = {"output_dir": str(tmp_path), "scans": [{"file": "a", "scan_id": "1.1", "alias": "one"}, {"file": "bad", "scan_id": "2.1"}], "fits": ["moments", "gauss1d", "gaussND"], "preprocess": {"background": {}}}
    recipe = Recipe.from_dict(spec)

    def load(entry):
        if entry.file == "bad":
            raise ValueError("unreadable")
        return make_cube(spark, data)

    first = run(spark, recipe, load, log=lambda _: None)
    assert (first["done"], first["failed"]) == (["one"], ["scan_001"])
    again = run(spark, recipe, load, log=lambda _: None)
    assert again["skipped"] == ["one"]
    row = aggregate(spark, recipe).first()
    assert row["alias"] == "one" and abs(row["gauss1d_mu"] - 9) < 0.2 and row["two_peak_fraction"] is None
    assert Recipe.from_dict(spec | {"fits": ["gaussND", "gauss1d", "moments"]}).recipe_hash() == recipe.recipe_hash()
    with pytest.raises(ValueError, match="output_dir.*unknown fit"):
        Recipe.from_dict({"scans": [{"file": "a", "scan_id": "1"}], "fits": ["magic"]})


def test_dispatch_and_scan(spark):
    rows = []
    for frame, (i, j) in enumerate((i, j) for i in range(6) for j in range(7)):
        px = [int(500 * np.exp(-0.5 * (((i - 2.5 - y * 0.2) / 1) ** 2 + ((j - 3 + x * 0.2) / 1.2) ** 2))) + 5 for y in range(4) for x in range(4)]
        rows.append(("1.1", frame, px, i * 0.1, j * 0.2))
    frames = spark.createDataFrame(rows, "scan_id string, frame int, px array<int>, chi double, mu double")
    scan = Scan.load(frames, "fscan2d chi 0 0.1 6 mu 0 0.2 7 0.1", (4, 4))
    fit = scan.fit_status(scan.analyze(mask=None), mask=None)
    got = fit.toPandas()
    assert (got["fit_status"] == 1).all() and abs(got.loc[(got.y == 0) & (got.x == 0), "mu"].iloc[0][0] - 0.25) < 0.01
    assert scan.mosaicity(fit).count() == 16 and scan.kam(fit).count() == 16
    assert scan.auto_roi(0.5, 0).final_roi() == (0, 4, 0, 4)
    with pytest.raises(ValueError):
        analyze(scan.cube, "gauss1d")


def test_streaming_sums_match_batch(spark, tmp_path):
    data = np.random.default_rng(8).poisson(4, (2, 2, 5, 4))
    cube = make_cube(spark, data)
    rows = cube.voxels.select("scan_id", "y", "x", "v", F.col("i0").cast("double").alias("c0"), F.col("i1").cast("double").alias("c1"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_sums(stream, 2).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = moments_of_sums(spark.table("sums"), 2).orderBy("y", "x").collect()
    want = M.moments(cube).orderBy("y", "x").collect()
    assert np.allclose([r["mu"] for r in got], [r["mu"] for r in want]) and np.allclose([r["cov"] for r in got], [r["cov"] for r in want])


# The registered queries against their SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_queries_match_sql(spark):
    import glob

    import duckdb

    from cubewright.plans import catalog

    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    for name, sql in catalog.oracle_sql().items():
        mine, theirs = catalog.queries()[name](spark, DATA).toPandas(), db.execute(sql).df()
        cols = sorted(mine.columns)
        assert cols == sorted(theirs.columns), name
        rows = [sorted(map(str, d[cols].itertuples(index=False, name=None))) for d in (mine, theirs)]
        assert rows[0] == rows[1], name


def test_local_maxima_take_zeros_beyond_the_ends(spark):
    """The query's operator and the fits' seeds find the same two maxima."""
    import numpy as np

    from cubewright.functions.solver import two_maxima_1d
    from cubewright.operators.grid import local_maxima

    for profile in ([9, 5, 6, 1, 0, 0, 0, 0, 1, 7, 6, 8], [0, 0, 3, 9, 3, 0, 0, 0, 0, 5, 8, 5, 0, 0]):
        rows = [("a", 0, 0, k, v) for k, v in enumerate(profile)]
        got = [r["at"] for r in local_maxima(spark.createDataFrame(rows, "scan_id string, y int, x int, i0 int, v long"), "v").orderBy("k").collect()]
        first, second, two, _ = two_maxima_1d(np.array([profile], float))
        assert got == [int(first[0]), int(second[0])] and two[0]
