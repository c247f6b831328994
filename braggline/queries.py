"""Registered queries of the diffraction operators and their DuckDB counterparts.

Inputs are derived from the driver's tables by fixed arithmetic. The SQL takes other algebra than the operators
(closed forms, quadrature, central differences, identities of round trips), so that agreement says something.
"""

from __future__ import annotations

import math
from itertools import permutations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import crystal, diffract, geometry
from .functions import linalg as la
from .operators import bandjoin, forward, hkl, scan, splat
from .operators.forward import Detector, Setup
from .operators.peaks import peaks_to_q as to_q
from .plans import sql as sql_functions

TILTED = Setup(Detector(1000, 50, -0.36, 900, 65, 0.17, 0.2, 130e3), 0.1, wedge=5, chi=10)
GENERAL = Setup(
    Detector(1000, 75, 0.01, 1024, 70, -0.02, 0.03, 180e3, 1, 0, 0, -1), 0.3, ky=1e-4, kz=-2e-4, wedge=-3, chi=1, y0=2.5,
    sigma={"ox": 5, "oy": 10, "oz": 2, "wavelength": 1e-5, "ky": 1e-4, "kz": 2e-4},
)
FE, TI, CEO2 = 2.8630355, (2.93573192, 2.93573192, 4.64085615, 90.0, 90.0, 120.0), 5.4112
FEW_HKLS = [(1, 1, 0), (-1, 0, 1), (0, 1, 1), (2, 0, 0), (1, 2, -1), (2, -1, 1), (-2, 1, 1), (2, 2, 0)]
STEP, GRIDSTEP, Y0, SHAPE, YSTEP = 0.5, 2, 0.25, (31, 28), 1.5
AXES = [splat.Axis("sc", 0, 1, 60, 7), splat.Axis("fc", 0, 1, 50, 7), splat.Axis("omega", -1, 0.05, 41, 5)]
ACTIVE = (0.25, 0.5)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(F.col(n), digits) for n in names})


# plain matrices for the SQL
def _rot(axis: str, rad: float) -> list[list[float]]:
    c, s = math.cos(rad), math.sin(rad)
    return {"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis]


def _mul(*ms):
    out = ms[0]
    for m in ms[1:]:
        out = [[sum(out[i][k] * m[k][j] for k in range(len(m))) for j in range(len(m[0]))] for i in range(len(out))]
    return out


def _trans(d: Detector):
    return _mul(_rot("x", d.tilt_x), _rot("y", d.tilt_y), _rot("z", d.tilt_z), [[0, 0, 1], [0, 1, 0], [1, 0, 0]], [[d.o11, d.o12, 0], [d.o21, d.o22, 0], [0, 0, 1]], [[d.z_size, 0, 0], [0, d.y_size, 0], [0, 0, 1]])


def _tilt(s: Setup):
    return _mul(_rot("y", math.radians(s.wedge)), _rot("x", math.radians(s.chi)))


def _times(m, xyz: tuple[str, str, str], by_columns: bool = False) -> list[str]:
    m = list(zip(*m, strict=True)) if by_columns else m
    return [" + ".join(f"({c!r}) * {x}" for c, x in zip(row, xyz, strict=True)) for row in m]


def sr(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


# observed peaks
PEAKS_SQL = "SELECT o_orderkey AS peak_id, CAST(o_totalprice AS DOUBLE) % 2048 AS sc, CAST((o_orderkey * 37) % 2048 AS DOUBLE) AS fc, CAST(o_orderkey % 360 - 180 AS DOUBLE) AS omega FROM orders"


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("peak_id"), (F.col("o_totalprice").cast("double") % 2048).alias("sc"), ((F.col("o_orderkey") * 37) % 2048).cast("double").alias("fc"), (F.col("o_orderkey") % 360 - 180).cast("double").alias("omega"))


def _to_q_sql(s: Setup) -> str:
    m, w, d = _trans(s.detector), _tilt(s), s.detector
    lab = _times(m, (f"(sc - {d.z_center!r})", f"(fc - {d.y_center!r})", "0"))
    back = _times(w, ("qa", "qb", "qc"), by_columns=True)
    return f"""WITH p AS ({PEAKS_SQL}), a AS (SELECT *, {lab[0]} + {d.distance!r} AS x, {lab[1]} AS y, {lab[2]} AS z FROM p),
b AS (SELECT *, (x / sqrt(x*x + y*y + z*z) - 1) / {s.wavelength!r} AS qa, y / sqrt(x*x + y*y + z*z) / {s.wavelength!r} AS qb, z / sqrt(x*x + y*y + z*z) / {s.wavelength!r} AS qc FROM a),
c AS (SELECT *, {back[0]} AS ta, {back[1]} AS tb, {back[2]} AS tc, degrees(acos(x / sqrt(x*x + y*y + z*z))) AS tth, degrees(atan2(-y, z)) AS eta FROM b)
SELECT peak_id, tth, eta, 2 * sin(radians(tth) / 2) / {s.wavelength!r} AS ds, cos(radians(omega)) * ta + sin(radians(omega)) * tb AS qx, -sin(radians(omega)) * ta + cos(radians(omega)) * tb AS qy, tc AS qz FROM c"""


@query(f"SELECT peak_id, {', '.join(f'{sr(n, 5)} AS {n}' for n in ('tth', 'eta', 'ds', 'qx', 'qy', 'qz'))} FROM ({_to_q_sql(TILTED)})")
def peaks_to_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: detector places and angles to scattering vectors."""
    return rounded(to_q(peaks(spark, sf_dir), TILTED).drop("sc", "fc", "omega"), ("tth", "eta", "ds", "qx", "qy", "qz"), 5)


@query(f"SELECT CAST(floor(tth / 0.1) AS BIGINT) AS bin, count(*) AS n, {sr('avg(ds)')} AS mean_ds FROM ({_to_q_sql(TILTED)}) GROUP BY 1")
def powder_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = to_q(peaks(spark, sf_dir), TILTED)
    return q.groupBy(F.floor(F.col("tth") / 0.1).alias("bin")).agg(F.count("*").alias("n"), r(F.avg("ds")).alias("mean_ds"))


@query(f"SELECT peak_id, {sr('sc')} AS sc, {sr('fc')} AS fc, {sr('sc')} AS ray_sc, {sr('fc')} AS ray_fc FROM ({PEAKS_SQL})")
def detector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_to_lab, then back by lab_to_det, and by raytrace_to_det from a point off the axis."""
    d = TILTED.detector
    trans = la.matrix(*(x for row in _trans(d) for x in row))
    t = (trans, la.vector(-d.z_center, -d.y_center, 0), la.vector(d.distance, 0, 0))
    origin, basis = (100.0, -50.0, 20.0), [la.vector(*p) for p in d.basis()]
    s = la.Stage(peaks(spark, sf_dir))
    lab = s.put(lab=la.v3(geometry.det_to_lab(F.col("sc"), F.col("fc"), *t)))
    ray = s.put(ray=tuple(x - o for x, o in zip(lab, origin, strict=True)))
    at, pixel = geometry.raytrace_to_det(la.vec_struct(ray), la.vector(*origin), *basis), geometry.lab_to_det(*lab, *t)
    return s.df.select("peak_id", r(pixel["sc"]).alias("sc"), r(pixel["fc"]).alias("fc"), r(at["sc"]).alias("ray_sc"), r(at["fc"]).alias("ray_fc"))


_DET = "s_suppkey, 1000 + s_suppkey AS yc, 900 - s_suppkey AS zc, s_suppkey * 0.003 AS ty, s_suppkey * -0.002 AS tz, s_suppkey * 0.001 AS tx"


@query(f"""WITH d AS (SELECT {_DET} FROM supplier), m AS (SELECT *, -50 * (cos(tx) * sin(ty) * cos(tz) - sin(tx) * sin(tz)) AS nope, 70 * sin(ty) AS m00, -50 * cos(ty) * sin(tz) AS m01, -70 * sin(tx) * cos(ty) AS m10, 50 * (cos(tx) * cos(tz) - sin(tx) * sin(ty) * sin(tz)) AS m11, 70 * cos(tx) * cos(ty) AS m20, 50 * (sin(tx) * cos(tz) + cos(tx) * sin(ty) * sin(tz)) AS m21 FROM d)
SELECT s_suppkey, {sr('m00')} AS m00, {sr('m01')} AS m01, {sr('m10')} AS m10, {sr('m11')} AS m11, {sr('m20')} AS m20, {sr('m21')} AS m21, {sr('200000 - zc * m00 - yc * m01')} AS x00, {sr('(1 - zc) * m10 - yc * m11')} AS y10, {sr('(1 - yc) * m21 - zc * m20')} AS z01 FROM m""")
def detector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detector a supplier: transforms and basis vectors."""
    k = F.col("s_suppkey").cast("double")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", geometry.detector_transforms(1000 + k, 50, k * 0.003, 900 - k, 70, k * -0.002, k * 0.001, 200e3, 1, 0, 0, 1).alias("t"))
    df = df.withColumn("b", geometry.detector_basis_vectors_lab(F.col("t.trans"), F.col("t.shift_c"), F.col("t.shift_x")))
    entries = [r(F.col(f"t.trans.m{i}{j}")).alias(f"m{i}{j}") for i in range(3) for j in range(2)]
    return df.select("s_suppkey", *entries, r(F.col("b.norm_lab.x")).alias("x00"), r(F.col("b.sc_lab.y")).alias("y10"), r(F.col("b.fc_lab.z")).alias("z01"))


@query(f"SELECT peak_id, {sr('sc / 100')} AS tth, {sr('CASE WHEN sc = 0 THEN 0 ELSE fc / 6 - 170 END')} AS eta, {sr('2 * sin(radians(sc / 100) / 2) / 0.25')} AS ds FROM ({PEAKS_SQL})")
def tth_eta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles to an outgoing beam, to a scattering vector, and back."""
    df = peaks(spark, sf_dir).withColumn("k", diffract.tth_eta_to_k_out(F.col("sc") / 100, F.col("fc") / 6 - 170, 0.25))
    k_in = diffract.scale_norm_k(la.vector(1, 0, 0), 0.25)
    df = df.withColumn("q", diffract.k_to_q_lab(k_in, F.col("k"))).withColumn("a", diffract.q_lab_to_tth_eta(F.col("q"), 0.25))
    return df.select("peak_id", r(F.col("a.tth")).alias("tth"), r(F.col("a.eta")).alias("eta"), r(diffract.q_to_ds(F.col("q"))).alias("ds"))


# goniometer
_VEC = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) - 25 AS x, CAST(l_extendedprice AS DOUBLE) / 1000 - 50 AS y, CAST(l_discount AS DOUBLE) * 1000 - 50 AS z, CAST(l_orderkey % 360 - 180 AS DOUBLE) AS w, CAST(l_linenumber AS DOUBLE) AS dty FROM lineitem"
_WC = _mul(_rot("y", math.radians(5)), _rot("x", math.radians(10)))
_TURNED = _times(_WC, ("(cos(radians(w)) * x - sin(radians(w)) * y)", "(sin(radians(w)) * x + cos(radians(w)) * y)", "z"))


@query(f"""WITH v AS ({_VEC}), t AS (SELECT *, {_TURNED[0]} AS a, {_TURNED[1]} AS b, {_TURNED[2]} AS c FROM v)
SELECT l_orderkey, l_linenumber, {sr('a')} AS lab_x, {sr('b + dty - 0.5')} AS lab_y, {sr('c')} AS lab_z, {sr('x')} AS x, {sr('y')} AS y, {sr('z')} AS z, {sr('0.001 * a - b + 0.5')} AS beam_dty FROM t""")
def goniometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample to lab and back, and the translation that brings a point into the beam."""
    d = lambda n: F.col(n).cast("double")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", la.vector(d("l_quantity") - 25, d("l_extendedprice") / 1000 - 50, d("l_discount") * 1000 - 50).alias("v"), (F.col("l_orderkey") % 360 - 180).cast("double").alias("w"), d("l_linenumber").alias("dty"))
    df = df.withColumn("lab", geometry.sample_to_lab(F.col("v"), F.col("w"), 5, 10, F.col("dty"), 0.5))
    df = df.withColumn("back", geometry.lab_to_sample(F.col("lab"), F.col("w"), 5, 10, F.col("dty"), 0.5)).withColumn("beam_dty", geometry.find_dty_for_beam_xy(F.col("v"), la.vector(1, 0.001, 0), F.col("w"), 5, 10, 0.5))
    return df.select("l_orderkey", "l_linenumber", *(r(F.col(f"lab.{c}")).alias(f"lab_{c}") for c in "xyz"), *(r(F.col(f"back.{c}")).alias(c) for c in "xyz"), r(F.col("beam_dty")).alias("beam_dty"))


_Q = "cos(radians(t) / 2) AS qw, sin(radians(t) / 2) * x / n AS qx, sin(radians(t) / 2) * y / n AS qy, sin(radians(t) / 2) * z / n AS qz"


@query(f"""WITH a AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 7 AS DOUBLE) - 3 AS y, CAST(p_partkey % 11 AS DOUBLE) - 5 AS z, CAST(p_partkey % 360 AS DOUBLE) AS t FROM part), b AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM a), c AS (SELECT p_partkey, {_Q} FROM b)
SELECT p_partkey, {sr('1 - 2 * (qy*qy + qz*qz)')} AS m00, {sr('2 * (qx*qy - qw*qz)')} AS m01, {sr('2 * (qx*qz + qw*qy)')} AS m02, {sr('2 * (qx*qy + qw*qz)')} AS m10, {sr('1 - 2 * (qx*qx + qz*qz)')} AS m11, {sr('2 * (qy*qz - qw*qx)')} AS m12, {sr('2 * (qx*qz - qw*qy)')} AS m20, {sr('2 * (qy*qz + qw*qx)')} AS m21, {sr('1 - 2 * (qx*qx + qy*qy)')} AS m22 FROM c""")
def axis_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation matrices by axis and angle; the SQL goes by quaternions."""
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select("p_partkey", geometry.rmat_from_axis_angle(la.vector(F.col("p_size").cast("double"), (k % 7).cast("double") - 3, (k % 11).cast("double") - 5), (k % 360).cast("double")).alias("m"))
    return df.select("p_partkey", *(r(F.col(f"m.{n}")).alias(n) for n in la.NAMES))


# crystal
_CELL = "SELECT p_partkey, 3 + p_size / 10.0 AS a, 3.2 + p_size / 10.0 AS b, 3.5 + p_size / 10.0 AS c, 85.0 + p_partkey % 11 AS al, 88.0 + p_partkey % 5 AS be, 95.0 - p_partkey % 7 AS ga FROM part"
_CELL_SQL = f"""WITH p AS (SELECT p_partkey, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, cos(radians(CAST(al AS DOUBLE))) AS ca, cos(radians(CAST(be AS DOUBLE))) AS cb, cos(radians(CAST(ga AS DOUBLE))) AS cg, sin(radians(CAST(al AS DOUBLE))) AS sa, sin(radians(CAST(be AS DOUBLE))) AS sb, sin(radians(CAST(ga AS DOUBLE))) AS sg FROM ({_CELL})),
v AS (SELECT *, a * b * c * sqrt(1 - ca*ca - cb*cb - cg*cg + 2*ca*cb*cg) AS vol FROM p)"""


@query(f"""{_CELL_SQL} SELECT p_partkey, {sr('vol')} AS volume, {sr('b*c*sa/vol')} AS ra, {sr('a*c*sb/vol')} AS rb, {sr('a*b*sg/vol')} AS rc, {sr('degrees(acos((cb*cg - ca)/(sb*sg)))')} AS ralpha, {sr('degrees(acos((ca*cg - cb)/(sa*sg)))')} AS rbeta, {sr('degrees(acos((ca*cb - cg)/(sa*sb)))')} AS rgamma,
{sr('b*c*sa/vol')} AS b00, {sr('a*c/vol*(ca*cb - cg)/sa')} AS b01, {sr('a*b/vol*(ca*cg - cb)/sa')} AS b02, {sr('1/(b*sa)')} AS b11, {sr('-ca/(c*sa)')} AS b12_other, {sr('1/c')} AS b22 FROM v""".replace(sr("-ca/(c*sa)") + " AS b12_other", sr("-ca/(c*sa)") + " AS b12"))
def unit_cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric tensor, volume, reciprocal cell and B; the SQL goes by the textbook formulas."""
    k, s = F.col("p_partkey"), F.col("p_size") / 10.0
    df = table(spark, sf_dir, "part").select("p_partkey", crystal.lpars(3 + s, 3.2 + s, 3.5 + s, 85.0 + k % 11, 88.0 + k % 5, 95.0 - k % 7).alias("p"))
    df = df.withColumn("g", crystal.lpars_to_mt(F.col("p"))).withColumn("gr", crystal.mt_to_rmt(F.col("g"))).withColumn("rl", crystal.mt_to_lpars(F.col("gr"))).withColumn("bmat", crystal.lpars_rlpars_to_B(F.col("p"), F.col("rl")))
    names = {"ra": "a", "rb": "b", "rc": "c", "ralpha": "alpha", "rbeta": "beta", "rgamma": "gamma"}
    return df.select("p_partkey", r(crystal.metric_to_volume(F.col("g"))).alias("volume"), *(r(F.col(f"rl.{v}")).alias(n) for n, v in names.items()), *(r(F.col(f"bmat.m{i}")).alias(f"b{i}") for i in ("00", "01", "02", "11", "12", "22")))


@query(f"""{_CELL_SQL}, h AS (SELECT *, p_partkey % 3 - 1 AS h, p_partkey % 5 - 2 AS k, p_partkey % 7 - 3 AS l FROM v)
SELECT p_partkey, {sr('b*c*sa/vol*h + a*c/vol*(ca*cb - cg)/sa*k + a*b/vol*(ca*cg - cb)/sa*l')} AS qx, {sr('k/(b*sa) - ca/(c*sa)*l')} AS qy, {sr('l/c')} AS qz,
{sr('sqrt(greatest(0, (h*b*c*sa)*(h*b*c*sa) + (k*a*c*sb)*(k*a*c*sb) + (l*a*b*sg)*(l*a*b*sg) + 2*h*k*a*b*c*c*(ca*cb - cg) + 2*k*l*a*a*b*c*(cb*cg - ca) + 2*h*l*a*b*b*c*(ca*cg - cb))) / vol')} AS ds FROM h""")
def crystal_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattering vectors of the crystal frame by B from the reciprocal metric; d* by the triclinic formula in the SQL."""
    k, s = F.col("p_partkey"), F.col("p_size") / 10.0
    df = table(spark, sf_dir, "part").select("p_partkey", crystal.lpars(3 + s, 3.2 + s, 3.5 + s, 85.0 + k % 11, 88.0 + k % 5, 95.0 - k % 7).alias("p"), la.vector((k % 3 - 1).cast("double"), (k % 5 - 2).cast("double"), (k % 7 - 3).cast("double")).alias("hkl"))
    df = df.withColumn("gr", crystal.mt_to_rmt(crystal.lpars_to_mt(F.col("p")))).withColumn("rl", crystal.rmt_to_rlpars(F.col("gr"))).withColumn("pl", crystal.mt_to_lpars(crystal.rmt_to_mt(F.col("gr"))))
    df = df.withColumn("bmat", crystal.lpars_rlpars_to_B(F.col("pl"), F.col("rl"))).withColumn("q", crystal.hkl_B_to_q_crystal(F.col("hkl"), F.col("bmat")))
    return df.select("p_partkey", *(r(F.col(f"q.{c}")).alias(f"q{c}") for c in "xyz"), r(diffract.q_to_ds(F.col("q"))).alias("ds"))


@query(f"""WITH e AS (SELECT vec_id, embedding AS v FROM embeddings), m AS (SELECT vec_id, {', '.join(f'CAST(v[{3 * i + j + 1}] AS DOUBLE) + {float(3 * (i == j))} AS u{i}{j}' for i in range(3) for j in range(3))} FROM e),
l AS (SELECT *, sqrt(u00*u00 + u01*u01 + u02*u02) AS a, sqrt(u10*u10 + u11*u11 + u12*u12) AS b, sqrt(u20*u20 + u21*u21 + u22*u22) AS c, abs(u00*(u11*u22 - u12*u21) - u01*(u10*u22 - u12*u20) + u02*(u10*u21 - u11*u20)) AS vol FROM m)
SELECT vec_id, {sr('a')} AS a, {sr('b')} AS b, {sr('c')} AS c, {sr('degrees(acos((u10*u20 + u11*u21 + u12*u22)/(b*c)))')} AS alpha, {sr('degrees(acos((u00*u20 + u01*u21 + u02*u22)/(a*c)))')} AS beta, {sr('degrees(acos((u00*u10 + u01*u11 + u02*u12)/(a*b)))')} AS gamma, {sr('vol')} AS volume, 1.0 AS orthogonal,
{sr('u20/c')} AS u02, {sr('u21/c')} AS u12, {sr('u22/c')} AS u22 FROM l""")
def grain_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grains from embeddings: cell and orientation of a UBI. The last column of U is the direction of the third axis."""
    at = lambda n: F.get("embedding", n).cast("double")
    df = table(spark, sf_dir, "embeddings").select("vec_id", la.matrix(*(at(3 * i + j) + 3.0 * (i == j) for i in range(3) for j in range(3))).alias("ubi"))
    df = crystal.grains(df)
    return df.select("vec_id", *(r(F.col(f"p.{n}")).alias(n) for n in crystal.LPARS), r(crystal.metric_to_volume(F.col("g"))).alias("volume"), r(F.abs(la.det3(la.m3(F.col("U"))))).alias("orthogonal"), *(r(F.col(f"U.m{i}2")).alias(f"u{i}2") for i in range(3)))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt to tasks of about so many rows each, the session's partitions at least: a small file is read in one task, whatever is made of its
    rows. The rows are counted, which a Parquet file's footer tells."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(df.count() / rows)), key)


def cell(spark: SparkSession, name: str, *p: float) -> DataFrame:
    return spark.createDataFrame([(name, *map(float, p))], "structure_id string, a double, b double, c double, alpha double, beta double, gamma double")


def cells_of(df: DataFrame, key: str, a, b, c, alpha=90, beta=90, gamma=90) -> DataFrame:
    """A cell for each row, by columns or numbers."""
    column = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return df.select(F.col(key).alias("structure_id"), *(column(v).alias(n) for n, v in zip(crystal.LPARS, (a, b, c, alpha, beta, gamma), strict=True)))


def sites_of(df: DataFrame, key: str, *sites: tuple[str, float, float, float]) -> DataFrame:
    """The same atoms for each row."""
    site = lambda e, *at: F.struct(F.lit(e).alias("element"), *(F.lit(float(v)).alias(n) for n, v in zip("xyz", at, strict=True)), F.lit(1.0).alias("occ"))
    return df.select(F.col(key).alias("structure_id"), F.explode(F.array(*(site(*x) for x in sites))).alias("s")).select("structure_id", "s.*")


#: A cubic edge for each supplier: from 1 to 1.5 times the given one.
_EDGE = "{0!r}::DOUBLE * (1 + (s_suppkey % 50) / 100)"


def edge(a: float) -> Column:
    return F.lit(a) * (1 + (F.col("s_suppkey") % 50) / 100)


def _series(n: int, name: str) -> str:
    return f"(SELECT CAST(unnest(generate_series({-n}, {n})) AS BIGINT) AS {name})"


def _hkl(n: int, m: int) -> str:
    return f"{_series(n, 'h')}, {_series(n, 'k')}, {_series(m, 'l')}"


_HKL_RANGE = _hkl(6, 6)


@query(f"""WITH p AS (SELECT p_partkey, 2.5::DOUBLE + p_size / 50 AS a, 4 + (p_partkey % 7) / 5 AS c FROM part), q AS (SELECT p_partkey, h, k, l, sqrt(4.0 / 3 * (h*h + h*k + k*k) / (a * a) + l*l / (c * c)) AS ds FROM p, {_hkl(4, 5)})
SELECT p_partkey, h, k, l, {sr('ds')} AS ds, {sr('2 * degrees(asin(ds * 0.3 / 2))')} AS tth FROM q WHERE ds > 0 AND ds < 0.8""")
def hexagonal_hkls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflections of a hexagonal cell for each part."""
    a, c = 2.5 + F.col("p_size") / 50, 4 + (F.col("p_partkey") % 7) / 5
    found = hkl.make_hkls(cells_of(table(spark, sf_dir, "part"), "p_partkey", a, a, c, 90, 90, 120), 0.8, 0.3)
    return rounded(found.withColumnRenamed("structure_id", "p_partkey"), ("ds", "tth"))


@query(f"""{_CELL_SQL}, q AS (SELECT p_partkey, h, k, l, sqrt(greatest(0, (h*b*c*sa)*(h*b*c*sa) + (k*a*c*sb)*(k*a*c*sb) + (l*a*b*sg)*(l*a*b*sg) + 2*h*k*a*b*c*c*(ca*cb - cg) + 2*k*l*a*a*b*c*(cb*cg - ca) + 2*h*l*a*b*b*c*(ca*cg - cb))) / vol AS ds FROM v, {_hkl(6, 6)})
SELECT p_partkey, h, k, l, {sr('ds')} AS ds, {sr('2 * degrees(asin(ds * 0.2 / 2))')} AS tth FROM q WHERE ds > 0 AND ds < 0.6""")
def triclinic_hkls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflections of a triclinic cell for each part; d* by the triclinic formula over a whole box in the SQL."""
    k, s = F.col("p_partkey"), F.col("p_size") / 10.0
    cells = cells_of(table(spark, sf_dir, "part"), "p_partkey", 3 + s, 3.2 + s, 3.5 + s, 85.0 + k % 11, 88.0 + k % 5, 95.0 - k % 7)
    return rounded(hkl.make_hkls(cells, 0.6, 0.2, metric=True).withColumnRenamed("structure_id", "p_partkey"), ("ds", "tth"))


@query(f"""WITH p AS (SELECT s_suppkey, {_EDGE.format(FE)} AS a FROM supplier), q AS (SELECT s_suppkey, a, h, k, l, h*h + k*k + l*l AS s FROM p, {_hkl(8, 8)} WHERE (h + k + l) % 2 = 0), u AS (SELECT *, sqrt(s) / a AS ds FROM q WHERE s > 0 AND sqrt(s) / a < 1.8)
SELECT s_suppkey, CAST(dense_rank() OVER (PARTITION BY s_suppkey ORDER BY s) - 1 AS BIGINT) AS ring_id, {sr('min(ds)')} AS ds, {sr('min(2 * degrees(asin(ds * 0.3 / 2)))')} AS tth, count(*) AS mult FROM u GROUP BY s_suppkey, s""")
def rings_iron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of strained iron for each supplier, by structure factors and single linkage; the SQL by the rule of body-centred lattices."""
    s = table(spark, sf_dir, "supplier")
    sites = sites_of(s, "s_suppkey", ("Fe", 0, 0, 0), ("Fe", 0.5, 0.5, 0.5))
    cells = cells_of(s, "s_suppkey", edge(FE), edge(FE), edge(FE))
    tasks = hkl.tasks_of(cells, 1.8)
    found = hkl.rings_table(hkl.make_hkls(cells, 1.8, 0.3, tasks=tasks), sites, tasks=tasks)
    return rounded(hkl.rings(found).select(F.col("structure_id").alias("s_suppkey"), "ring_id", "ds", "tth", "mult"), ("ds", "tth"))


CERIA = [("Ce", x, y, z) for x, y, z in ((0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0))] + [("O", x, y, z) for x in (0.25, 0.75) for y in (0.25, 0.75) for z in (0.25, 0.75)]


def _form(e: str) -> str:
    *ab, c = hkl.FORM_FACTORS[e]
    return " + ".join(f"{a!r} * exp(-({b!r}) * ds * ds / 4)" for a, b in zip(ab[:4], ab[4:], strict=True)) + f" + {c!r}"


@query(f"""WITH p AS (SELECT s_suppkey, {_EDGE.format(CEO2)} AS a FROM supplier), q AS (SELECT s_suppkey, h, k, l, sqrt(h*h + k*k + l*l) / a AS ds FROM p, {_hkl(8, 8)} WHERE abs(h % 2) = abs(k % 2) AND abs(k % 2) = abs(l % 2)),
f AS (SELECT *, {_form('Ce')} AS ce, {_form('O')} AS o FROM q WHERE ds > 0 AND ds < 0.9)
SELECT s_suppkey, h, k, l, {sr('CASE WHEN abs(h % 2) = 1 THEN 16 * ce * ce WHEN (h + k + l) % 4 = 0 THEN (4 * ce + 8 * o) * (4 * ce + 8 * o) ELSE (4 * ce - 8 * o) * (4 * ce - 8 * o) END', 4)} AS intensity FROM f""")
def ceria_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure factors of strained CeO2 for each supplier; the SQL by the rules of the fluorite structure."""
    s = table(spark, sf_dir, "supplier")
    cells = cells_of(s, "s_suppkey", edge(CEO2), edge(CEO2), edge(CEO2))
    tasks = hkl.tasks_of(cells, 0.9)
    got = hkl.intensity(hkl.make_hkls(cells, 0.9, 0.3, tasks=tasks), sites_of(s, "s_suppkey", *CERIA), tasks=tasks)
    return got.where(F.col("intensity") > hkl.LEAST_INTENSITY).select(F.col("structure_id").alias("s_suppkey"), "h", "k", "l", r(F.col("intensity"), 4).alias("intensity"))


def cubic_ops(df: DataFrame, key: str) -> DataFrame:
    """The 48 rotations of a cube for each row."""
    rots = [tuple(s[i] * (p[i] == j) for i in range(3) for j in range(3)) for p in permutations(range(3)) for s in product((1.0, -1.0), repeat=3)]
    return df.select(F.col(key).alias("structure_id"), F.explode(F.array(*(la.matrix(*x) for x in rots))).alias("rot"))


@query(f"""WITH p AS (SELECT s_suppkey, {_EDGE.format(FE)} AS a FROM supplier)
SELECT s_suppkey, h, k, l, {sr('sqrt(h*h + k*k + l*l) / a')} AS ds FROM p, {_hkl(6, 6)} WHERE h >= k AND k >= l AND l >= 0 AND h > 0 AND sqrt(h*h + k*k + l*l) / a < 1.3""")
def unique_hkls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reflection of each orbit of the cubic group, for each supplier's cell."""
    s = table(spark, sf_dir, "supplier")
    cells = cells_of(s, "s_suppkey", edge(FE), edge(FE), edge(FE))
    tasks = hkl.tasks_of(cells, 1.3)
    kept = hkl.remove_equivalents(hkl.make_hkls(cells, 1.3, 0.3, tasks=tasks), cubic_ops(dealt(s.select("s_suppkey"), "s_suppkey", 5000), "s_suppkey"), tasks=tasks)
    return kept.select(F.col("structure_id").alias("s_suppkey"), "h", "k", "l", r(F.col("ds")).alias("ds"))


@query("""WITH v AS (SELECT DISTINCT p_size, CAST(p_retailprice AS DOUBLE) AS x FROM part), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY p_size ORDER BY x) > 2.5 THEN 1 ELSE 0 END AS n FROM v)
SELECT p_size, x, CAST(sum(n) OVER (PARTITION BY p_size ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_id FROM g""")
def linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage groups of prices within each size."""
    v = table(spark, sf_dir, "part").select("p_size", F.col("p_retailprice").cast("double").alias("x")).distinct()
    return hkl.groupby_isclose(v, "x", 2.5, key="p_size", out="group_id")


# Ewald condition and forward model
_OMEGA_CORE = """SELECT *, a*a + b*b AS r2, sqrt(greatest(a*a + b*b, 1e-7)) AS rr FROM ({0})"""


def _omega_sql(source: str) -> str:
    """source has a, b, d, eta."""
    return f"""SELECT *, degrees(atan2(sin(w), cos(w))) AS omega, abs(d / rr) <= 1 AND r2 >= 1e-7 AS valid FROM (SELECT *, eta * asin(least(greatest(d / rr, -1 + 1e-6), 1 - 1e-6)) - atan2(a / rr, b / rr) - (1 - eta) * pi() / 2 AS w FROM ({_OMEGA_CORE.format(source)}))"""


_PART_Q = "SELECT p_partkey, CAST(p_partkey % 5 - 2 AS DOUBLE) / 4 AS qx, CAST(p_partkey % 7 - 3 AS DOUBLE) / 4 AS qy, CAST(p_size % 9 - 4 AS DOUBLE) / 4 AS qz FROM part"


@query(f"""SELECT p_partkey, eta AS etasign, CASE WHEN qx <> 0 OR qy <> 0 THEN {sr('omega')} END AS omega, valid FROM ({_omega_sql(f"SELECT *, qx / 0.3 AS a, -qy / 0.3 AS b, -(qx*qx + qy*qy + qz*qz) / 2 AS d FROM ({_PART_Q}), (VALUES (1.0), (-1.0)) t(eta)")})""")
def omega_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select("p_partkey", la.vector((k % 5 - 2).cast("double") / 4, (k % 7 - 3).cast("double") / 4, (F.col("p_size") % 9 - 4).cast("double") / 4).alias("q"))
    df = df.withColumn("etasign", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).withColumn("s", diffract.omega_solns(F.col("q"), F.col("etasign"), la.vector(1 / 0.3, 0, 0)))
    # along the axis the angle hangs on the sign of a zero
    return df.select("p_partkey", "etasign", F.when((F.col("q.x") != 0) | (F.col("q.y") != 0), r(F.col("s.omega"))).alias("omega"), F.col("s.valid").alias("valid"))


_GRAINS = "SELECT s_suppkey, CAST(s_suppkey * 7 AS DOUBLE) AS gz, CAST(s_suppkey * 3 AS DOUBLE) AS gx, CAST(s_suppkey % 21 - 10 AS DOUBLE) * 10 AS ox, CAST(s_suppkey % 17 - 8 AS DOUBLE) * 10 AS oy, CAST(s_suppkey % 13 - 6 AS DOUBLE) * 5 AS oz FROM supplier"
_FEW = ", ".join(f"({a}, {b}, {c})" for a, b, c in FEW_HKLS)


def forward_rows(s: Setup) -> str:
    return f"SELECT *, {s.wavelength!r} AS lam, {s.ky!r} AS ky, {s.kz!r} AS kz FROM ({_GRAINS}), (VALUES {_FEW}) h(h, k, l), (VALUES (1.0), (-1.0)) e(eta)"


def forward_sql(s: Setup, rows: str, scan_mode: bool) -> str:
    """All of a row's columns with sc, fc, omega, dty and valid; the ray meets the plane by its distance along it."""
    w, d = _tilt(s), s.detector
    m = _trans(d)
    e1, e2 = ([row[i] for row in m] for i in (0, 1))
    at0 = [-d.z_center * a - d.y_center * b + (d.distance if i == 0 else 0) for i, (a, b) in enumerate(zip(e1, e2, strict=True))]
    n = [e1[1] * e2[2] - e1[2] * e2[1], e1[2] * e2[0] - e1[0] * e2[2], e1[0] * e2[1] - e1[1] * e2[0]]
    g11, g12, g22 = sum(a * a for a in e1), sum(a * b for a, b in zip(e1, e2, strict=True)), sum(b * b for b in e2)
    det = g11 * g22 - g12 * g12
    dual = [[(g22 * a - g12 * b) / det for a, b in zip(e1, e2, strict=True)], [(g11 * b - g12 * a) / det for a, b in zip(e1, e2, strict=True)]]
    ks = _times(w, ("bx", "by_", "bz"), by_columns=True)
    spun = lambda x, y, z: _times(w, (f"(cos(radians(omega)) * {x} - sin(radians(omega)) * {y})", f"(sin(radians(omega)) * {x} + cos(radians(omega)) * {y})", z))
    q, o = spun("qx", "qy", "qz"), spun("ox", "oy", "oz")
    return f"""WITH a0 AS ({rows}),
a1 AS (SELECT *, (cos(radians(gz)) * h - sin(radians(gz)) * (cos(radians(gx)) * k - sin(radians(gx)) * l)) / {FE!r} AS qx, (sin(radians(gz)) * h + cos(radians(gz)) * (cos(radians(gx)) * k - sin(radians(gx)) * l)) / {FE!r} AS qy, (sin(radians(gx)) * k + cos(radians(gx)) * l) / {FE!r} AS qz, 1 / (lam * sqrt(1 + ky*ky + kz*kz)) AS bx FROM a0),
a2 AS (SELECT *, bx * ky AS by_, bx * kz AS bz FROM a1),
a3 AS (SELECT *, {ks[0]} AS kx_, {ks[1]} AS ky_, {ks[2]} AS kz_ FROM a2),
a4 AS ({_omega_sql("SELECT *, kx_ * qx + ky_ * qy AS a, ky_ * qx - kx_ * qy AS b, -(qx*qx + qy*qy + qz*qz) / 2 - kz_ * qz AS d FROM a3")}),
a5 AS (SELECT *, bx + {q[0]} AS vx, by_ + {q[1]} AS vy, bz + {q[2]} AS vz, {o[0]} AS px, {o[1]} AS py, {o[2]} AS pz FROM a4),
a6 AS (SELECT *, {"ky * px - py + " + repr(s.y0) if scan_mode else "0.0"} AS dty FROM a5),
a7 AS (SELECT *, {f"py + dty - {s.y0!r}" if scan_mode else "py"} AS py2 FROM a6),
a8 AS (SELECT *, (({n[0]!r}) * (({at0[0]!r}) - px) + ({n[1]!r}) * (({at0[1]!r}) - py2) + ({n[2]!r}) * (({at0[2]!r}) - pz)) / (({n[0]!r}) * vx + ({n[1]!r}) * vy + ({n[2]!r}) * vz) AS t FROM a7),
a9 AS (SELECT *, px + t * vx - ({at0[0]!r}) AS ex, py2 + t * vy - ({at0[1]!r}) AS ey, pz + t * vz - ({at0[2]!r}) AS ez FROM a8)
SELECT *, {_times(dual, ("ex", "ey", "ez"))[0]} AS sc, {_times(dual, ("ex", "ey", "ez"))[1]} AS fc FROM a9"""


def grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grain a supplier: an iron crystal turned by the key."""
    k = F.coalesce("s_suppkey", F.lit(0))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", (k * 7).cast("double").alias("gz"), (k * 3).cast("double").alias("gx"), (k % 21 - 10).cast("double").alias("ox"), (k % 17 - 8).cast("double").alias("oy"), (k % 13 - 6).cast("double").alias("oz"))
    turns = {f"{f.__name__}_{n}": f(F.radians(F.col(f"g{n}"))) for n in "zx" for f in (F.cos, F.sin)}
    df = df.withColumns(turns)
    cz, sz, cx, sx = map(F.col, turns)
    # rows of the transposed Rz Rx
    turned = ((cz, sz, F.lit(0.0)), (-sz * cx, cz * cx, sx), (sz * sx, -cz * sx, cx))
    ubi = la.mat_struct(tuple(tuple(FE * c for c in row) for row in turned))
    return df.select("s_suppkey", ubi.alias("ubi"), la.vector(F.col("ox") * 10, F.col("oy") * 10, F.col("oz") * 5).alias("origin"))


def few_hkls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEW_HKLS, "h bigint, k bigint, l bigint")


_KEYS = "s_suppkey, CAST(h AS BIGINT) AS h, CAST(k AS BIGINT) AS k, CAST(l AS BIGINT) AS l, CAST(eta AS DOUBLE) AS etasign"


@query(f"SELECT {_KEYS}, {sr('sc', 4)} AS sc, {sr('fc', 4)} AS fc, {sr('omega')} AS omega FROM ({forward_sql(GENERAL, forward_rows(GENERAL), False)}) WHERE valid")
def forward_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = forward.get_centroid_box_all(grains(spark, sf_dir), few_hkls(spark), GENERAL).where("valid")
    return df.select("s_suppkey", "h", "k", "l", "etasign", r(F.col("sc"), 4).alias("sc"), r(F.col("fc"), 4).alias("fc"), r(F.col("omega")).alias("omega"))


@query(f"SELECT {_KEYS}, {sr('sc', 4)} AS sc, {sr('fc', 4)} AS fc, {sr('omega')} AS omega, {sr('dty')} AS dty FROM ({forward_sql(GENERAL, forward_rows(GENERAL), True)}) WHERE valid")
def forward_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = forward.get_centroid_scan_all(grains(spark, sf_dir), few_hkls(spark), GENERAL).where("valid")
    return df.select("s_suppkey", "h", "k", "l", "etasign", r(F.col("sc"), 4).alias("sc"), r(F.col("fc"), 4).alias("fc"), r(F.col("omega")).alias("omega"), r(F.col("dty")).alias("dty"))


_STEPS = {"ox": 1.0, "oy": 1.0, "oz": 1.0, "lam": 1e-6, "ky": 1e-6, "kz": 1e-6}
COV_DIGITS = 3


def _cov_sql(s: Setup, scan_mode: bool, full: tuple[tuple[float, ...], ...] | None = None) -> str:
    """Differences of the forward model by each input (five points), put together with the inputs' covariance."""
    names = ["sc", "fc", "omega"] + ["dty"] * scan_mode
    values = ", ".join(f"({i}, {sign}.0)" for i in range(6) for sign in (1, -1, 2, -2))
    moved = ", ".join(f"{c} + CASE WHEN i = {i} THEN sgn * {h!r} ELSE 0 END AS {c}" for i, (c, h) in enumerate(_STEPS.items()))
    rows = f"SELECT s_suppkey, gz, gx, h, k, l, eta, i, sgn, {moved} FROM ({forward_rows(s)}), (VALUES {values}) st(i, sgn)"
    cov = full or forward.get_cov_in(s.sigma)
    step = list(_STEPS.values())
    slopes = ", ".join(f"sum({n} * CASE sgn WHEN 1 THEN 8 WHEN -1 THEN -8 WHEN 2 THEN -1 ELSE 1 END) / 12 AS j_{n}" for n in names)
    weights = ", ".join(f"({i}, {k}, {cov[i][k] / step[i] / step[k]!r})" for i in range(6) for k in range(6) if cov[i][k])
    sums = ", ".join(f"{sr(f'sum(x.j_{a} * y.j_{b} * w)', COV_DIGITS)} AS cov_{a}_{b}" for i, a in enumerate(names) for b in names[i:])
    keys = "x.s_suppkey AS s_suppkey, CAST(x.h AS BIGINT) AS h, CAST(x.k AS BIGINT) AS k, CAST(x.l AS BIGINT) AS l, CAST(x.eta AS DOUBLE) AS etasign"
    same = " AND ".join(f"x.{c} = y.{c}" for c in ("s_suppkey", "h", "k", "l", "eta"))
    return f"""WITH f AS ({forward_sql(s, rows, scan_mode)}), j AS (SELECT s_suppkey, h, k, l, eta, i, {slopes}, bool_and(valid) AS ok FROM f GROUP BY s_suppkey, h, k, l, eta, i), c(i, m, w) AS (VALUES {weights})
SELECT {keys}, {sums} FROM j x JOIN c ON x.i = c.i JOIN j y ON y.i = c.m AND {same} GROUP BY x.s_suppkey, x.h, x.k, x.l, x.eta HAVING bool_and(x.ok)"""


def _covariances(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where("valid").select("s_suppkey", "h", "k", "l", "etasign", *(r(F.col(n), COV_DIGITS).alias(n) for n in names))


@query(_cov_sql(GENERAL, False))
def cov_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = forward.propagate_cov_box_all(grains(spark, sf_dir), few_hkls(spark), GENERAL)
    return _covariances(df, [f"cov_{a}" for a in ("sc_sc", "sc_fc", "sc_omega", "fc_fc", "fc_omega", "omega_omega")])


@query(_cov_sql(GENERAL, True))
def cov_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = forward.propagate_cov_scan_all(grains(spark, sf_dir), few_hkls(spark), GENERAL)
    names = ("sc", "fc", "omega", "dty")
    return _covariances(df, [f"cov_{a}_{b}" for i, a in enumerate(names) for b in names[i:]])


# frames, grids, pixels
@query(f"""WITH f AS (SELECT event_id, CAST(event_id * 7 % 3600 AS DOUBLE) / 10 - 180 AS fo, CAST(value AS DOUBLE) AS fd FROM events), p AS (SELECT o_orderkey, CAST(o_orderkey * 13 % 36000 AS DOUBLE) / 100 - 180 AS po, CAST(o_totalprice AS DOUBLE) / 1000 AS pd FROM orders)
SELECT event_id, o_orderkey FROM f, p WHERE abs(fo - po) <= {ACTIVE[0]} AND abs(fd - pd) <= {ACTIVE[1]}""")
def active_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucketed band join of frames and peaks."""
    f = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % 3600).cast("double").alias("fo"), F.col("value").cast("double").alias("frame_dty")).withColumn("frame_omega", F.col("fo") / 10 - 180)
    p = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 13 % 36000).cast("double") / 100 - 180).alias("omega"), (F.col("o_totalprice").cast("double") / 1000).alias("dty"))
    return bandjoin.get_active_peak_indices(f, p, *ACTIVE).select("event_id", "o_orderkey")


@query(f"""WITH n AS (SELECT CAST(ceil(max(abs(n_nationkey * 0.5 - 3 - {Y0})) / {STEP}) AS INT) AS n FROM nation), s AS (SELECT CAST(unnest(generate_series(-n, n, {GRIDSTEP})) AS INT) AS s FROM n)
SELECT a.s AS si, b.s AS sj, a.s + {SHAPE[0] // 2} AS ri, b.s + {SHAPE[1] // 2} AS rj, {sr(f'a.s * CAST({YSTEP} AS DOUBLE)')} AS x, {sr(f'-b.s * CAST({YSTEP} AS DOUBLE)')} AS y, true AS same FROM s a, s b""")
def step_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan grid, its recon indices and back, and sample places."""
    y = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 0.5 - 3).cast("double").alias("y"))
    g = scan.step_grid_from_ybincens(y, STEP, GRIDSTEP, Y0)
    g = g.withColumn("rc", geometry.step_to_recon(F.col("si"), F.col("sj"), *SHAPE)).withColumn("st", geometry.recon_to_step(F.col("rc.ri"), F.col("rc.rj"), *SHAPE)).withColumn("xy", geometry.step_to_sample(F.col("si"), F.col("sj"), YSTEP))
    return g.select("si", "sj", "rc.ri", "rc.rj", r(F.col("xy.x")).alias("x"), r(F.col("xy.y")).alias("y"), ((F.col("st.si") == F.col("si")) & (F.col("st.sj") == F.col("sj"))).alias("same"))


def _axis_sql(a: splat.Axis) -> str:
    start = f"greatest(0, least({a.n - a.window}, (SELECT arg_min(i, (abs({a.start!r} + i * {a.step!r} - {a.name}), i)) FROM (SELECT unnest(generate_series(0, {a.n - 1})) AS i)) - {a.window // 2}))"
    lo = f"({a.start!r} + (f + w) * {a.step!r} - {a.step / 2!r})"
    x = f"({lo} + j * {a.step / 200!r} - {a.name})"
    return f"""{a.name}_f AS (SELECT id, {a.name}, s_{a.name}, {start} AS f FROM p),
{a.name}_m AS (SELECT id, f + w AS i_{a.name}, sum((CASE WHEN j = 0 OR j = 200 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-{x} * {x} / (2 * s_{a.name} * s_{a.name}))) * {a.step / 600!r} / (s_{a.name} * sqrt(2 * pi())) AS m_{a.name} FROM {a.name}_f, (SELECT unnest(generate_series(0, {a.window - 1})) AS w), (SELECT unnest(generate_series(0, 200)) AS j) GROUP BY id, f + w, s_{a.name})"""


#: A scan's four axes.
SCAN_AXES = [splat.Axis("sc", 0, 1, 60, 5), splat.Axis("fc", 0, 1, 50, 5), splat.Axis("omega", -1, 0.05, 41, 3), splat.Axis("dty", -5, 0.5, 21, 4)]
_SPOTS = "SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 600 AS DOUBLE) / 10.3 AS sc, CAST(s_suppkey * 53 % 500 AS DOUBLE) / 10.7 AS fc, CAST(s_suppkey * 11 % 200 AS DOUBLE) / 103 - 0.97 AS omega, CAST(s_suppkey * 7 % 90 AS DOUBLE) / 8.7 - 5 AS dty, 1 + s_suppkey % 3 AS amp, 0.8 AS s_sc, 0.6 AS s_fc, 0.03 AS s_omega, 0.4 AS s_dty FROM supplier"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peak for each supplier."""
    k = F.col("s_suppkey")
    places = {"sc": (k * 37 % 600).cast("double") / 10.3, "fc": (k * 53 % 500).cast("double") / 10.7, "omega": (k * 11 % 200).cast("double") / 103 - 0.97, "dty": (k * 7 % 90).cast("double") / 8.7 - 5, "amp": 1 + k % 3}
    return table(spark, sf_dir, "supplier").select(k.alias("id"), *(c.alias(n) for n, c in places.items()), *(F.lit(x**2).alias(f"var_{n}") for n, x in (("sc", 0.8), ("fc", 0.6), ("omega", 0.03), ("dty", 0.4))))


def _pixels_sql(axes: list[splat.Axis], amplitude: str = "1") -> str:
    names = [a.name for a in axes]
    mass = " * ".join(f"m_{n}" for n in names)
    return f"""p AS ({_SPOTS}), {", ".join(map(_axis_sql, axes))},
x AS (SELECT id, {", ".join(f"CAST(i_{n} AS INT) AS i_{n}" for n in names)}, {mass} * {amplitude} AS m FROM {names[0]}_m {" ".join(f"JOIN {n}_m USING (id)" for n in names[1:])} JOIN (SELECT id, amp FROM p) USING (id))"""


def _image_sql(axes: list[splat.Axis], amplitude: str = "1") -> str:
    keys = ", ".join(f"i_{a.name}" for a in axes)
    return f"WITH {_pixels_sql(axes, amplitude)} SELECT {keys}, {sr('sum(m)', 7)} AS intensity FROM x GROUP BY {keys}"


@query(f"WITH {_pixels_sql(AXES)} SELECT id, i_sc, i_fc, i_omega, {sr('m', 7)} AS intensity FROM x")
def splat_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian peaks as rows of pixels; the SQL integrates by Simpson's rule."""
    return rounded(splat.peaks_to_pixels(spots(spark, sf_dir).drop("dty", "var_dty", "amp"), AXES), ("intensity",), 7)


@query(_image_sql(AXES))
def splat_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian peaks summed on a pixel grid, tile by tile."""
    return rounded(splat.image_of_peaks(spots(spark, sf_dir).drop("dty", "var_dty", "amp"), AXES), ("intensity",), 7)


@query(_image_sql(SCAN_AXES, "amp"))
def splat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a scan, with the translation as fourth axis and amplitudes."""
    return rounded(splat.image_of_peaks(spots(spark, sf_dir), SCAN_AXES, "amp"), ("intensity",), 7)


@query(f"SELECT p_partkey, {sr('sqrt(s*s + 25)')} AS ds, {sr('2 * degrees(asin(s / 1000))')} AS tth, {sr('s / 500')} AS back FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s FROM part)")
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions, called from SQL."""
    sql_functions.register(spark)
    table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s")).createOrReplaceTempView("braggline_sizes")
    return spark.sql("SELECT p_partkey, round(q_to_ds(s, 3, 4), 6) + 0.0D AS ds, round(ds_to_tth(s / 500, 1), 6) + 0.0D AS tth, round(tth_to_ds(ds_to_tth(s / 500, 1), 1), 6) + 0.0D AS back FROM braggline_sizes")
