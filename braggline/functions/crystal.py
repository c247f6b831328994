"""Unit-cell algebra. Lattice parameters are structs (a, b, c, alpha, beta, gamma), angles in degrees; metrics and
B matrices are structs m00 to m22."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linalg import det3, ieee_div, inv3, m3, mat_mul, mat_struct, mat_vec, transpose, v3, vec_struct

LPARS = ("a", "b", "c", "alpha", "beta", "gamma")


def lpars(a, b, c, alpha, beta, gamma) -> Column:
    """Lattice parameters as a struct."""
    return F.struct(*((x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for n, x in zip(LPARS, (a, b, c, alpha, beta, gamma), strict=True)))


def _cos(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def lpars_to_mt(p: Column) -> Column:
    """Metric tensor of a cell."""
    a, b, c = p["a"], p["b"], p["c"]
    ab, ac, bc = a * b * _cos(p["gamma"]), a * c * _cos(p["beta"]), b * c * _cos(p["alpha"])
    return mat_struct(((a * a, ab, ac), (ab, b * b, bc), (ac, bc, c * c)))


def mt_to_lpars(g: Column) -> Column:
    """Lattice parameters of a metric tensor, direct or reciprocal."""
    m = m3(g)
    a, b, c = (F.sqrt(m[i][i]) for i in range(3))
    angle = lambda x, y, z: F.degrees(F.acos(ieee_div(x, y * z)))
    return lpars(a, b, c, angle(m[1][2], b, c), angle(m[0][2], a, c), angle(m[0][1], a, b))


def lpars_rlpars_to_B(p: Column, r: Column) -> Column:
    """Busing-Levy B of direct and reciprocal parameters."""
    sin = lambda d: F.sin(F.radians(d))
    z = F.lit(0.0)
    return mat_struct(
        (
            (r["a"], r["b"] * _cos(r["gamma"]), r["c"] * _cos(r["beta"])),
            (z, r["b"] * sin(r["gamma"]), -r["c"] * sin(r["beta"]) * _cos(p["alpha"])),
            (z, z, ieee_div(1.0, p["c"])),
        )
    )


def mt_to_rmt(g: Column) -> Column:
    return mat_struct(inv3(m3(g)))


def rmt_to_mt(g: Column) -> Column:
    return mat_struct(inv3(m3(g)))


def B_to_rmt(b: Column) -> Column:
    return mat_struct(mat_mul(transpose(m3(b)), m3(b)))


def metric_to_volume(g: Column) -> Column:
    return F.sqrt(det3(m3(g)))


def UBI_to_mt(ubi: Column) -> Column:
    return mat_struct(mat_mul(m3(ubi), transpose(m3(ubi))))


def rmt_to_rlpars(g: Column) -> Column:
    return mt_to_lpars(g)


def lpars_to_B(p: Column) -> Column:
    """B in closed form by the direct cell alone: equal to the composition through the reciprocal parameters, but a
    small expression."""
    a, b, c = p["a"], p["b"], p["c"]
    ca, cb, cg = _cos(p["alpha"]), _cos(p["beta"]), _cos(p["gamma"])
    sa = F.sin(F.radians(p["alpha"]))
    w = F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
    z = F.lit(0.0)
    return mat_struct(
        (
            (ieee_div(sa, a * w), ieee_div(ca * cb - cg, b * w * sa), ieee_div(ca * cg - cb, c * w * sa)),
            (z, ieee_div(1.0, b * sa), ieee_div(-ca, c * sa)),
            (z, z, ieee_div(1.0, c)),
        )
    )


def rmt_to_B(g: Column) -> Column:
    return lpars_rlpars_to_B(mt_to_lpars(mt_to_rmt(g)), mt_to_lpars(g))


def metric_terms(p: Column) -> dict[str, Column]:
    """What :func:`hkl_to_ds` needs to know of a cell: edges, cosines and sines of its angles, and its volume."""
    trig = {f"{f}{n[0]}": g(F.radians(p[n])) for n in LPARS[3:] for f, g in (("c", F.cos), ("s", F.sin))}
    a, b, c, ca, cb, cg = p["a"], p["b"], p["c"], trig["ca"], trig["cb"], trig["cg"]
    return {"a": a, "b": b, "c": c, **trig, "vol": a * b * c * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)}


def hkl_to_ds(h: Column, k: Column, l: Column, terms: dict[str, Column]) -> Column:  # noqa: E741
    """d* by the triclinic formula, which takes the axes alike. The order of its operations tells which side of a bound a reflection
    that lies on it comes to, so it is that of the formula as it is usually written."""
    a, b, c, ca, cb, cg, sa, sb, sg = (terms[n] for n in ("a", "b", "c", "ca", "cb", "cg", "sa", "sb", "sg"))
    own = [h * b * c * sa, k * a * c * sb, l * a * b * sg]
    mixed = [2 * h * k * a * b * c * c * (ca * cb - cg), 2 * k * l * a * a * b * c * (cb * cg - ca), 2 * h * l * a * b * b * c * (ca * cg - cb)]
    return F.sqrt(F.greatest(F.lit(0.0), own[0] * own[0] + own[1] * own[1] + own[2] * own[2] + mixed[0] + mixed[1] + mixed[2])) / terms["vol"]


def hkl_B_to_q_crystal(hkl: Column, b: Column) -> Column:
    return vec_struct(mat_vec(m3(b), v3(hkl)))


def UB(ubi: Column) -> Column:
    """Of a grain."""
    return mat_struct(inv3(m3(ubi)))


def upper_inverse(b: Column) -> Column:
    """Inverse of an upper triangular matrix such as B."""
    m = m3(b)
    z, d0, d1, d2 = F.lit(0.0), m[0][0], m[1][1], m[2][2]
    return mat_struct(
        (
            (ieee_div(1.0, d0), ieee_div(-m[0][1], d0 * d1), ieee_div(m[0][1] * m[1][2] - m[0][2] * d1, d0 * d1 * d2)),
            (z, ieee_div(1.0, d1), ieee_div(-m[1][2], d1 * d2)),
            (z, z, ieee_div(1.0, d2)),
        )
    )


def U(ub: Column, b: Column) -> Column:
    """Orientation of a grain by its UB and B, each a column of its own: UB times the inverse of B."""
    return mat_struct(mat_mul(m3(ub), m3(upper_inverse(b))))


def grains(df: DataFrame, ubi: str = "ubi") -> DataFrame:
    """``df`` with the lattice of each grain: metric ``g``, parameters ``p``, ``bmat``, ``ub`` and ``U``, stage by stage."""
    df = df.withColumns({"g": UBI_to_mt(F.col(ubi)), "ub": UB(F.col(ubi))}).withColumn("p", mt_to_lpars(F.col("g")))
    return df.withColumn("bmat", lpars_to_B(F.col("p"))).withColumn("U", U(F.col("ub"), F.col("bmat")))
