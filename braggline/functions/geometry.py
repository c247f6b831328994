"""Rotations, goniometer, detector and scan-grid frames. Angles in degrees, but detector tilts in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import M3, V3, add, cross, dot, ieee_div, inv3, lit, m3, mat_mul, mat_struct, mat_vec, norm, rot_x_, rot_y_, rot_z_, sub, transpose, v3, vec_struct


def rmat_from_axis_angle(axis: Column, deg) -> Column:
    """Right-handed rotation about an axis of any length."""
    a = v3(axis)
    n = norm(a)
    x, y, z = (ieee_div(c, n) for c in a)
    c, s = F.cos(F.radians(lit(deg))), F.sin(F.radians(lit(deg)))
    t = 1 - c
    return mat_struct(((c + t * x * x, t * x * y - s * z, t * x * z + s * y), (t * x * y + s * z, c + t * y * y, t * y * z - s * x), (t * x * z - s * y, t * y * z + s * x, c + t * z * z)))


def rot_x(deg) -> Column:
    return mat_struct(rot_x_(deg))


def rot_y(deg) -> Column:
    return mat_struct(rot_y_(deg))


def rot_z(deg) -> Column:
    return mat_struct(rot_z_(deg))


def sample_to_lab_(v: V3, omega, wedge, chi, dty, y0) -> V3:
    """Rotated vector by vector, so that no matrix product is built."""
    r = mat_vec(rot_y_(wedge), mat_vec(rot_x_(chi), mat_vec(rot_z_(omega), v)))
    return r[0], r[1] + (lit(dty) - lit(y0)), r[2]


def lab_to_sample_(v: V3, omega, wedge, chi, dty, y0) -> V3:
    moved = (v[0], v[1] - (lit(dty) - lit(y0)), v[2])
    return mat_vec(transpose(rot_z_(omega)), mat_vec(transpose(rot_x_(chi)), mat_vec(transpose(rot_y_(wedge)), moved)))


def sample_to_lab(v: Column, omega, wedge, chi, dty, y0) -> Column:
    return vec_struct(sample_to_lab_(v3(v), omega, wedge, chi, dty, y0))


def lab_to_sample(v: Column, omega, wedge, chi, dty, y0) -> Column:
    return vec_struct(lab_to_sample_(v3(v), omega, wedge, chi, dty, y0))


def find_dty_(v_lab: V3, k: V3, y0) -> Column:
    """Of a vector already in the lab at dty = y0 = 0: the translation that brings it into the beam."""
    return ieee_div(k[1], k[0]) * v_lab[0] - v_lab[1] + lit(y0)


def find_dty_for_beam_xy(v: Column, k_in: Column, omega, wedge, chi, y0) -> Column:
    return find_dty_(sample_to_lab_(v3(v), omega, wedge, chi, 0, 0), v3(k_in), y0)


def detector_orientation_matrix(o11, o12, o21, o22) -> Column:
    z = F.lit(0.0)
    return mat_struct(((lit(o11), lit(o12), z), (lit(o21), lit(o22), z), (z, z, F.lit(1.0))))


def detector_rotation_matrix(tilt_x, tilt_y, tilt_z) -> Column:
    d = F.degrees
    return mat_struct(mat_mul(mat_mul(rot_x_(d(lit(tilt_x))), rot_y_(d(lit(tilt_y)))), rot_z_(d(lit(tilt_z)))))


def detector_transforms(y_center, y_size, tilt_y, z_center, z_size, tilt_z, tilt_x, distance, o11, o12, o21, o22) -> Column:
    """Struct (trans matrix, shift_c, shift_x). One row for each detector: derive once, then broadcast."""
    z, one = F.lit(0.0), F.lit(1.0)
    # (slow, fast, 0) to lab axes: z from slow, y from fast, scaled by the pixel sizes
    o = ((lit(o11) * lit(z_size), lit(o12) * lit(y_size), z), (lit(o21) * lit(z_size), lit(o22) * lit(y_size), z), (z, z, one))
    turned: M3 = (o[2], o[1], o[0])
    m = mat_mul(m3(detector_rotation_matrix(tilt_x, tilt_y, tilt_z)), turned)
    return F.struct(mat_struct(m).alias("trans"), vec_struct((-lit(z_center), -lit(y_center), z)).alias("shift_c"), vec_struct((lit(distance), z, z)).alias("shift_x"))


def det_to_lab(sc, fc, trans: Column, shift_c: Column, shift_x: Column) -> Column:
    c = v3(shift_c)
    return vec_struct(add(mat_vec(m3(trans), (lit(sc) + c[0], lit(fc) + c[1], c[2])), v3(shift_x)))


def lab_to_det(x, y, z, trans: Column, shift_c: Column, shift_x: Column) -> Column:
    """Struct (sc, fc); the distance off the plane is dropped."""
    p = sub(mat_vec(inv3(m3(trans)), sub((lit(x), lit(y), lit(z)), v3(shift_x))), v3(shift_c))
    return F.struct(p[0].alias("sc"), p[1].alias("fc"))


def detector_basis_vectors_lab(trans: Column, shift_c: Column, shift_x: Column) -> Column:
    """Struct (sc_lab, fc_lab, norm_lab): lab places of the pixels (1, 0), (0, 1) and (0, 0)."""
    at = lambda s, f: det_to_lab(s, f, trans, shift_c, shift_x)
    return F.struct(at(1, 0).alias("sc_lab"), at(0, 1).alias("fc_lab"), at(0, 0).alias("norm_lab"))


def raytrace_(vec: V3, origin: V3, sc_lab: V3, fc_lab: V3, norm_lab: V3) -> tuple[Column, Column]:
    """Where a ray of any length meets the detector plane, in pixels; (0, 0) for a ray parallel to it."""
    s, f = sub(sc_lab, norm_lab), sub(fc_lab, norm_lab)
    d = dot(cross(s, f), vec)
    from_origin = sub(norm_lab, origin)
    at = lambda n: F.when(d == 0, F.lit(0.0)).otherwise(n / F.when(d != 0, d))
    return at(dot(cross(f, from_origin), vec)), at(dot(cross(from_origin, s), vec))


def raytrace_to_det(vec: Column, origin: Column, sc_lab: Column, fc_lab: Column, norm_lab: Column) -> Column:
    sc, fc = raytrace_(v3(vec), v3(origin), v3(sc_lab), v3(fc_lab), v3(norm_lab))
    return F.struct(sc.alias("sc"), fc.alias("fc"))


def step_to_recon(si, sj, shape0, shape1) -> Column:
    half = lambda n: F.floor((n if isinstance(n, Column) else F.lit(n)) / 2).cast("int")
    return F.struct((si + half(shape0)).alias("ri"), (sj + half(shape1)).alias("rj"))


def recon_to_step(ri, rj, shape0, shape1) -> Column:
    half = lambda n: F.floor((n if isinstance(n, Column) else F.lit(n)) / 2).cast("int")
    return F.struct((ri - half(shape0)).alias("si"), (rj - half(shape1)).alias("sj"))


def step_to_sample(si, sj, ystep) -> Column:
    return F.struct((si * lit(ystep)).alias("x"), (-sj * lit(ystep)).alias("y"))
