"""Wave vectors, scattering angles and the rotation angles that fulfil the Ewald condition. |k| is 1 / wavelength."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import NAN, V3, add, dot, ieee_div, lit, norm, scale, sub, v3, vec_struct

#: Least squared amplitude of the Ewald equation, and the margin that the arc sine keeps from its ends.
LEAST_R2, MARGIN = 1e-7, 1e-6


def scale_norm_k_(k: V3, wavelength) -> V3:
    n = norm(k)
    return tuple(ieee_div(ieee_div(x, n), wavelength) for x in k)


def scale_norm_k(k: Column, wavelength) -> Column:
    return vec_struct(scale_norm_k_(v3(k), lit(wavelength)))


def k_to_q_lab(k_in: Column, k_out: Column) -> Column:
    return vec_struct(sub(v3(k_out), v3(k_in)))


def q_lab_to_k_out(q: Column, k_in: Column) -> Column:
    return vec_struct(add(v3(q), v3(k_in)))


def peak_lab_to_k_out(peak: Column, origin: Column, wavelength) -> Column:
    return vec_struct(scale_norm_k_(sub(v3(peak), v3(origin)), lit(wavelength)))


def tth_eta_to_k_out(tth: Column, eta: Column, wavelength) -> Column:
    t, e = F.radians(lit(tth)), F.radians(lit(eta))
    return vec_struct(tuple(ieee_div(x, wavelength) for x in (F.cos(t), -F.sin(t) * F.sin(e), F.sin(t) * F.cos(e))))


def q_to_ds(q: Column) -> Column:
    return norm(v3(q))


def ds_to_tth(ds: Column, wavelength) -> Column:
    """Degrees; NaN beyond the limiting sphere."""
    return 2 * F.degrees(F.asin(lit(ds) * lit(wavelength) / 2))


def tth_eta_(q: V3, wavelength) -> tuple[Column, Column]:
    return ds_to_tth(norm(q), wavelength), F.degrees(F.atan2(-q[1], q[2]))


def q_lab_to_tth_eta(q: Column, wavelength) -> Column:
    tth, eta = tth_eta_(v3(q), wavelength)
    return F.struct(tth.alias("tth"), eta.alias("eta"))


def ewald_terms(q: V3, k: V3) -> dict[str, Column]:
    """alpha, beta, delta of alpha cos + beta sin = delta, for a rotation about z."""
    return {"alpha": k[0] * q[0] + k[1] * q[1], "beta": -k[0] * q[1] + k[1] * q[0], "delta": -dot(q, q) / 2 - k[2] * q[2]}


def ewald_amplitude(alpha: Column, beta: Column, delta: Column) -> dict[str, Column]:
    r2 = alpha * alpha + beta * beta
    r = F.sqrt(F.greatest(r2, F.lit(LEAST_R2)))
    return {"r2": r2, "r": F.when(F.isnan(r2), F.lit(NAN)).otherwise(r), "quot": delta / r}


def ewald_omega(alpha: Column, beta: Column, r2: Column, r: Column, quot: Column, etasign) -> tuple[Column, Column]:
    """(omega in degrees, valid). The clipped arc sine keeps invalid rows finite; NaN stays NaN."""
    s = lit(etasign)
    valid = (F.abs(quot) <= 1) & (r2 >= LEAST_R2) & ~F.isnan(quot)
    clipped = F.when(F.isnan(quot), F.lit(NAN)).otherwise(F.greatest(F.least(quot, F.lit(1 - MARGIN)), F.lit(-1 + MARGIN)))
    w = s * F.asin(clipped) - F.atan2(alpha / r, beta / r) - (1 - s) * (F.pi() / 2)
    return F.degrees(F.atan2(F.sin(w), F.cos(w))), valid


def omega_solns(q: Column, etasign, k_in: Column) -> Column:
    """Struct (omega, valid) of a scattering vector and a beam in the sample frame, the axis being z."""
    t = ewald_terms(v3(q), v3(k_in))
    a = ewald_amplitude(t["alpha"], t["beta"], t["delta"])
    omega, valid = ewald_omega(t["alpha"], t["beta"], a["r2"], a["r"], a["quot"], etasign)
    return F.struct(omega.alias("omega"), valid.alias("valid"))


__all__ = ["scale_norm_k", "k_to_q_lab", "q_lab_to_k_out", "peak_lab_to_k_out", "tth_eta_to_k_out", "q_to_ds", "ds_to_tth", "q_lab_to_tth_eta", "omega_solns", "scale"]
