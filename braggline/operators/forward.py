"""Forward model: grains times reflections to detector peaks, with first-order covariances.

A DataFrame for these operators has one row per grain, reflection and sign, with the columns ``ubi`` (matrix struct),
``origin`` (vector struct), ``h, k, l`` and ``etasign``; what holds for a whole run is a :class:`Setup`. Values are
added stage by stage, so that no expression refers to more than the columns of the stage before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as la
from ..functions.diffract import LEAST_R2, MARGIN, ewald_amplitude, ewald_omega
from ..functions.linalg import NAN, V3, Stage, cross, dot, flat_v3, ieee_div, m3, mat_vec, scale, v3

INPUTS = ("ox", "oy", "oz", "wavelength", "ky", "kz")


@dataclass(frozen=True)
class Detector:
    y_center: float
    y_size: float
    tilt_y: float
    z_center: float
    z_size: float
    tilt_z: float
    tilt_x: float
    distance: float
    o11: float = 1.0
    o12: float = 0.0
    o21: float = 0.0
    o22: float = 1.0

    def basis(self) -> tuple[tuple[float, ...], ...]:
        """Lab places of the pixels (1, 0), (0, 1) and (0, 0): one detector's constants, worked out once."""
        cx, sx, cy, sy, cz, sz = (f(t) for t in (self.tilt_x, self.tilt_y, self.tilt_z) for f in (math.cos, math.sin))
        r = ((cy * cz, -cy * sz, sy), (cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy), (sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy))

        def place(s: float, f: float) -> tuple[float, ...]:
            s, f = s - self.z_center, f - self.y_center
            z = self.o11 * self.z_size * s + self.o12 * self.y_size * f
            y = self.o21 * self.z_size * s + self.o22 * self.y_size * f
            return tuple(row[1] * y + row[2] * z + (self.distance if i == 0 else 0.0) for i, row in enumerate(r))

        return place(1, 0), place(0, 1), place(0, 0)


@dataclass(frozen=True)
class Setup:
    detector: Detector
    wavelength: float
    ky: float = 0.0
    kz: float = 0.0
    wedge: float = 0.0
    chi: float = 0.0
    y0: float = 0.0
    k0: tuple[float, float, float] = (1.0, 0.0, 0.0)
    #: Standard deviations of origin, wavelength and divergence, for the covariances.
    sigma: dict[str, float] = field(default_factory=dict)
    #: In their place, a full 6 x 6 covariance of the inputs, in the order of INPUTS.
    covariance: tuple[tuple[float, ...], ...] | None = None

    @property
    def cov_in(self) -> list[list[float]]:
        return [list(row) for row in self.covariance] if self.covariance else get_cov_in(self.sigma)

    @property
    def k(self) -> list[float]:
        """The beam as given, not scaled."""
        return [a + b for a, b in zip(self.k0, (0.0, self.ky, self.kz), strict=True)]

    @property
    def kb(self) -> list[float]:
        """The beam of length 1 / wavelength."""
        n = math.sqrt(sum(x * x for x in self.k))
        return [x / n / self.wavelength for x in self.k]

    @property
    def tilt(self) -> list[list[float]]:
        """Wedge about y after chi about x."""
        w, c = math.radians(self.wedge), math.radians(self.chi)
        return [[math.cos(w), math.sin(w) * math.sin(c), math.sin(w) * math.cos(c)], [0.0, math.cos(c), -math.sin(c)], [-math.sin(w), math.cos(w) * math.sin(c), math.cos(w) * math.cos(c)]]

    def untilted(self, v: list[float]) -> list[float]:
        """A constant lab vector in the sample frame, at omega 0."""
        return [sum(self.tilt[j][i] * v[j] for j in range(3)) for i in range(3)]

    def dk(self) -> list[list[float]]:
        """Derivatives of the scaled beam by wavelength, ky and kz."""
        n = math.sqrt(sum(x * x for x in self.k))
        unit = [x / n for x in self.k]
        return [[-x / self.wavelength for x in self.kb], *([((i == a) - unit[i] * unit[a]) / (self.wavelength * n) for i in range(3)] for a in (1, 2))]


#: Reflections that are sent to every task: 32 bytes each, so a few MB.
MOST_SENT = 100_000


def all_pairs(grains: DataFrame, hkls: DataFrame, signs: tuple[float, ...] = (1.0, -1.0), few: bool = False) -> DataFrame:
    """Every grain with every reflection and sign. The result has that many rows by definition; grains stay partitioned. Spark sends the
    reflections to every task where it knows them to be small, and else plans the product of both sides' partitions. With ``few`` they
    are counted first, and sent if there are at most ``MOST_SENT``: for lists that Spark has no statistics of."""
    sent = few and hkls.limit(MOST_SENT + 1).count() <= MOST_SENT
    return grains.crossJoin(F.broadcast(hkls) if sent else hkls).withColumn("etasign", F.explode(F.array(*map(F.lit, map(float, signs)))))


def one_hkl(grains: DataFrame, h: int, k: int, l: int, etasign: float) -> DataFrame:  # noqa: E741
    """Every grain with one reflection and one sign; no join."""
    return grains.withColumns({n: F.lit(int(x)).cast("bigint") for n, x in zip("hkl", (h, k, l), strict=True)} | {"etasign": F.lit(float(etasign))})


def _vector(values) -> V3:
    return tuple(F.lit(float(x)) for x in values)


def linear(coefficients: list[float], v: V3) -> Column:
    """Sum of constant multiples; terms of 0 are left out."""
    terms = [x if c == 1 else x * float(c) for c, x in zip(coefficients, v, strict=True) if c]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def _constant_cross(a: list[float], v: V3) -> V3:
    """a cross v for a constant a."""
    return linear([0, -a[2], a[1]], v), linear([a[2], 0, -a[0]], v), linear([-a[1], a[0], 0], v)


def _turn(v: V3) -> V3:
    """Rotation by omega about z, with its cosine and sine as columns."""
    return F.col("cw") * v[0] - F.col("sw") * v[1], F.col("sw") * v[0] + F.col("cw") * v[1], v[2]


def _tilted(setup: Setup, v: V3) -> V3:
    return tuple(linear(row, v) for row in setup.tilt)


def hkl_to_k_omega(df: DataFrame, setup: Setup) -> Stage:
    """Adds q (sample), the terms of the Ewald equation, omega, valid, q_lab and k_out. What holds for the whole run,
    the beam in both frames among it, goes in as literals. Nulls count as NaN: their rows aren't valid."""
    s = Stage(df, total=True)
    ubi = s.put(ubi_=m3(F.col("ubi")), o_=v3(F.col("origin")), hkl_=tuple(F.col(c).cast("double") for c in "hkl"))[0]
    factor = s.put(inverse_det=ieee_div(1.0, la.det3(ubi)))
    a, b, c = ubi
    adjugate = la.transpose((cross(b, c), cross(c, a), cross(a, b)))
    q = s.put(q=scale(mat_vec(adjugate, flat_v3("hkl_")), factor))
    ks = setup.untilted(setup.kb)
    alpha, beta, delta = s.put(alpha=linear([ks[0], ks[1], 0], q), beta=linear([ks[1], -ks[0], 0], q), delta=-dot(q, q) / 2 - q[2] * ks[2])
    amplitude = s.put(**ewald_amplitude(alpha, beta, delta))
    omega, valid = ewald_omega(alpha, beta, *amplitude, F.col("etasign"))
    # A filter on "valid" would be pushed below all these stages and repeat their expressions there as one; what depends
    # on the partition isn't pushed.
    s.put(omega=omega, valid=F.coalesce(valid, F.lit(False)) & (F.spark_partition_id() >= 0))
    s.put(cw=F.cos(F.radians(F.col("omega"))), sw=F.sin(F.radians(F.col("omega"))))
    turned = s.put(q_turned=_turn(q), o_turned=_turn(flat_v3("o_")))
    q_lab = s.put(q_lab=_tilted(setup, turned[0]), o_still=_tilted(setup, turned[1]))[0]
    s.put(k_out=tuple(x + k for x, k in zip(q_lab, setup.kb, strict=True)))
    return s


def _plane(setup: Setup) -> tuple[list[float], list[float], list[float], list[float]]:
    """Steps along slow and fast axis, place of pixel (0, 0), and the normal."""
    a, b, z = setup.detector.basis()
    s, f = [x - y for x, y in zip(a, z, strict=True)], [x - y for x, y in zip(b, z, strict=True)]
    return s, f, list(z), [s[1] * f[2] - s[2] * f[1], s[2] * f[0] - s[0] * f[2], s[0] * f[1] - s[1] * f[0]]


def _centroid(df: DataFrame, setup: Setup, scan: bool) -> Stage:
    s = hkl_to_k_omega(df, setup)
    still, k_out = flat_v3("o_still"), flat_v3("k_out")
    if scan:
        # as find_dty_for_beam_xy, with the beam's slope as a constant
        k = setup.k
        slope = k[1] / k[0] if k[0] else math.copysign(math.inf, k[1]) if k[1] else NAN
        dty = s.put(dty=still[0] * F.lit(slope) - still[1] + F.lit(float(setup.y0)))
        at = s.put(o_lab=(still[0], still[1] + dty - F.lit(float(setup.y0)), still[2]))
    else:
        at = still
    ds, df_, at0, normal = _plane(setup)
    off = s.put(off=tuple(F.lit(z) - x for z, x in zip(at0, at, strict=True)))
    down, f_off, off_s = s.put(down=linear(normal, k_out), f_off=_constant_cross(df_, off), off_s=tuple(-x for x in _constant_cross(ds, off)))
    pixel = lambda v: F.when(down == 0, F.lit(0.0)).otherwise(dot(v, k_out) / down)
    s.put(sc=pixel(f_off), fc=pixel(off_s))
    return s


def get_centroid_box(df: DataFrame, setup: Setup) -> DataFrame:
    """``df`` with sc, fc, omega and valid."""
    return _centroid(df, setup, False).df.select(*df.columns, "sc", "fc", "omega", "valid")


def get_centroid_scan(df: DataFrame, setup: Setup) -> DataFrame:
    """``df`` with sc, fc, omega, dty and valid."""
    return _centroid(df, setup, True).df.select(*df.columns, "sc", "fc", "omega", "dty", "valid")


def _jacobian(s: Stage, setup: Setup, scan: bool) -> dict[str, list[Column]]:
    """Derivatives of sc, fc, omega (degrees) and dty by the six inputs, in closed form. Rows whose scattering vector
    lies along the axis have none (NaN); they are not valid."""
    col = F.col
    q, zero, none = flat_v3("q"), F.lit(0.0), [0.0, 0.0, 0.0]
    dk = [none, none, none, *setup.dk()]
    # what turning by omega does: z cross the turned vector, tilted
    spin = lambda v: _tilted(setup, (-v[1], v[0], zero))
    spin_q, spin_o = s.put(spin_q=spin(flat_v3("q_turned")), spin_o=spin(flat_v3("o_turned")))
    r, r2, quot = col("r"), col("r2"), col("quot")
    s.put(slope=F.when(F.abs(quot) < 1 - MARGIN, col("etasign") / F.sqrt(F.greatest(1 - quot * quot, F.lit(1e-300)))).otherwise(zero), clear=F.when(r2 > LEAST_R2, 1 / r).otherwise(zero), inverse_r2=ieee_div(1.0, r2))
    terms = {}
    for p in (3, 4, 5):
        d = setup.untilted(dk[p])
        terms |= {f"da{p}": linear([d[0], d[1], 0], q), f"db{p}": linear([d[1], -d[0], 0], q), f"dd{p}": linear([0, 0, -d[2]], q)}
    s.put(**terms)
    dw = {}
    for p in (3, 4, 5):
        da, db, dd = (col(f"{n}{p}") for n in ("da", "db", "dd"))
        dr = (col("alpha") * da + col("beta") * db) * col("clear")
        dquot = (dd - quot * dr) / r
        dw[f"dw{p}"] = F.when(r2 == 0, F.lit(NAN)).otherwise(col("slope") * dquot - (col("beta") * da - col("alpha") * db) * col("inverse_r2"))
    s.put(**dw)
    domega = [None] * 3 + [col(f"dw{p}") for p in (3, 4, 5)]
    # origin, translation and outgoing beam
    moved = {}
    for p in range(6):
        if p < 3:
            moved[f"dv{p}"] = _tilted(setup, _turn(tuple(F.lit(float(i == p)) for i in range(3))))
        else:
            moved[f"dv{p}"] = scale(spin_o, domega[p])
            moved[f"dko{p}"] = tuple(x * domega[p] + k for x, k in zip(spin_q, dk[p], strict=True))
    s.put(**moved)
    ddty = []
    if scan:
        still, k = flat_v3("o_still"), setup.k
        by = {}
        for p in range(6):
            dv = flat_v3(f"dv{p}")
            by[f"dt{p}"] = linear([k[1] / k[0] if k[0] else NAN, -1.0, 0], dv) + (still[0] * (1 / k[0] if k[0] else NAN) if p == 4 else zero)
        ddty = s.put(**by)
        s.put(**{f"dv{p}": (flat_v3(f"dv{p}")[0], flat_v3(f"dv{p}")[1] + ddty[p], flat_v3(f"dv{p}")[2]) for p in range(6)})
    # detector
    ds, df_, _, normal = _plane(setup)
    k_out, f_off, off_s = flat_v3("k_out"), flat_v3("f_off"), flat_v3("off_s")
    # (df x dv).k = dv.(k x df) and (dv x ds).k = dv.(ds x k)
    k_f, s_k = s.put(k_f=tuple(-x for x in _constant_cross(df_, k_out)), s_k=_constant_cross(ds, k_out), inverse_down=ieee_div(1.0, col("down")))[:2]
    out = {"sc": [], "fc": [], "omega": [zero if d is None else d * (180 / math.pi) for d in domega], "dty": ddty}
    for p in range(6):
        dv = flat_v3(f"dv{p}")
        sc, fc = -dot(k_f, dv), -dot(s_k, dv)
        if p >= 3:
            dko = flat_v3(f"dko{p}")
            turn_n = linear(normal, dko)
            sc, fc = sc + dot(f_off, dko) - col("sc") * turn_n, fc + dot(off_s, dko) - col("fc") * turn_n
        out["sc"].append(sc * col("inverse_down"))
        out["fc"].append(fc * col("inverse_down"))
    return out


def _covariance(df: DataFrame, setup: Setup, scan: bool) -> DataFrame:
    s = _centroid(df, setup, scan)
    j = _jacobian(s, setup, scan)
    names = ("sc", "fc", "omega", "dty") if scan else ("sc", "fc", "omega")
    s.put(**{f"j_{n}_{i}": j[n][i] for n in names for i in range(6)})
    cov = propagate_cov([[F.col(f"j_{n}_{i}") for i in range(6)] for n in names], setup.cov_in)
    s.put(**{f"cov_{a}_{b}": cov[x][x + y] for x, a in enumerate(names) for y, b in enumerate(names[x:])})
    return s.df.select(*df.columns, *names, "valid", *(f"cov_{a}_{b}" for x, a in enumerate(names) for b in names[x:]))


def get_cov_in(sigma: dict[str, float]) -> list[list[float]]:
    """The diagonal covariance of the six inputs from their standard deviations."""
    return [[float(sigma.get(i, 0.0)) ** 2 if i == k else 0.0 for k in INPUTS] for i in INPUTS]


def propagate_cov(jacobian: list[list[Column]], cov_in: list[list[float]]) -> list[list[Column]]:
    """J C J^T of a Jacobian of Columns and any symmetric covariance; entries of 0 are left out."""
    n = range(len(cov_in))

    def entry(x: list[Column], y: list[Column]) -> Column:
        own = [x[i] * y[i] * float(cov_in[i][i]) for i in n if cov_in[i][i]]
        mixed = [(x[i] * y[k] + x[k] * y[i]) * float(cov_in[i][k]) for i in n for k in n if i < k and cov_in[i][k]]
        return sum([*own, *mixed], F.lit(0.0))

    return [[entry(x, y) for y in jacobian] for x in jacobian]


def propagate_cov_box(df: DataFrame, setup: Setup) -> DataFrame:
    """Box centroids with the upper triangle of their 3 x 3 covariance."""
    return _covariance(df, setup, False)


def propagate_cov_scan(df: DataFrame, setup: Setup) -> DataFrame:
    """Scan centroids with the upper triangle of their 4 x 4 covariance."""
    return _covariance(df, setup, True)


def get_centroid_box_all(grains: DataFrame, hkls: DataFrame, setup: Setup, **pairs) -> DataFrame:
    return get_centroid_box(all_pairs(grains, hkls, **pairs), setup)


def get_centroid_scan_all(grains: DataFrame, hkls: DataFrame, setup: Setup, **pairs) -> DataFrame:
    return get_centroid_scan(all_pairs(grains, hkls, **pairs), setup)


def propagate_cov_box_all(grains: DataFrame, hkls: DataFrame, setup: Setup, **pairs) -> DataFrame:
    return propagate_cov_box(all_pairs(grains, hkls, **pairs), setup)


def propagate_cov_scan_all(grains: DataFrame, hkls: DataFrame, setup: Setup, **pairs) -> DataFrame:
    return propagate_cov_scan(all_pairs(grains, hkls, **pairs), setup)


def get_centroid_box_all_grains(grains: DataFrame, h: int, k: int, l: int, etasign: float, setup: Setup) -> DataFrame:  # noqa: E741
    return get_centroid_box(one_hkl(grains, h, k, l, etasign), setup)


def get_centroid_scan_all_grains(grains: DataFrame, h: int, k: int, l: int, etasign: float, setup: Setup) -> DataFrame:  # noqa: E741
    return get_centroid_scan(one_hkl(grains, h, k, l, etasign), setup)


def propagate_cov_box_all_grains(grains: DataFrame, h: int, k: int, l: int, etasign: float, setup: Setup) -> DataFrame:  # noqa: E741
    return propagate_cov_box(one_hkl(grains, h, k, l, etasign), setup)


def propagate_cov_scan_all_grains(grains: DataFrame, h: int, k: int, l: int, etasign: float, setup: Setup) -> DataFrame:  # noqa: E741
    return propagate_cov_scan(one_hkl(grains, h, k, l, etasign), setup)
