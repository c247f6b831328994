"""Vectors and matrices as Columns.

Inside an expression a vector is a tuple of three Columns and a matrix a tuple of three rows; in a DataFrame they
are structs (``x, y, z`` and ``m00`` to ``m22``). Everything stays inside whole-stage code generation. Nulls make
results null; divisions follow IEEE 754 (no ANSI error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V3 = tuple[Column, Column, Column]
M3 = tuple[V3, V3, V3]
Number = Column | float | int

NAN, INFINITY = float("nan"), float("inf")
NAMES = tuple(f"m{i}{j}" for i in range(3) for j in range(3))


def lit(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ieee_div(n: Number, d: Number) -> Column:
    """n / d with infinities and NaN in place of the ANSI error."""
    n, d = lit(n), lit(d)
    return F.when(d == 0, n * F.lit(INFINITY)).otherwise(n / d)


def v3(c: Column) -> V3:
    """Of a struct column."""
    return c["x"], c["y"], c["z"]


def m3(c: Column) -> M3:
    return tuple(tuple(c[f"m{i}{j}"] for j in range(3)) for i in range(3))


def vector(x: Number, y: Number, z: Number) -> Column:
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def vec_struct(v: V3) -> Column:
    return vector(*v)


def mat_struct(m: M3) -> Column:
    return F.struct(*(lit(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


def matrix(*entries: Number) -> Column:
    return F.struct(*(lit(e).alias(n) for e, n in zip(entries, NAMES, strict=True)))


def add(a: V3, b: V3) -> V3:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: V3, b: V3) -> V3:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: V3, s: Number) -> V3:
    return tuple(x * s for x in a)


def dot(a: V3, b: V3) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: V3, b: V3) -> V3:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: V3) -> Column:
    return F.sqrt(dot(a, a))


def transpose(m: M3) -> M3:
    return tuple(zip(*m, strict=True))


def mat_vec(m: M3, v: V3) -> V3:
    return tuple(dot(row, v) for row in m)


def mat_mul(a: M3, b: M3) -> M3:
    return tuple(tuple(dot(row, column) for column in transpose(b)) for row in a)


def det3(m: M3) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def inv3(m: M3) -> M3:
    """Adjugate over determinant; entries are not finite where the matrix is singular."""
    a, b, c = m
    columns = cross(b, c), cross(c, a), cross(a, b)
    factor = ieee_div(1.0, det3(m))
    return tuple(tuple(columns[j][i] * factor for j in range(3)) for i in range(3))


def rot_x_(deg: Number) -> M3:
    c, s, o, z = F.cos(F.radians(lit(deg))), F.sin(F.radians(lit(deg))), F.lit(1.0), F.lit(0.0)
    return (o, z, z), (z, c, -s), (z, s, c)


def rot_y_(deg: Number) -> M3:
    c, s, o, z = F.cos(F.radians(lit(deg))), F.sin(F.radians(lit(deg))), F.lit(1.0), F.lit(0.0)
    return (c, z, s), (z, o, z), (-s, z, c)


def rot_z_(deg: Number) -> M3:
    c, s, o, z = F.cos(F.radians(lit(deg))), F.sin(F.radians(lit(deg))), F.lit(1.0), F.lit(0.0)
    return (c, -s, z), (s, c, z), (z, z, o)


def flat_v3(name: str) -> V3:
    """What :class:`Stage` keeps of a vector."""
    return tuple(F.col(f"{name}_{c}") for c in "xyz")


def flat_m3(name: str) -> M3:
    return tuple(tuple(F.col(f"{name}_m{i}{j}") for j in range(3)) for i in range(3))


class Stage:
    """A DataFrame that grows by named values, one projection a call, so that later expressions refer to columns
    and not to ever larger trees.

    Vectors and matrices are kept as flat columns: Catalyst folds the fields of a struct built in one projection into
    the next one, as often as they are used, while it keeps a column that is used twice.
    """

    def __init__(self, df: DataFrame, total: bool = False):
        """total: nulls become NaN, which spares the generated code its null checks."""
        self.df, self.total = df, total

    def put(self, **values: Column | V3 | M3):
        """Add values. Returns what refers to them, in order."""
        columns, out = {}, []
        for k, v in values.items():
            if isinstance(v, Column):
                columns[k] = v
                out.append(F.col(k))
            elif isinstance(v[0], Column):
                columns |= {f"{k}_{c}": x for c, x in zip("xyz", v, strict=True)}
                out.append(flat_v3(k))
            else:
                columns |= {f"{k}_m{i}{j}": v[i][j] for i in range(3) for j in range(3)}
                out.append(flat_m3(k))
        if self.total:
            columns = {k: c if k == "valid" else F.coalesce(c, F.lit(NAN)) for k, c in columns.items()}
        self.df = self.df.withColumns(columns)
        return out[0] if len(out) == 1 else out
