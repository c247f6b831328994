"""First-order propagation for any function of Columns, by dual numbers.

A :class:`Dual` carries a Column and its derivatives by named inputs; a centroid function written with Duals (and
``sin``, ``cos``, ``sqrt``, ``asin``, ``atan2`` of this module) needs no derivative of its own. For the built-in
centroids the closed forms of ``operators.forward`` make smaller plans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linalg import ieee_div, lit


@dataclass
class Dual:
    value: Column
    d: dict[str, Column]

    def _with(self, value: Column, own: Column, other: Dual | None = None, others: Column | None = None) -> Dual:
        """Chain rule: own and others are the derivatives by this value and by the other."""
        d = {n: own * x for n, x in self.d.items()}
        for n, x in (other.d.items() if other else ()):
            d[n] = d[n] + others * x if n in d else others * x
        return Dual(value, d)

    def __add__(self, o):
        o = dual(o)
        return self._with(self.value + o.value, F.lit(1.0), o, F.lit(1.0))

    def __neg__(self):
        return self._with(-self.value, F.lit(-1.0))

    def __sub__(self, o):
        return self + -dual(o)

    def __mul__(self, o):
        o = dual(o)
        return self._with(self.value * o.value, o.value, o, self.value)

    def __truediv__(self, o):
        o = dual(o)
        q = ieee_div(self.value, o.value)
        return self._with(q, ieee_div(1.0, o.value), o, -ieee_div(q, o.value))

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o):
        return dual(o) + -self

    def __rtruediv__(self, o):
        return dual(o) / self


def dual(x) -> Dual:
    return x if isinstance(x, Dual) else Dual(lit(x), {})


def variable(name: str, column: Column) -> Dual:
    """An input by which derivatives are wanted."""
    return Dual(column, {name: F.lit(1.0)})


def sin(x) -> Dual:
    x = dual(x)
    return x._with(F.sin(x.value), F.cos(x.value))


def cos(x) -> Dual:
    x = dual(x)
    return x._with(F.cos(x.value), -F.sin(x.value))


def sqrt(x) -> Dual:
    x = dual(x)
    return x._with(F.sqrt(x.value), ieee_div(0.5, F.sqrt(x.value)))


def asin(x) -> Dual:
    x = dual(x)
    return x._with(F.asin(x.value), ieee_div(1.0, F.sqrt(1 - x.value * x.value)))


def atan2(y, x) -> Dual:
    y, x = dual(y), dual(x)
    r2 = x.value * x.value + y.value * y.value
    return y._with(F.atan2(y.value, x.value), ieee_div(x.value, r2), x, -ieee_div(y.value, r2))


#: Parts of an input that is a vector (a struct column).
AXES = ("x", "y", "z")
#: A covariance: variances by input, a symmetric matrix of numbers, or the name of a column that holds one (array of rows).
Covariance = dict[str, float] | Sequence[Sequence[float]] | str


def make_propagator(function: Callable, inputs: list[str], vectors: tuple[str, ...] = (), has_aux: bool = False, staged: bool = False) -> Callable[[DataFrame, Covariance], DataFrame]:
    """From a function of Duals, named like the input columns, to one that adds its outputs and the upper triangle of
    their covariance J C J^T, cov_<a>_<b>.

    An input named in ``vectors`` is a struct column of x, y and z; the function gets it as three Duals, and it has three
    rows in the covariance (and three names, <input>.x and so on, among variances). Rows of a matrix follow the inputs in their
    order. With ``has_aux`` the function returns a second dict of plain Columns, such as ``valid``, which are added as they
    are, without derivatives. With ``staged`` it gets a function ``keep`` first, which stores named Duals as columns and
    returns them anew: what is used often should pass through it, as Catalyst would repeat its expression at every use.
    """
    flat = [f"{n}.{c}" if n in vectors else n for n in inputs for c in (AXES if n in vectors else ("",))]

    def propagate(df: DataFrame, covariance: Covariance) -> DataFrame:
        before, held = df.columns, {"df": df}

        def keep(**values: Dual):
            columns = {}
            for n, x in values.items():
                columns |= {f"_k_{n}": x.value} | {f"_k_{n}_{flat.index(i)}": d for i, d in x.d.items()}
            held["df"] = held["df"].withColumns(columns)
            out = [Dual(F.col(f"_k_{n}"), {i: F.col(f"_k_{n}_{flat.index(i)}") for i in x.d}) for n, x in values.items()]
            return out[0] if len(out) == 1 else out

        given = {n: tuple(variable(f"{n}.{c}", F.col(n)[c]) for c in AXES) if n in vectors else variable(n, F.col(n)) for n in inputs}
        out = function(*((keep,) if staged else ()), **given)
        out, aux = out if has_aux else (out, {})
        names, zero = list(out), F.lit(0.0)
        df = held["df"].withColumns({n: x.value for n, x in out.items()} | aux | {f"_j_{n}_{k}": x.d[i] for n, x in out.items() for k, i in enumerate(flat) if i in x.d})

        def entry(i: int, k: int):
            """Of the input covariance: a number, 0 for none, or a Column."""
            if isinstance(covariance, str):
                return F.get(F.get(F.col(covariance), i), k)
            return (float(covariance.get(flat[i], 0.0)) if i == k else 0.0) if isinstance(covariance, dict) else float(covariance[i][k])

        def between(a: str, b: str) -> Column:
            terms = [F.col(f"_j_{a}_{i}") * c * F.col(f"_j_{b}_{k}") for i in range(len(flat)) for k in range(len(flat)) if flat[i] in out[a].d and flat[k] in out[b].d and not (isinstance(c := entry(i, k), float) and c == 0)]
            return sum(terms[1:], terms[0]) if terms else zero

        cov = {f"cov_{a}_{b}": between(a, b) for k, a in enumerate(names) for b in names[k:]}
        return df.withColumns(cov).select(*before, *names, *aux, *cov)

    return propagate
