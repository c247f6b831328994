"""Band joins: rows whose values lie within tolerances of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _buckets(x: Column, tolerance: float, width: float) -> Column:
    """The one or two buckets that values within the tolerance of ``x`` lie in; the slack is for rounding of large values."""
    slack = F.lit(tolerance * (1 + 1e-9)) + F.abs(x) * 4e-16
    lo, hi = F.floor((x - slack) / width), F.floor((x + slack) / width)
    return F.array_distinct(F.array(lo, F.least(lo + 1, hi), hi))


def band_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str, float]], copy_left: bool = False) -> DataFrame:
    """Rows with abs(left - right) <= tolerance (inclusive) for all (left column, right column, tolerance).

    Every band with a positive tolerance is cut into buckets of its whole width (twice the tolerance), so that what lies within
    the tolerance of a value is in one bucket or two. One side stands in its own bucket of each band, the other in those one
    or two (4 copies for two bands at most, mostly 3 or less), so the join is an equi-join on all buckets with the exact bands as
    residual: candidates stay within a constant factor of the results whichever band is selective, and skew can be
    split. The right side is copied, or the left one (``copy_left``): give it the smaller. Bands of 0 join by equality. NaN
    and null never match.
    """
    known = lambda df, names: df.where(" and ".join(f"not isnan({n}) and {n} is not null" for n in names))
    left, right = known(left, [a for a, *_ in on]), known(right, [b for _, b, _ in on])
    conditions, dropped = [], []
    for i, (a, b, t) in enumerate(on):
        if t <= 0:
            conditions.append(F.col(a) == F.col(b))
            continue
        width = 2 * float(t) * (1 + 1e-6)
        own = lambda c, w=width: F.floor(F.col(c) / w)
        near = lambda c, w=width, t=float(t): F.explode(_buckets(F.col(c).cast("double"), t, w))
        left = left.withColumn(f"_bl{i}", (near if copy_left else own)(a))
        right = right.withColumn(f"_br{i}", (own if copy_left else near)(b))
        conditions += [F.col(f"_bl{i}") == F.col(f"_br{i}"), F.abs(F.col(a) - F.col(b)) <= F.lit(float(t))]
        dropped += [f"_bl{i}", f"_br{i}"]
    return left.join(right, conditions).drop(*dropped)


def get_active_peak_indices(frames: DataFrame, peaks: DataFrame, omega_tol: float, dty_tol: float, frame_cols=("frame_omega", "frame_dty"), peak_cols=("omega", "dty"), copy_frames: bool = True) -> DataFrame:
    """Peaks active in each frame: both angles within tolerance, without wrapping at 360 degrees. A scan has fewer frames
    than peaks, so that frames stand in neighbouring buckets as well."""
    return band_join(frames, peaks, [(frame_cols[0], peak_cols[0], omega_tol), (frame_cols[1], peak_cols[1], dty_tol)], copy_left=copy_frames)
