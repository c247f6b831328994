"""The scalar operators as SQL functions: plain SQL bodies, which Catalyst inlines and folds."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "q_to_ds": ("x DOUBLE, y DOUBLE, z DOUBLE", "DOUBLE", "sqrt(x * x + y * y + z * z)"),
    "ds_to_tth": ("ds DOUBLE, wavelength DOUBLE", "DOUBLE", "2 * degrees(asin(ds * wavelength / 2))"),
    "tth_to_ds": ("tth DOUBLE, wavelength DOUBLE", "DOUBLE", "2 * sin(radians(tth) / 2) / wavelength"),
    "q_lab_to_eta": ("qy DOUBLE, qz DOUBLE", "DOUBLE", "degrees(atan2(-qy, qz))"),
    "metric_to_volume": ("a DOUBLE, b DOUBLE, c DOUBLE, alpha DOUBLE, beta DOUBLE, gamma DOUBLE", "DOUBLE", "a * b * c * sqrt(1 - pow(cos(radians(alpha)), 2) - pow(cos(radians(beta)), 2) - pow(cos(radians(gamma)), 2) + 2 * cos(radians(alpha)) * cos(radians(beta)) * cos(radians(gamma)))"),
    "step_to_sample_x": ("si INT, ystep DOUBLE", "DOUBLE", "si * ystep"),
    "step_to_sample_y": ("sj INT, ystep DOUBLE", "DOUBLE", "-sj * ystep"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known as temporary SQL functions, and reflections as table functions: ``cell_hkls`` of any cell, to be called
    by LATERAL for each row of a table, ``cubic_hkls`` of a cubic one. Both are bodies that Catalyst inlines; no Python runs."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION cubic_hkls(a DOUBLE, dsmax DOUBLE) RETURNS TABLE (h BIGINT, k BIGINT, l BIGINT, ds DOUBLE)
        RETURN SELECT h, k, l, sqrt(h * h + k * k + l * l) / a AS ds
        FROM VALUES (1) AS one(row)
        LATERAL VIEW explode(sequence(-cast(floor(dsmax * a) AS BIGINT), cast(floor(dsmax * a) AS BIGINT))) AS h
        LATERAL VIEW explode(sequence(-cast(floor(dsmax * a) AS BIGINT), cast(floor(dsmax * a) AS BIGINT))) AS k
        LATERAL VIEW explode(sequence(-cast(floor(dsmax * a) AS BIGINT), cast(floor(dsmax * a) AS BIGINT))) AS l
        WHERE h * h + k * k + l * l > 0 AND sqrt(h * h + k * k + l * l) / a < dsmax""")
    cos = lambda x: f"cos(radians({x}))"
    root = f"sqrt(1 - pow({cos('alpha')}, 2) - pow({cos('beta')}, 2) - pow({cos('gamma')}, 2) + 2 * {cos('alpha')} * {cos('beta')} * {cos('gamma')})"
    #: The upper triangle of B.
    b = {
        "b00": f"sin(radians(alpha)) / (a * {root})", "b01": f"({cos('alpha')} * {cos('beta')} - {cos('gamma')}) / (b * {root} * sin(radians(alpha)))",
        "b02": f"({cos('alpha')} * {cos('gamma')} - {cos('beta')}) / (c * {root} * sin(radians(alpha)))", "b11": "1 / (b * sin(radians(alpha)))", "b12": "-cos(radians(alpha)) / (c * sin(radians(alpha)))", "b22": "1 / c",
    }
    upper = ", ".join(f"{body} AS {name}" for name, body in b.items())
    # as in operators.hkl: l by itself, k for each l, h for each k and l
    each = lambda center, radius: f"explode(CASE WHEN ceil(({center}) - ({radius}) - 1e-6D) <= floor(({center}) + ({radius}) + 1e-6D) THEN sequence(ceil(({center}) - ({radius}) - 1e-6D), floor(({center}) + ({radius}) + 1e-6D)) END)"
    # d* by the triclinic formula, as functions.crystal.hkl_to_ds has it; the slack of the bounds is for rounding
    metric = ", ".join(f"{f}(radians({n})) AS {f[0]}{n[0]}" for n in ("alpha", "beta", "gamma") for f in ("cos", "sin"))
    own = [f"({x})" for x in ("h * eb * ec * sa", "k * ea * ec * sb", "l * ea * eb * sg")]
    mixed = ["2 * h * k * ea * eb * ec * ec * (ca * cb - cg)", "2 * k * l * ea * ea * eb * ec * (cb * cg - ca)", "2 * h * l * ea * eb * eb * ec * (ca * cg - cb)"]
    ds = f"sqrt(greatest(0D, {' + '.join([*(f'{x} * {x}' for x in own), *mixed])})) / (ea * eb * ec * sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION cell_hkls(a DOUBLE, b DOUBLE, c DOUBLE, alpha DOUBLE, beta DOUBLE, gamma DOUBLE, dsmax DOUBLE) RETURNS TABLE (h BIGINT, k BIGINT, l BIGINT, ds DOUBLE)
        RETURN SELECT h, k, l, ds FROM (SELECT h, k, l, bound, {ds} AS ds FROM
        (SELECT *, {each("-(b01 * k + b02 * l) / b00", "sqrt(greatest(0D, most * most - pow(b22 * l, 2) - pow(b11 * k + b12 * l, 2))) / b00")} AS h FROM
        (SELECT *, {each("-b12 * l / b11", "sqrt(greatest(0D, most * most - pow(b22 * l, 2))) / b11")} AS k FROM
        (SELECT *, {each("0D", "most / b22")} AS l FROM (SELECT {upper}, {metric}, a AS ea, b AS eb, c AS ec, dsmax AS bound, dsmax * (1 + 1e-9D) AS most))))) WHERE ds > 0 AND ds < bound""")
