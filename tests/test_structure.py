"""The structure tables and propagation by dual numbers."""

import math

import pytest
from pyspark.sql import functions as F

from braggline.functions import dual
from braggline import more_queries
from braggline.more_queries import _orders
from braggline.operators import spacegroup
from braggline.operators.structure import Structure
from test_sources import CIF


def test_structure(spark, tmp_path):
    (tmp_path / "iron.cif").write_text(CIF)
    (tmp_path / "other.cif").write_text(CIF.replace("71", "1").replace("'I m m m'", "P1"))
    s = Structure.from_cif(spark, str(tmp_path))
    with pytest.raises(AttributeError):
        s.allhkls  # noqa: B018
    iron = s.by_name("Immm")
    assert [r.structure_id for r in iron.sgno.collect()] == ["iron"] and iron.sym_ops.count() == 4
    assert [r.structure_id for r in s.by_number(1).sgname.collect()] == ["other"]
    full = iron.make_hkls(0.75, 0.18)
    assert full.allhkls.count() == full.alltth.count() == full.allds.count() == 32
    assert [r.mult for r in full.ringmult.orderBy("ring_id").collect()] == [12, 6]
    assert [round(r.ds, 4) for r in full.ringds.orderBy("ring_id").collect()] == [0.494, 0.6986]
    assert [round(r.tth, 3) for r in full.ringtth.orderBy("ring_id").collect()] == [5.096, 7.209]
    assert full.ringhkls_arr.count() == 18 and len(full.ringhkls.orderBy("ring_id").first().hkls) == 12
    # identity and inversion alone: halves
    assert iron.make_hkls(0.75, 0.18, expand_to_p1=False).allhkls.count() == 16
    cell = iron.unit_cell.first()
    assert cell.volume == pytest.approx(2.863**3) and cell.bmat.m00 == pytest.approx(1 / 2.863) and cell.reciprocal.alpha == pytest.approx(90)


def test_dual(spark):
    def polar(x, y, w):
        r = dual.sqrt(x * x + y * y)
        return {"r": r * w, "t": dual.atan2(y, x), "u": dual.asin(y / r) - 2 / w, "v": dual.sin(x) * dual.cos(y)}

    df = spark.createDataFrame([(3.0, 4.0, 2.0)], "x double, y double, w double")
    row = dual.make_propagator(polar, ["x", "y", "w"])(df, {"x": 0.01, "y": 0.04, "w": 0.09}).first()

    def plain(x, y, w):
        r = math.hypot(x, y)
        return r * w, math.atan2(y, x), math.asin(y / r) - 2 / w, math.sin(x) * math.cos(y)

    h, at = 1e-6, [3.0, 4.0, 2.0]
    j = [[(a - b) / 2 / h for a, b in zip(plain(*(v + h * (k == i) for k, v in enumerate(at))), plain(*(v - h * (k == i) for k, v in enumerate(at))))] for i in range(3)]
    names, var = ("r", "t", "u", "v"), (0.01, 0.04, 0.09)
    assert [row[n] for n in names] == pytest.approx(plain(*at))
    for a in range(4):
        for b in range(a, 4):
            assert row[f"cov_{names[a]}_{names[b]}"] == pytest.approx(sum(j[i][a] * j[i][b] * var[i] for i in range(3)), abs=1e-8)


def test_space_groups(spark):
    for number, _, hall in spacegroup.GROUPS:
        ops = spacegroup.operations(hall)
        known = set(ops)
        assert ops[0] == (((1, 0, 0), (0, 1, 0), (0, 0, 1)), (0, 0, 0)) and all(spacegroup._times(a, b) in known for a in ops[:6] for b in ops), number
    # another origin of the same group, and a symbol beyond the named ones
    assert len(spacegroup.operations("F 4d 2 3 -1d")) == 192 and len(spacegroup.operations("P 4nw 2abw")) == 8
    moved = spacegroup.operations("-P 2 (3 0 0)")
    assert (((-1, 0, 0), (0, -1, 0), (0, 0, -1)), (0.5, 0, 0)) in moved
    assert spacegroup.from_name(spark, "P21/c").count() == 4 and spacegroup.from_number(spark, 2).count() == 2
    for bad in ("Q 2", "P", "P 5", "P 2k"):
        with pytest.raises(ValueError):
            spacegroup.operations(bad)
    with pytest.raises(KeyError):
        spacegroup.from_number(spark, 231)


def test_all_groups():
    """230 different groups, of the orders of their classes and lattices; named ones in the same setting by number."""
    found = [spacegroup.operations(spacegroup.hall_of(n)) for n in range(1, 231)]
    assert [len(x) for x in found] == _orders() and sum(map(len, found)) == 4425
    assert len({frozenset(x) for x in found}) == 230
    # an inversion, where the class has one: 2, 10-15, 47-74, 83-88, 123-142, 147-148, 162-167, 175-176, 191-194, 200-206, 221-230
    minus = tuple(tuple(-int(i == j) for j in range(3)) for i in range(3))
    ranges = ((2, 2), (10, 15), (47, 74), (83, 88), (123, 142), (147, 148), (162, 167), (175, 176), (191, 194), (200, 206), (221, 230))
    assert [n for n, x in enumerate(found, 1) if any(r == minus for r, _ in x)] == [n for a, b in ranges for n in range(a, b + 1)]
    assert all(spacegroup.hall_of(n) == hall == spacegroup.hall_symbol(n) for n, _, hall in spacegroup.GROUPS)


def test_propagator_in_full(spark):
    """A vector input, staged columns, a second result without derivatives; covariances by number and by column."""

    def f(keep, v, w):
        n = keep(n=dual.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]))
        return {"a": n * w, "b": v[1] / w}, {"long": n.value > 3}

    matrix = [[0.04, 0.01, 0.0, 0.002], [0.01, 0.09, -0.01, 0.0], [0.0, -0.01, 0.16, 0.003], [0.002, 0.0, 0.003, 0.01]]
    df = spark.createDataFrame([((1.0, 2.0, 2.0), 2.0, matrix)], "v struct<x:double,y:double,z:double>, w double, c array<array<double>>")
    run = dual.make_propagator(f, ["v", "w"], ("v",), has_aux=True, staged=True)
    j = [[2 / 3, 4 / 3, 4 / 3, 3.0], [0.0, 0.5, 0.0, -0.5]]
    want = [[sum(j[a][i] * matrix[i][k] * j[b][k] for i in range(4) for k in range(4)) for b in range(2)] for a in range(2)]
    for covariance in (matrix, "c"):
        row = run(df, covariance).first()
        assert (row.a, row.b, row.long) == (6.0, 1.0, False)
        assert (row.cov_a_a, row.cov_a_b, row.cov_b_b) == pytest.approx((want[0][0], want[0][1], want[1][1]))
    row = run(df, {"v.y": 0.09, "w": 0.01}).first()
    assert row.cov_a_b == pytest.approx(4 / 3 * 0.5 * 0.09 - 3 * 0.5 * 0.01) and set(row.asDict()) == {"v", "w", "c", "a", "b", "long", "cov_a_a", "cov_a_b", "cov_b_b"}


@pytest.mark.parametrize("name", ["space_groups", "all_space_groups"])
def test_places_in_the_task(spark, tmp_path, monkeypatch, name):
    """Points are dealt once, to tasks that follow their number, and their places are counted there."""
    monkeypatch.setattr(more_queries, "POINTS_A_TASK", 100)
    spark.range(1, 2001).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    found = getattr(more_queries, name)(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 20), REPARTITION_BY_NUM" in plan
    assert found.count() == 2000
