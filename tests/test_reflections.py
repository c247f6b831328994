"""Reflections of any cell and their rings: against whole boxes, and what the plans look like."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggline.operators import bandjoin, hkl
from braggline.operators.structure import Structure
from braggline.plans import sql

CELL = "structure_id int, a double, b double, c double, alpha double, beta double, gamma double"


def cells(n, seed=4):
    r = random.Random(seed)
    return [(i, *(r.uniform(2, 6) for _ in range(3)), *(r.uniform(70, 110) for _ in range(3))) for i in range(n)]


def box(cell, dsmax):
    """Indices of a whole box, by the reciprocal metric."""
    _, a, b, c, *angles = cell
    ca, cb, cg = (math.cos(math.radians(x)) for x in angles)
    g = np.array([[a * a, a * b * cg, a * c * cb], [a * b * cg, b * b, b * c * ca], [a * c * cb, b * c * ca, c * c]])
    n = [int(dsmax * x) + 1 for x in (a, b, c)]
    m = np.stack(np.meshgrid(*(np.arange(-k, k + 1) for k in n), indexing="ij"), -1).reshape(-1, 3)
    ds = np.sqrt(np.einsum("ni,ij,nj->n", m, np.linalg.inv(g), m))
    keep = (ds > 0) & (ds < dsmax)
    return {tuple(x): d for x, d in zip(m[keep].tolist(), ds[keep].tolist(), strict=True)}


def test_triclinic(spark):
    rows = [*cells(25), (98, 12.0, 3.0, 40.0, 90.0, 95.0, 60.0), (99, 2.0, 30.0, 3.0, 62.0, 118.0, 119.0)]
    found = {}
    for r in hkl.make_hkls(spark.createDataFrame(rows, CELL), 1.1, 0.2).collect():
        found.setdefault(r.structure_id, {})[r.h, r.k, r.l] = r.ds
    for cell in rows:
        want = box(cell, 1.1)
        got = found[cell[0]]
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)
    odd = [(1, None, 3.0, 3.0, 90.0, 90.0, 90.0), (2, float("nan"), 3.0, 3.0, 90.0, 90.0, 90.0), (3, 3.0, 3.0, 3.0, 90.0, 90.0, 180.0), (4, 0.0, 3.0, 3.0, 90.0, 90.0, 90.0)]
    assert hkl.make_hkls(spark.createDataFrame(odd, CELL), 1.0, 0.2).count() == 0


def test_large_cell_is_dealt_out(spark):
    """One cell of many reflections: several tasks, and hardly a row that isn't kept."""
    one = spark.createDataFrame([(1, 40.0, 45.0, 50.0, 80.0, 100.0, 75.0)], CELL)
    found = hkl.make_hkls(one, 0.7, 0.2)
    kept = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    n = sum(r["count"] for r in kept)
    assert len(kept) >= 4 and max(r["count"] for r in kept) < 0.6 * n
    assert n == len(box((1, 40.0, 45.0, 50.0, 80.0, 100.0, 75.0), 0.7))
    # rows that the last index makes: SQL metrics of the plan that ran
    found.write.format("noop").mode("overwrite").save()
    made = found.collect() and _made(found)
    assert n <= made < 1.2 * n


def _made(df):
    """Rows out of the last explode, after a run of this plan."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Adaptive"):
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName() == "Generate":
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_sql_of_any_cell(spark):
    sql.register(spark)
    rows = cells(5, 8)
    spark.createDataFrame(rows, CELL).createOrReplaceTempView("own_cells")
    got = spark.sql("SELECT c.structure_id AS id, r.* FROM own_cells AS c, LATERAL cell_hkls(c.a, c.b, c.c, c.alpha, c.beta, c.gamma, 0.9D) AS r").collect()
    for cell in rows:
        want = box(cell, 0.9)
        own = {(r.h, r.k, r.l): r.ds for r in got if r.id == cell[0]}
        assert own.keys() == want.keys() and all(own[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_on_the_bound(spark):
    """Reflections of an edge of 5 at d* of 0.6 and 0.4 lie on the bound: the triclinic formula's rounding decides, as SQL has it."""
    rows = [(1, 4.5, 4.7, 5.0, 90.0, 90.0, 94.0), (2, 5.0, 5.2, 5.5, 90.0, 90.0, 90.0), (3, 4.8, 5.0, 5.3, 90.0, 90.0, 91.0)]
    sql.register(spark)
    spark.createDataFrame(rows, CELL).createOrReplaceTempView("edge_cells")
    for dsmax in (0.6, 0.4):
        want = set()
        for i, a, b, c, *angles in rows:
            (ca, sa), (cb, sb), (cg, sg) = ((math.cos(math.radians(x)), math.sin(math.radians(x))) for x in angles)
            for h, k, l in box((i, a, b, c, *angles), dsmax * 1.01):
                d2 = (h * b * c * sa) * (h * b * c * sa) + (k * a * c * sb) * (k * a * c * sb) + (l * a * b * sg) * (l * a * b * sg) + 2 * h * k * a * b * c * c * (ca * cb - cg) + 2 * k * l * a * a * b * c * (cb * cg - ca) + 2 * h * l * a * b * b * c * (ca * cg - cb)
                if math.sqrt(max(0, d2)) / (a * b * c * math.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)) < dsmax:
                    want.add((i, h, k, l))
        made = hkl.make_hkls(spark.createDataFrame(rows, CELL), dsmax, 0.2, metric=True).collect()
        called = spark.sql(f"SELECT e.structure_id, r.* FROM edge_cells AS e, LATERAL cell_hkls(e.a, e.b, e.c, e.alpha, e.beta, e.gamma, {dsmax}D) AS r").collect()
        assert {(r.structure_id, r.h, r.k, r.l) for r in made} == want == {(r.structure_id, r.h, r.k, r.l) for r in called}
        assert (1, 0, 0, 3) in want or dsmax < 0.6


def _many(spark, n=3):
    rows = spark.range(n).select(F.col("id").cast("int").alias("structure_id"), *((F.lit(3.0) + F.col("id") / 10).alias(x) for x in "abc"), *(F.lit(90.0).alias(x) for x in ("alpha", "beta", "gamma")))
    turns = [(x, y, z) for x in (1.0, -1.0) for y in (1.0, -1.0) for z in (1.0, -1.0)]
    rot = F.explode(F.array(*(F.struct(*(F.lit(t[i] if i == j else 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(3))) for t in turns)))
    return rows, rows.select("structure_id", rot.alias("rot")), rows.select("structure_id", F.lit("Fe").alias("element"), *(F.lit(0.0).alias(x) for x in "xyz"), F.lit(1.0).alias("occ"))


def test_equivalents_not_through_the_driver(spark):
    """Rotations of as many structures as there are rows are shuffled, not broadcast, whatever Spark takes their size for."""
    table, ops, _ = _many(spark)
    kept = hkl.remove_equivalents(hkl.make_hkls(table, 0.9, 0.3), ops)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan
    found = {}
    for r in kept.collect():
        found.setdefault(r.structure_id, set()).add((r.h, r.k, r.l))
    for i in range(3):
        edge = 3.0 + i / 10
        want = {tuple(map(abs, x)) for x in box((i, edge, edge, edge, 90.0, 90.0, 90.0), 0.9)}
        assert found[i] == want
    # without the identity, and of no structure at all
    assert hkl.remove_equivalents(hkl.make_hkls(table, 0.9, 0.3), ops.where("false")).count() == 0


def test_rings_not_through_the_driver(spark):
    """Nor are packed atoms, rings of as many structures, or the cells that a group's operations and atoms are kept for."""
    table, ops, atoms = _many(spark)
    with Structure(table.withColumn("sg_number", F.lit(1)), ops, atoms).make_hkls(0.9, 0.3) as s:
        assert "Broadcast" not in s.rings_table._jdf.queryExecution().executedPlan().toString()
        assert s.rings.count() > 0
    kept = Structure(table.withColumn("sg_number", F.lit(1)), ops, atoms).by_number(1)
    assert "Broadcast" not in kept.symmetry_ops._jdf.queryExecution().executedPlan().toString() and kept.sym_ops.count() == ops.count()


def test_tasks_follow_the_reflections(spark, monkeypatch):
    """Rows of a task don't grow with the table."""
    monkeypatch.setattr(hkl, "ROWS_A_TASK", 2000)
    table, ops, atoms = _many(spark, 200)
    tasks = hkl.tasks_of(table, 0.9)
    plan = hkl.rings_table(hkl.make_hkls(table, 0.9, 0.3, tasks=tasks), atoms, tasks=tasks)._jdf.queryExecution().executedPlan().toString()
    found = hkl.make_hkls(table, 0.9, 0.3).count()
    assert tasks > 8 and 0.8 < found / (tasks * 2000) < 1.2 and f", {tasks}), REPARTITION_BY_NUM" in plan
    assert hkl.tasks_of(table.where("false"), 0.9) == 8


def test_intensity_in_the_row(spark):
    """Sums over atoms as by numpy; no row for each reflection and atom, and nothing shuffled for the sum."""
    rows, r = cells(4, 9), random.Random(1)
    sites = [(i, e, r.random(), r.random(), r.random(), r.choice([1.0, 0.5])) for i in range(4) for e in ("Fe", "Fe", "O", "Sr", "Si")]
    atoms = spark.createDataFrame([*sites, (0, "O", None, 0.1, 0.2, 1.0)], "structure_id int, element string, x double, y double, z double, occ double")
    found = hkl.intensity(hkl.make_hkls(spark.createDataFrame(rows, CELL), 0.8, 0.2), atoms)
    strontium = lambda s: 38 / (1 + (4 * math.pi * hkl.SCREENING * s) ** 2 / 38 ** (2 / 3))
    for x in found.collect():
        total = 0
        for i, e, *at, occ in sites:
            if i == x.structure_id:
                row = hkl.FORM_FACTORS.get(e)
                f = strontium(x.ds / 2) if row is None else sum(a * math.exp(-b * (x.ds / 2) ** 2) for a, b in zip(row[:4], row[4:8], strict=True)) + row[8]
                total += f * occ * np.exp(2j * math.pi * np.dot((x.h, x.k, x.l), at))
        assert x.intensity == pytest.approx(abs(total) ** 2, rel=1e-9, abs=1e-9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and plan.count("Aggregate") == 2  # both pack atoms


def test_rings_once(spark):
    """All accessors read one table of rings, which goes when released."""
    rows = [(i, 3.0 + i / 10, 3.0 + i / 10, 3.0 + i / 10, 90.0, 90.0, 90.0) for i in range(3)]
    table = spark.createDataFrame(rows, CELL)
    atoms = spark.createDataFrame([(i, "Fe", x, x, x, 1.0) for i in range(3) for x in (0.0, 0.5)], "structure_id int, element string, x double, y double, z double, occ double")
    with Structure(table, spark.createDataFrame([], "structure_id int, rot int"), atoms).make_hkls(0.9, 0.3) as s:
        both = s.ringds.join(s.ringtth, ["structure_id", "ring_id"]).join(s.ringmult, ["structure_id", "ring_id"])
        assert both.count() == s.rings.count() > 0
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan and s.rings_table.storageLevel.useMemory
        held = s.rings_table
        assert {r.ring_id for r in s.ringhkls_arr.where("structure_id = 0").collect()} == {r.ring_id for r in s.rings.where("structure_id = 0").collect()}
    assert not held.storageLevel.useMemory


def test_copies_of_a_band(spark):
    """A value stands in one or two buckets of a band, mostly two of two: 4 copies for two bands at most, and candidates stay few."""
    n = 2000
    f = spark.range(n).select("id", (F.col("id") * 0.731 % 360).alias("a"), (F.col("id") * 0.277 % 90 - 45).alias("b"))
    for x, t in (("a", 0.25), ("b", 1.5)):
        size = f.select(F.size(bandjoin._buckets(F.col(x), t, 2 * t * (1 + 1e-6))).alias("n"))
        assert size.agg(F.max("n")).first()[0] == 2
    # values of any size and exactly at the tolerance
    left = spark.createDataFrame([(1, 1e12), (2, 0.5), (3, -0.75), (4, float("inf"))], "i int, x double").where("x < 1e300")
    right = spark.createDataFrame([(1, 1e12 + 0.25), (2, 0.75), (3, -1.0), (5, 0.25)], "j int, y double")
    got = {(r.i, r.j) for r in bandjoin.band_join(left, right, [("x", "y", 0.25)]).collect()}
    assert got == {(1, 1), (2, 2), (2, 5), (3, 3)}


def test_filters_of_cells_stay_small(spark):
    """Catalyst keeps what a filter says for every choice of the names that its terms have: one over all of a cell's columns fills the driver's memory."""
    k = F.col("structure_id")
    shapes = (3 + k / 10.0, 3.2 + k / 10.0, 3.5 + k / 10.0, 85.0 + k % 11, 88.0 + k % 5, 95.0 - k % 7)
    rows = spark.range(3).select(F.col("id").alias("structure_id")).select("structure_id", *(c.cast("double").alias(n) for c, n in zip(shapes, hkl.LPARS, strict=True)))
    node, said = hkl.make_hkls(rows, 0.6, 0.2, metric=True, tasks=8)._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        if node.nodeName() == "Filter":
            said.append(len(node.condition().toString()))
        node = node.children().apply(0)
    assert max(said) < 5000, said
