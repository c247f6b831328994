"""CIF reading, streams and SQL functions."""

import pytest
from pyspark.sql import functions as F

from braggline import more_queries
from braggline.operators import hkl
from braggline.plans import sql
from braggline.queries import TILTED
from braggline.sources import cif
from braggline.streaming.peaks import stream_peaks_to_q, stream_powder_histogram

CIF = """# body-centred iron, written for this test
data_iron
_symmetry_space_group_name_H-M   'I m m m'
_cell_length_a   2.8630(2)
_cell_length_b   2.8630
_cell_length_c   2.8630
_cell_angle_alpha   90
_cell_angle_beta   90.0
_cell_angle_gamma   90
_symmetry_Int_Tables_number   71
loop_
 _symmetry_equiv_pos_site_id
 _symmetry_equiv_pos_as_xyz
  1  'x, y, z'
  2  '-x, -y, -z'
  3  'x+1/2, y+1/2, z+1/2'
  4  '-x+1/2, -y+1/2, -z+0.5'
loop_
 _atom_site_type_symbol
 _atom_site_label
 _atom_site_fract_x
 _atom_site_fract_y
 _atom_site_fract_z
 _atom_site_occupancy
  Fe0+  Fe1  0.0  0.0(1)  0  1
"""


def test_cif(spark, tmp_path):
    (tmp_path / "iron.cif").write_text(CIF)
    cells, ops, atoms = cif.read_cif(spark, str(tmp_path))
    row = cells.first()
    assert (row.structure_id, row.a, row.sg_name, row.sg_number) == ("iron", 2.863, "I m m m", 71)
    assert ops.count() == 4 and {(r.element, r.x, r.y, r.z) for r in atoms.collect()} == {("Fe", 0, 0, 0), ("Fe", 0.5, 0.5, 0.5)}
    table = hkl.rings_table(hkl.make_hkls(cells, 0.75, 0.18), atoms)
    rings = hkl.rings(table).orderBy("ring_id").collect()
    assert [(round(r.ds, 4), r.mult) for r in rings] == [(0.494, 12), (0.6986, 6)]
    assert len(rings[0].hkls) == 12 and list(rings[0].hkls[0]) == [-1, -1, 0]


def test_names_and_elements(spark, tmp_path):
    # one file name in two folders; an element by the general rule; what isn't an element is an error
    for folder, element in (("a", "Fe"), ("b", "W")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x y.cif").write_text(CIF.replace("Fe0+", element))
    cells, ops, atoms = cif.read_cif(spark, str(tmp_path / "*" / "*.cif"))
    assert {r.structure_id for r in cells.collect()} == {"a/x y", "b/x y"} and atoms.count() == 4
    rings = hkl.rings(hkl.rings_table(hkl.make_hkls(cells, 0.75, 0.18), atoms)).collect()
    assert sorted((r.structure_id, r.mult) for r in rings) == [("a/x y", 6), ("a/x y", 12), ("b/x y", 6), ("b/x y", 12)]
    one = hkl.intensity(spark.createDataFrame([("s", 0, 0, 1, 1.0, 0.5)], "structure_id string, h int, k int, l int, tth double, ds double"), spark.createDataFrame([("s", "W", 0.0, 0.0, 0.0, 1.0)], "structure_id string, element string, x double, y double, z double, occ double")).first()
    assert 50**2 < one.intensity < 74**2
    assert all(abs(sum(v[:4]) + v[8] - hkl.ELEMENTS.index(e) - 1) < 0.05 for e, v in hkl.FORM_FACTORS.items())
    with pytest.raises(Exception, match="no form factor for element Xx"):
        hkl.intensity(hkl.make_hkls(cells, 0.75, 0.18), atoms.withColumn("element", F.lit("Xx"))).collect()


def test_operations():
    assert cif.operation("x-y, x, z+1/2") == ([[1, -1, 0], [1, 0, 0], [0, 0, 1]], [0.0, 0.0, 0.5])
    for bad in ("x, y", "x*2, y, z", "__import__('os'), y, z", "xy, y, z", "x; y; z"):
        with pytest.raises(ValueError):
            cif.operation(bad)


def test_texts_in_portions(spark):
    """Tables of a few texts at once, dealt out by the caller; the atoms of a site that operations bring to one place are one."""
    cif._known.cache_clear()
    texts = spark.range(1000).select(F.col("id").cast("string").alias("structure_id"), F.lit(CIF).alias("value")).coalesce(1)
    sizes = []
    real, cif._columns = cif._columns, lambda names, found: sizes.append(len(found)) or real(names, found)
    try:
        parts = [found for at in range(0, 450, cif.PORTION) for found in [[cif.structure(CIF) for _ in range(min(cif.PORTION, 450 - at))]]]
        assert [len(cif._columns([str(i) for i in range(len(p))], p)[9]) for p in parts] == sizes == [200, 200, 50]
    finally:
        cif._columns = real
    assert cif._known.cache_info().misses == 4
    cells, ops, atoms = cif.parse_cif(texts)
    assert (cells.count(), ops.count(), atoms.count()) == (1000, 4000, 2000)
    assert atoms.groupBy("x", "y", "z").count().orderBy("x").collect() == [(0.0, 0.0, 0.0, 1000), (0.5, 0.5, 0.5, 1000)]


def test_bad_cif_is_named(spark, tmp_path):
    (tmp_path / "bad.cif").write_text("data_x\n_cell_length_a 1\n")
    with pytest.raises(Exception, match="bad.cif"):
        cif.read_cif(spark, str(tmp_path))[0].collect()


def test_stream(spark, tmp_path):
    rows = spark.range(40).select(F.timestamp_seconds(F.col("id") * 30).alias("t"), (F.col("id") * 50.0).alias("sc"), (F.col("id") * 31.0 % 2048).alias("fc"), (F.col("id") * 9.0 - 180).alias("omega"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_peaks_to_q(stream, TILTED).writeStream.format("memory").queryName("peaks_q").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.table("peaks_q").count() == 40
    h = stream_powder_histogram(stream, TILTED, "t", "5 minutes", "10 minutes")
    q = h.writeStream.format("memory").queryName("powder").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.table("powder").agg(F.sum("n")).first()[0] == 40


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("SELECT ds_to_tth(0.5, 0.18)").first()[0] == pytest.approx(5.158360, abs=1e-5)
    assert spark.sql("SELECT count(*) FROM cubic_hkls(3.0, 0.5)").first()[0] == 18
    assert spark.sql("SELECT metric_to_volume(2, 3, 4, 90, 90, 90)").first()[0] == pytest.approx(24)


def test_files_in_one_folder(spark, tmp_path, monkeypatch):
    # a file each, but no folder each, which would be made, listed and moved one by one; whose they are is told by their data blocks
    monkeypatch.setattr(more_queries, "shared_path", lambda *_: str(tmp_path / "cifs"))
    rows = more_queries.cif_files(spark, "/root/testdata/sf0.001").collect()
    suppliers = {str(r.s_suppkey) for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect()}
    assert {r.structure_id for r in rows} == suppliers and len(rows) == len(suppliers)
    own = list((tmp_path / "cifs").iterdir())
    assert not [p for p in own if p.is_dir()] and len([p for p in own if p.name.startswith("part-") and p.stat().st_size]) == len(suppliers)
