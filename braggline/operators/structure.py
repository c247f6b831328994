"""Crystal structures as three tables (cells, symmetry operations, atoms), and what is asked of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crystal
from ..sources.cif import cif_tables, cif_texts, parsed_cif
from . import hkl

KEY = "structure_id"


def unit_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with metric ``mt``, reciprocal metric ``rmt``, ``reciprocal`` parameters, ``bmat`` and ``volume``."""
    df = cells.withColumn("mt", crystal.lpars_to_mt(F.struct(*crystal.LPARS)))
    df = df.withColumn("rmt", crystal.mt_to_rmt(F.col("mt"))).withColumn("volume", crystal.metric_to_volume(F.col("mt")))
    return df.withColumn("reciprocal", crystal.mt_to_lpars(F.col("rmt"))).withColumn("bmat", crystal.lpars_to_B(F.struct(*crystal.LPARS)))


@dataclass
class Structure:
    """Any number of structures at once, told apart by ``structure_id``. Reflections are made by :meth:`make_hkls`,
    which returns a new object; asking for them before is an error."""

    cells: DataFrame
    symmetry_ops: DataFrame
    atoms: DataFrame
    scatter_table: DataFrame | None = None
    tol: float = 0.001
    _rings: DataFrame | None = field(default=None, repr=False)
    _parsed: DataFrame | None = field(default=None, repr=False)
    #: Tasks of the reflections, which follow their number.
    _tasks: int | None = field(default=None, repr=False)

    @classmethod
    def from_cif(cls, spark: SparkSession, path: str) -> Structure:
        return cls.from_texts(cif_texts(spark, path))

    @classmethod
    def from_texts(cls, texts: DataFrame) -> Structure:
        """Of CIF texts (structure_id, value)."""
        parsed = parsed_cif(texts)
        return cls(*cif_tables(parsed), _parsed=parsed)

    def by_number(self, sgno: int) -> Structure:
        """Those of a space group, by number."""
        return self._only(F.col("sg_number") == sgno)

    def by_name(self, sgname: str) -> Structure:
        """Those of a space group, by name; blanks don't count."""
        return self._only(F.regexp_replace("sg_name", r"\s", "") == sgname.replace(" ", ""))

    def _only(self, condition) -> Structure:
        cells = self.cells.where(condition)
        keep = cells.select(KEY).hint("merge")  # as many as there are cells: not through the driver
        return Structure(cells, self.symmetry_ops.join(keep, KEY, "left_semi"), self.atoms.join(keep, KEY, "left_semi"), None, self.tol)

    @property
    def sgno(self) -> DataFrame:
        return self.cells.select(KEY, "sg_number")

    @property
    def sgname(self) -> DataFrame:
        return self.cells.select(KEY, "sg_name")

    @property
    def sym_ops(self) -> DataFrame:
        return self.symmetry_ops.select(KEY, "rot")

    @property
    def unit_cell(self) -> DataFrame:
        return unit_cells(self.cells)

    def make_hkls(self, dsmax: float, wavelength: float, expand_to_p1: bool = True, tol: float = 0.001) -> Structure:
        """With all reflections up to dsmax, or one of each orbit of the symmetry operations and inversion."""
        tasks = hkl.tasks_of(self.cells, dsmax)
        table = hkl.make_hkls(self.cells, dsmax, wavelength, KEY, tasks=tasks)
        if not expand_to_p1:
            table = hkl.remove_equivalents(table, self.symmetry_ops, KEY, tasks)
        return Structure(self.cells, self.symmetry_ops, self.atoms, table, tol, _tasks=tasks)

    def _table(self) -> DataFrame:
        if self.scatter_table is None:
            raise AttributeError("there are no reflections yet: call make_hkls first")
        return self.scatter_table

    @property
    def allhkls(self) -> DataFrame:
        return self._table().select(KEY, "h", "k", "l")

    @property
    def alltth(self) -> DataFrame:
        return self._table().select(KEY, "tth")

    @property
    def allds(self) -> DataFrame:
        return self._table().select(KEY, "ds")

    @property
    def rings_table(self) -> DataFrame:
        """Reflections that aren't extinct, with intensity and ring_id. Computed once, when first needed, and kept in the executors' memory
        or on their disks for all that is asked of it, until :meth:`release`; what a lost executor held is computed anew."""
        if self._rings is None:
            self._rings = hkl.rings_table(self._table(), self.atoms, self.tol, KEY, self._tasks).persist(StorageLevel.MEMORY_AND_DISK)
        return self._rings

    def release(self) -> None:
        """Let go of the ring table, and of the parsed texts where this object was made from them; what is asked afterwards, of structures
        derived from it too, computes them again."""
        if self._parsed is not None:
            self._parsed.unpersist()
        if self._rings is not None:
            self._rings.unpersist()
            self._rings = None

    def __enter__(self) -> Structure:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    @property
    def rings(self) -> DataFrame:
        """One row a ring: ring_id from 0 by d*, first ds and tth, mult, hkls."""
        return hkl.rings(self.rings_table, KEY)

    rings_dict = rings

    @property
    def ringhkls(self) -> DataFrame:
        return self.rings.select(KEY, "ring_id", "ds", "hkls")

    @property
    def ringhkls_arr(self) -> DataFrame:
        """All rings' reflections, each with its ring: a table has no order of its own, so sort by (ring_id, ds, h, k, l) where one is wanted."""
        return self.rings_table.select(KEY, "ring_id", "ds", "h", "k", "l")

    @property
    def ringtth(self) -> DataFrame:
        return self.rings.select(KEY, "ring_id", "tth")

    @property
    def ringds(self) -> DataFrame:
        return self.rings.select(KEY, "ring_id", "ds")

    @property
    def ringmult(self) -> DataFrame:
        return self.rings.select(KEY, "ring_id", "mult")
