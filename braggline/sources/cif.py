"""Crystal structures from CIF files: cells, symmetry operations and the atoms of the whole cell.

Files are read by Spark as whole texts, one row a file, and parsed on the executors. The parser knows data items and
loops, quoted values, uncertainties in brackets, and the two usual tags of symmetry operations; operations are read
by a strict affine grammar, never evaluated. A file without the needed items raises an error that names its structure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = tuple(f"_cell_{n}" for n in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma"))
OPERATIONS = ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz")
NAMES = ("_symmetry_space_group_name_H-M", "_space_group_name_H-M_alt", "_space_group_name_H-M")
NUMBERS = ("_symmetry_Int_Tables_number", "_space_group_IT_number")
#: Atoms nearer than this in each fractional coordinate are one.
SAME_ATOM = 1e-4
#: Texts whose tables are held in Python at once.
PORTION = 200
_TOKEN = re.compile(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|#[^\n]*|(?:(?<=\n)|^);(.*?)\n;|(\S+)", re.DOTALL)
_TERM = re.compile(r"([+-]?)(?:(\d+)(?:/(\d+)|(\.\d+))?|([xyz]))")


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(value, quoted) of a CIF text."""
    for m in _TOKEN.finditer(text):
        if m[4] is not None:
            yield m[4], False
        elif (q := next((g for g in (m[1], m[2], m[3]) if g is not None), None)) is not None:
            yield q, True


def parse(text: str) -> tuple[dict[str, str], list[dict[str, list[str]]]]:
    """Items and loops of the first data block."""
    items: dict[str, str] = {}
    loops: list[dict[str, list[str]]] = []
    row = [*tokens(text), ("data_", False)]
    i, blocks = 0, 0
    is_word = lambda t: not t[1] and (t[0].startswith("_") or t[0].lower() == "loop_" or t[0].lower().startswith("data_"))
    while i < len(row):
        word, quoted = row[i]
        low = word.lower()
        if not quoted and low.startswith("data_"):
            blocks += 1
            if blocks > 1:
                break
            i += 1
        elif not quoted and low == "loop_":
            i, names = i + 1, []
            while row[i][0].startswith("_") and not row[i][1]:
                names.append(row[i][0])
                i += 1
            values = []
            while not is_word(row[i]):
                values.append(row[i][0])
                i += 1
            if names:
                loops.append({n: values[k :: len(names)] for k, n in enumerate(names)})
        elif not quoted and word.startswith("_") and not is_word(row[i + 1]):
            items[word] = row[i + 1][0]
            i += 2
        else:
            i += 1
    return items, loops


def number(s: str) -> float:
    """Without the uncertainty in brackets."""
    return float(re.sub(r"\(\d+\)$", "", s))


def operation(s: str) -> tuple[list[list[int]], list[float]]:
    """Rotation and translation of 'x-y, x, z+1/2'. Anything but signs, numbers and x, y, z is an error."""
    parts = s.lower().replace(" ", "").split(",")
    if len(parts) != 3:
        raise ValueError(f"not a symmetry operation: {s!r}")
    rotation, shift = [], []
    for part in parts:
        row, t, at = [0, 0, 0], Fraction(0), 0
        while at < len(part):
            m = _TERM.match(part, at)
            if not m or at and not m[1]:
                raise ValueError(f"not a symmetry operation: {s!r}")
            sign = -1 if m[1] == "-" else 1
            if m[5]:
                row["xyz".index(m[5])] += sign
            else:
                t += sign * Fraction(f"{m[2]}/{m[3]}" if m[3] else m[2] + (m[4] or ""))
            at = m.end()
        rotation.append(row)
        shift.append(float(t))
    return rotation, shift


@lru_cache(4096)
def _known(s: str) -> tuple[list[list[int]], list[float]]:
    """:func:`operation`, as structures have most of theirs in common."""
    return operation(s)


@lru_cache(256)
def _operations(found: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (n, 3, 3) and translations (n, 3) of a list of operations."""
    ops = [_known(s) for s in found]
    return np.array([r for r, _ in ops], float).reshape(-1, 3, 3), np.array([t for _, t in ops], float).reshape(-1, 3)


def _orbit(rot: np.ndarray, trans: np.ndarray, at: list[float]) -> np.ndarray:
    """Places that the operations bring a site to; of those that are one, the first."""
    p = np.mod(rot[:, :, 0] * at[0] + rot[:, :, 1] * at[1] + rot[:, :, 2] * at[2] + trans, 1.0)
    own, left = [], np.arange(len(p))
    while len(left):
        own.append(left[0])
        d = np.abs(p[left] - p[left[0]])
        far = ~(np.minimum(d, 1 - d) < SAME_ATOM).all(axis=1)
        far[0] = False
        left = left[far]
    return p[own]


def structure(text: str) -> dict:
    """cell, name, number, operations (rotations, translations) and the distinct atoms of the cell (elements, labels, places, occupancies)."""
    items, loops = parse(text)
    first = lambda names: next((items[n] for n in names if n in items), None)
    found = next((loop[n] for loop in loops for n in OPERATIONS if n in loop), ["x, y, z"])
    ops = _operations(tuple(found))
    sites = next(loop for loop in loops if "_atom_site_fract_x" in loop)
    elements, labels, places, occupied = [], [], [np.zeros((0, 3))], []
    n = len(sites["_atom_site_fract_x"])
    symbols = sites.get("_atom_site_type_symbol") or sites["_atom_site_label"]
    for i in range(n):
        element = re.match(r"[A-Za-z]{1,2}", symbols[i])[0].capitalize()
        label = sites.get("_atom_site_label", symbols)[i]
        at = [number(sites[f"_atom_site_fract_{c}"][i]) for c in "xyz"]
        occ = number(sites["_atom_site_occupancy"][i]) if "_atom_site_occupancy" in sites else 1.0
        own = _orbit(*ops, at)
        places.append(own)
        elements, labels, occupied = elements + [element] * len(own), labels + [label] * len(own), occupied + [occ] * len(own)
    number_ = first(NUMBERS)
    return {"cell": [number(items[c]) for c in CELL], "name": first(NAMES), "number": int(number_) if number_ else None, "ops": ops, "atoms": (elements, labels, np.concatenate(places), occupied)}


_SCHEMA = "structure_id string, a double, b double, c double, alpha double, beta double, gamma double, sg_name string, sg_number int, ops array<struct<rot:struct<" + ",".join(f"m{i}{j}:double" for i in range(3) for j in range(3)) + ">,trans:struct<x:double,y:double,z:double>>>, atoms array<struct<element:string,label:string,x:double,y:double,z:double,occ:double>>"


NAMES_OUT = ["structure_id", "a", "b", "c", "alpha", "beta", "gamma", "sg_name", "sg_number", "ops", "atoms"]


def _columns(names: pa.Array, found: list[dict]) -> list[pa.Array]:
    """Columns of :data:`_SCHEMA` of parsed structures."""
    fields = lambda values, n: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(n))], names=n)
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    cells = np.array([s["cell"] for s in found], float).reshape(-1, 6)
    rot, trans = (np.concatenate([s["ops"][i] for s in found]) for i in (0, 1))
    both = pa.StructArray.from_arrays([fields(rot.reshape(-1, 9), [f"m{i}{j}" for i in range(3) for j in range(3)]), fields(trans, list("xyz"))], names=["rot", "trans"])
    ops = pa.ListArray.from_arrays(ends([len(s["ops"][0]) for s in found]), both)
    flat = [[x for s in found for x in s["atoms"][i]] for i in (0, 1, 3)]
    xyz = np.concatenate([s["atoms"][2] for s in found])
    atom = pa.StructArray.from_arrays([pa.array(flat[0], pa.string()), pa.array(flat[1], pa.string()), *(pa.array(np.ascontiguousarray(xyz[:, i])) for i in range(3)), pa.array(flat[2], pa.float64())], names=["element", "label", "x", "y", "z", "occ"])
    atoms = pa.ListArray.from_arrays(ends([len(s["atoms"][0]) for s in found]), atom)
    return [names, *(pa.array(np.ascontiguousarray(cells[:, i])) for i in range(6)), pa.array([s["name"] for s in found], pa.string()), pa.array([s["number"] for s in found], pa.int32()), ops, atoms]


def _root(path: str) -> str:
    """The folder that structures are named relative to: up to the first wildcard, or the folder itself."""
    plain = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    if plain != path or path.endswith(".cif"):
        plain = plain.rsplit("/", 1)[0] if "/" in plain else ""
    return re.sub(r"^[a-z0-9]+:/*(?=/)", "", plain).rstrip("/")


def cif_texts(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, value, origin) of all CIF files at a path, read by Spark from whatever store it reaches. structure_id is the file's path below the
    given one, without its ending, so that files of one name in several folders stay apart."""
    at = F.concat(F.lit(_root(path)), F.lit("/"))
    name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    place = F.instr(name, at) if _root(path) else F.lit(0)
    name = F.when(place > 0, F.substring(name, place + F.length(at), F.length(name))).otherwise(F.substring_index(name, "/", -1))
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, r"\.cif$", "").alias("structure_id"), "value", F.input_file_name().alias("origin"))


def read_cif(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unit_cells, symmetry_ops, atom_sites) of all CIF files at a path, by :func:`cif_texts` and :func:`parse_cif`."""
    return parse_cif(cif_texts(spark, path))


def parsed_cif(texts: DataFrame) -> DataFrame:
    """CIF texts (structure_id, value), each parsed once: cells with arrays of operations and atoms. Errors name the ``origin``, where there is
    such a column. The three tables that :func:`cif_tables` makes of it read it once each, so it is kept; ``unpersist`` it when done."""

    def run(batches):
        for batch in batches:
            # in portions: the tables of a text are larger than the text
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                found = []
                for text, origin in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    try:
                        found.append(structure(text))
                    except (KeyError, StopIteration, ValueError, TypeError, IndexError) as e:
                        raise ValueError(f"{origin} can't be read as a CIF: {e!r}") from e
                yield pa.RecordBatch.from_arrays(_columns(part.column(0), found), names=NAMES_OUT)

    # a lost executor parses its own anew
    origin = F.col("origin" if "origin" in texts.columns else "structure_id").alias("origin")
    return texts.select("structure_id", "value", origin).mapInArrow(run, _SCHEMA).persist()


def cif_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unit_cells, symmetry_ops, atom_sites)."""
    cells = parsed.select("structure_id", "a", "b", "c", "alpha", "beta", "gamma", "sg_name", "sg_number")
    ops = parsed.select("structure_id", F.posexplode("ops").alias("op_id", "o")).select("structure_id", "op_id", "o.rot", "o.trans")
    atoms = parsed.select("structure_id", F.explode("atoms").alias("s")).select("structure_id", "s.*")
    return cells, ops, atoms


def parse_cif(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unit_cells, symmetry_ops, atom_sites) of CIF texts (structure_id, value), which stay parsed as long as the session lasts."""
    return cif_tables(parsed_cif(texts))
