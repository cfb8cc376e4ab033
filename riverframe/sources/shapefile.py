"""Polygon shapefiles as a Spark data source: a partitioned reader with a pushed bounding box, and a writer that commits.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("polygons_shp").option("bbox", "-71,-31,-70,-30").load(folder)
    df.write.format("polygons_shp").mode("overwrite").save(folder)

A folder holds any number of .shp files with .shx and .dbf beside them; a path may also name one .shp. Rows have the
box (xmin, ymin, xmax, ymax), rings array<array<struct<lon,lat>>> and the attributes. Reading tasks are runs of
records found through .shx, so a large file is read by many. Records outside the box are skipped by their own box;
files outside are skipped by the boxes that the writer noted, or else by their heads. With option("pushdown", "true")
and spark.sql.python.filterPushdown.enabled comparisons of the four box columns with numbers are pushed as well.

Paths are whatever pyarrow's file systems open; on a cluster a folder that all executors share. Writing tasks write
files of their own under a name that readers pass over; commit moves them into place, abort deletes them. Null
attributes are blank and come back as null (of text, so does the empty string); null or empty rings are null shapes.
Texts beyond 254 bytes raise ValueError.
"""

from __future__ import annotations

import datetime
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, Row, ShortType, StringType, StructField, StructType

from ..operators.geometry import simplify

BOX = ("xmin", "ymin", "xmax", "ymax")
POINT = StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())])
#: Records that a reading task takes at a time, and the file that notes the boxes.
RUN, NOTE = 4096, "_boxes.json"
# The projection text of geographic coordinates.
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["Degree",0.017453292519943295]]'
#: Of each type: the attribute's letter, its width and its decimals.
KINDS = {LongType: (b"N", 20, 0), IntegerType: (b"N", 11, 0), ShortType: (b"N", 6, 0), ByteType: (b"N", 4, 0), DoubleType: (b"N", 24, 15), FloatType: (b"N", 24, 15), StringType: (b"C", 254, 0), BooleanType: (b"L", 1, 0), DateType: (b"D", 8, 0)}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The .shp files of a path, in order of name; names that begin with _ or . are passed over."""
    fs, at = _open(path)
    if at.endswith(".shp"):
        return [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=False))
    return sorted(f.path for f in found if f.base_name.endswith(".shp") and f.base_name[0] not in "_.")


def _part(fs: pafs.FileSystem, path: str, start: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


@dataclass
class Fields:
    """The head of a .dbf: number of records, where they begin, their length, and (name, letter, width, decimals) of each field."""

    records: int
    begin: int
    length: int
    fields: list[tuple[str, str, int, int]]

    @classmethod
    def read(cls, fs: pafs.FileSystem, path: str) -> Fields:
        n, begin, length = struct.unpack("<IHH", _part(fs, path, 4, 8))
        raw = _part(fs, path, 32, begin - 33)
        fields = [raw[i : i + 32] for i in range(0, len(raw) - 31, 32)]
        return cls(n, begin, length, [(f[:11].split(b"\0")[0].decode(), chr(f[11]), f[16], f[17]) for f in fields if f[0] != 0x0D])

    def schema(self) -> StructType:
        kind = lambda letter, width, decimals: {"C": StringType(), "L": BooleanType(), "D": DateType()}.get(letter) or (DoubleType() if decimals or letter == "F" else LongType() if width > 9 else IntegerType())
        return StructType([StructField(name, kind(*rest)) for name, *rest in self.fields])

    def values(self, raw: bytes) -> list:
        out, at = [], 1
        for _, letter, width, decimals in self.fields:
            text = raw[at : at + width].decode("utf-8", "replace").strip(" \0")
            at += width
            if not text or letter == "L" and text == "?" or set(text) == {"*"}:
                out.append(None)
            elif letter == "C":
                out.append(text)
            elif letter == "L":
                out.append(text in "YyTt")
            elif letter == "D":
                out.append(datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])))
            else:
                out.append(float(text) if decimals or letter == "F" else int(float(text)) if "." in text else int(text))
        return out


def outside(box: tuple[float, ...], wanted: list[tuple[str, str, float]]) -> bool:
    """Whether no shape within this box can satisfy the conditions (column of the box, comparison, number)."""
    x0, y0, x1, y1 = box
    reach = {"xmin": (x0, x1), "xmax": (x0, x1), "ymin": (y0, y1), "ymax": (y0, y1)}
    return any(reach[c][0] > v if op == "<=" else reach[c][0] >= v if op == "<" else reach[c][1] < v if op == ">=" else reach[c][1] <= v for c, op, v in wanted)


def fails(box: tuple[float, ...], wanted: list[tuple[str, str, float]]) -> bool:
    """Whether a shape with exactly this box misses one of the conditions."""
    at = dict(zip(BOX, box))
    return not all(at[c] <= v if op == "<=" else at[c] < v if op == "<" else at[c] >= v if op == ">=" else at[c] > v for c, op, v in wanted)


@dataclass
class Run(InputPartition):
    path: str
    first: int
    last: int


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, bbox: str | None):
        self.path = path
        self.wanted: list[tuple[str, str, float]] = []
        if bbox:
            w, s, e, n = map(float, bbox.split(","))
            self.wanted += [("xmin", "<=", e), ("xmax", ">=", w), ("ymin", "<=", n), ("ymax", ">=", s)]

    def partitions(self) -> list[Run]:
        fs, at = _open(self.path)
        note, known = f"{at.rstrip('/')}/{NOTE}", {}
        if not at.endswith(".shp") and fs.get_file_info(note).type == pafs.FileType.File:
            known = json.loads(_part(fs, note, 0, fs.get_file_info(note).size))
        runs = []
        for path in _files(self.path):
            name = path.rpartition("/")[2]
            if name in known:
                box, records = tuple(known[name]["box"]), known[name]["records"]
            else:
                box = struct.unpack("<4d", _part(fs, path, 36, 32))
                records = (fs.get_file_info(path[:-4] + ".shx").size - 100) // 8
            if records and not (self.wanted and outside(box, self.wanted)):
                runs += [Run(path, i, min(records, i + RUN)) for i in range(0, records, RUN)]
        return runs or [Run("", 0, 0)]

    def read(self, run: Run) -> Iterator[tuple]:
        if not run.path:
            return
        fs, _ = _open(self.path)
        index = struct.unpack(f">{2 * (run.last - run.first)}i", _part(fs, run.path[:-4] + ".shx", 100 + 8 * run.first, 8 * (run.last - run.first)))
        fields = Fields.read(fs, run.path[:-4] + ".dbf")
        rows = _part(fs, run.path[:-4] + ".dbf", fields.begin + run.first * fields.length, (run.last - run.first) * fields.length)
        with fs.open_input_file(run.path) as f:
            for k, (offset, length) in enumerate(zip(index[::2], index[1::2])):
                values = rows[k * fields.length : (k + 1) * fields.length]
                if values[:1] == b"*":  # deleted
                    continue
                f.seek(2 * offset + 8)
                raw = f.read(36)
                if struct.unpack_from("<i", raw)[0] == 0:
                    if not self.wanted:
                        yield (None, None, None, None, None, *fields.values(values))
                    continue
                box = struct.unpack_from("<4d", raw, 4)
                if fails(box, self.wanted):
                    continue
                raw = f.read(2 * length - 36)
                parts, points = struct.unpack_from("<2i", raw)
                starts = [*struct.unpack_from(f"<{parts}i", raw, 8), points]
                xy = struct.unpack_from(f"<{2 * points}d", raw, 8 + 4 * parts)
                rings = [[Row(lon=xy[2 * i], lat=xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
                yield (*box, rings, *fields.values(values))


class PushingReader(ShapefileReader):
    """Spark refuses readers that take filters while pushing them is switched off, so this one is asked for."""

    def pushFilters(self, filters):
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in BOX and isinstance(f.value, (int, float)):
                self.wanted.append((f.attribute[0], signs[type(f)], float(f.value)))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    name: str
    box: tuple[float, ...]
    records: int


def oriented(ring: list[tuple[float, float]], clockwise: bool) -> list[tuple[float, float]]:
    """The ring closed and turned the way asked."""
    ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    return ring if (twice < 0) == clockwise else ring[::-1]


class ShapefileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.tag = path, overwrite, uuid.uuid4().hex[:12]
        self.fields = [f for f in schema.fields if f.name not in (*BOX, "rings")]
        if "rings" not in schema.names:
            raise ValueError("a column rings array<array<struct<lon,lat>>> is needed")
        for f in self.fields:
            if type(f.dataType) not in KINDS or len(f.name.encode()) > 10:
                raise ValueError(f"{f.name}: attributes are numbers, texts, dates or booleans with names of at most 10 bytes")

    def _cell(self, field: StructField, value) -> bytes:
        letter, width, _ = KINDS[type(field.dataType)]
        if value is None:
            return (b"?" if letter == b"L" else b" ") * width
        text = ("T" if value else "F") if letter == b"L" else value.strftime("%Y%m%d") if letter == b"D" else repr(value) if letter == b"N" else value
        raw = text.encode()
        if len(raw) > width:
            raise ValueError(f"{field.name}: a value of {len(raw)} bytes, at most {width} fit")
        return raw.rjust(width) if letter == b"N" else raw.ljust(width)

    def write(self, rows: Iterator[Row]) -> Written:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        name = f"part-{self.tag}-{uuid.uuid4().hex[:12]}"
        whole, n, words = [float("inf"), float("inf"), float("-inf"), float("-inf")], 0, 50
        paths = {e: f"{at.rstrip('/')}/_{name}.{e}" for e in ("shp", "shx", "dbf", "prj")}
        shp, shx, dbf = [], [], []
        for row in rows:
            n += 1
            rings = [[(p["lon"], p["lat"]) for p in ring] for ring in (row["rings"] or []) if ring]
            rings = [oriented(r, i == 0) for i, r in enumerate(rings)]
            body = struct.pack("<i", 0)
            if rings:
                xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
                box = (min(xs), min(ys), max(xs), max(ys))
                whole = [min(whole[0], box[0]), min(whole[1], box[1]), max(whole[2], box[2]), max(whole[3], box[3])]
                starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
                body = struct.pack(f"<i4d2i{len(rings)}i{2 * len(xs)}d", 5, *box, len(rings), len(xs), *starts, *(v for r in rings for p in r for v in p))
            shx.append(struct.pack(">2i", words, len(body) // 2))
            shp.append(struct.pack(">2i", n, len(body) // 2) + body)
            words += 4 + len(body) // 2
            dbf.append(b" " + b"".join(self._cell(f, row[f.name]) for f in self.fields))
        box = tuple(whole) if whole[0] <= whole[2] else (0.0, 0.0, 0.0, 0.0)
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i4d4d", 1000, 5, *box, 0, 0, 0, 0)
        kinds = [KINDS[type(f.dataType)] for f in self.fields]
        today = datetime.date.today()
        table = struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, n, 33 + 32 * len(self.fields), 1 + sum(k[1] for k in kinds))
        table += b"".join(f.name.encode().ljust(11, b"\0") + k[0] + b"\0" * 4 + bytes(k[1:]) + b"\0" * 14 for f, k in zip(self.fields, kinds)) + b"\r"
        for e, chunks in (("shp", [head(words), *shp]), ("shx", [head(50 + 4 * n), *shx]), ("dbf", [table, *dbf, b"\x1a"]), ("prj", [WGS84.encode()])):
            with fs.open_output_stream(paths[e]) as f:
                for chunk in chunks:
                    f.write(chunk)
        return Written(name, box, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        at = at.rstrip("/")
        note, known = f"{at}/{NOTE}", {}
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at, recursive=False)):
                if f.base_name.startswith("part-") and f.base_name.rpartition(".")[2] in ("shp", "shx", "dbf", "prj"):
                    fs.delete_file(f.path)
        elif fs.get_file_info(note).type == pafs.FileType.File:
            known = json.loads(_part(fs, note, 0, fs.get_file_info(note).size))
        for m in (m for m in messages if m is not None):
            for e in ("dbf", "shx", "prj", "shp"):  # readers look for .shp, which comes last
                fs.move(f"{at}/_{m.name}.{e}", f"{at}/{m.name}.{e}")
            known[f"{m.name}.shp"] = {"box": list(m.box), "records": m.records}
        with fs.open_output_stream(note) as f:
            f.write(json.dumps(known).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(at, recursive=False)):
                if f.base_name.startswith(f"_part-{self.tag}-"):
                    fs.delete_file(f.path)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polygons_shp"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no shapefile in {self.options['path']}")
        fs, _ = _open(self.options["path"])
        shape = [StructField(c, DoubleType()) for c in BOX] + [StructField("rings", ArrayType(ArrayType(POINT)))]
        return StructType(shape + Fields.read(fs, files[0][:-4] + ".dbf").schema().fields)

    def reader(self, schema: StructType) -> ShapefileReader:
        kind = PushingReader if self.options.get("pushdown", "").lower() == "true" else ShapefileReader
        return kind(self.options["path"], self.options.get("bbox"))

    def writer(self, schema: StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(self.options["path"], schema, overwrite)


def basins(shapes: DataFrame, names: dict[str, str], tolerance: float = 0.0) -> DataFrame:
    """(id, next_down, sub_area, up_area, w, s, e, n, ring): basins of shapes by the names of their attributes (id, next_down, sub_area, up_area).

    The outer ring only, thinned within `tolerance` degrees and rounded to five decimals; rings of fewer than four
    points go. Areas are rounded to two decimals; names that are missing give null."""

    @F.pandas_udf("array<int>")
    def kept(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series([simplify(np.column_stack((x, y)), tolerance).tolist() if len(x) else [] for x, y in zip(lon, lat)])

    value = lambda key, kind: F.col(names[key]).cast(kind) if key in names else F.lit(None).cast(kind)
    rows = shapes.filter("rings is not null").select(value("id", "bigint").alias("id"), value("next_down", "bigint").alias("next_down"), F.round(value("sub_area", "double"), 2).alias("sub_area"), F.round(value("up_area", "double"), 2).alias("up_area"), F.transform(F.col("rings")[0], lambda p: F.struct(F.round(p["lon"], 5).alias("lon"), F.round(p["lat"], 5).alias("lat"))).alias("ring"))
    if tolerance > 0:
        rows = rows.withColumn("__k", kept(F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])))
        rows = rows.withColumn("ring", F.transform("__k", lambda i: F.get(F.col("ring"), i))).drop("__k")
    rows = rows.filter(F.size("ring") >= 4)
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return rows.select("id", "next_down", "sub_area", "up_area", edge(F.array_min, "lon").alias("w"), edge(F.array_min, "lat").alias("s"), edge(F.array_max, "lon").alias("e"), edge(F.array_max, "lat").alias("n"), "ring")
