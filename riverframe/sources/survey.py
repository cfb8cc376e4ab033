"""Survey files: CAD drawings, KML and KMZ, GeoJSON, raster tiles, ASCII grids.

Files are read whole as rows (path, content) and parsed one by one inside tasks; each parser is a small
function that yields rows, so a folder of drawings spreads over the cluster.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "path string, entity int, kind string, layer string, closed boolean, text string, points array<struct<x:double,y:double,z:double>>"
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))


def decode(raw: bytes) -> str:
    """UTF-8, or latin-1 when more than twenty characters would be lost."""
    text = raw.decode("utf-8", errors="replace")
    return text if text.count("�") <= 20 else raw.decode("latin-1")


def dxf_entities(text: str) -> Iterator[tuple[str, str, bool, str | None, list[tuple[float, float, float]]]]:
    """(kind, layer, closed, text, points) of the entities of a drawing: lines, polylines, points, faces and texts."""
    lines = text.splitlines()
    pairs = [(a.strip(), b.strip()) for a, b in zip(lines[::2], lines[1::2])]
    inside, current, vertices = False, None, None
    kinds = {"LINE": "line", "POINT": "point", "3DFACE": "face", "TEXT": "text", "MTEXT": "text", "LWPOLYLINE": "polyline", "POLYLINE": "polyline"}

    def number(x: str) -> float:
        try:
            return float(x)
        except ValueError:
            return 0.0

    def done(e: dict) -> tuple:
        n = max((len(e[c]) for c in "xy"), default=0)
        z = e["z"] if len(e["z"]) == n else [e["z"][0] if e["z"] and e["kind"] != "polyline" else e["elevation"]] * n
        points = [(e["x"][i], e["y"][i] if i < len(e["y"]) else 0.0, z[i]) for i in range(n)]
        if e["kind"] == "face" and len(points) == 4 and points[3] == points[2]:
            points = points[:3]
        return e["kind"], e["layer"], e["closed"], e["text"], points

    def fresh(kind: str) -> dict:
        return {"kind": kind, "layer": "0", "closed": False, "text": None, "x": [], "y": [], "z": [], "elevation": 0.0}

    for code, value in pairs:
        if code == "2" and value == "ENTITIES" and not inside:
            inside = True
        elif not inside:
            continue
        elif code == "0":
            if current is not None and value != "VERTEX" and not (value == "SEQEND" and vertices):
                yield done(current)
                current = None
            if value == "ENDSEC":
                return
            if value == "VERTEX" and vertices:
                pass
            elif value == "SEQEND" and vertices:
                yield done(current)
                current, vertices = None, None
            elif value in kinds:
                current = fresh(kinds[value])
                vertices = value == "POLYLINE"
                skip_first = vertices
            continue
        elif current is None:
            continue
        elif code == "8":
            current["layer"] = value
        elif code == "70" and current["kind"] == "polyline":
            current["closed"] |= bool(int(number(value)) & 1) if not (vertices and current["x"]) else False
        elif code == "38":
            current["elevation"] = number(value)
        elif code == "1":
            current["text"] = value
        elif code in ("10", "11", "12", "13"):
            if vertices and skip_first:
                continue
            current["x"].append(number(value))
        elif code in ("20", "21", "22", "23"):
            if vertices and skip_first:
                continue
            current["y"].append(number(value))
        elif code in ("30", "31", "32", "33"):
            if vertices and skip_first:
                skip_first = False
                continue
            current["z"].append(number(value))
    if current is not None:
        yield done(current)


def kml_features(raw: bytes) -> Iterator[tuple[str, str, bool, str | None, list[tuple[float, float, float]]]]:
    """Placemarks of KML or KMZ as (kind, name, closed, None, points); of polygons the outer ring."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            raw = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
    root = ElementTree.fromstring(raw)
    local = lambda e: e.tag.rpartition("}")[2]
    for mark in (e for e in root.iter() if local(e) == "Placemark"):
        name = next((e.text or "" for e in mark.iter() if local(e) == "name"), "")
        for g in (e for e in mark.iter() if local(e) in ("Point", "LineString", "Polygon")):
            holder = next((e for e in g.iter() if local(e) == "outerBoundaryIs"), g) if local(g) == "Polygon" else g
            text = next((e.text or "" for e in holder.iter() if local(e) == "coordinates"), "")
            points = [tuple((*map(float, c.split(",")), 0.0)[:3]) for c in text.split()]
            yield {"Point": "point", "LineString": "polyline", "Polygon": "polygon"}[local(g)], name, local(g) == "Polygon", None, points


def _read(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0), batch.column(1)):
                rows = [(file.as_py(), i, *e) for i, e in enumerate(parse(raw.as_py()))]
                columns = list(zip(*rows)) or [()] * 7
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                points = pa.array([[{"x": p[0], "y": p[1], "z": p[2]} for p in e] for e in columns[6]], _POINTS)
                yield pa.RecordBatch.from_arrays([*arrays, points], ["path", "entity", "kind", "layer", "closed", "text", "points"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ENTITY)


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda raw: dxf_entities(decode(raw)))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, kml_features)


def layer_inventory(entities: DataFrame) -> DataFrame:
    """Counts by kind and heights of each layer."""
    heights = entities.select("path", "layer", F.explode("points").alias("p")).groupBy("path", "layer").agg(F.count(F.lit(1)).alias("vertices"), F.avg((F.col("p.z") != 0).cast("int")).alias("share_z"), F.min("p.z").alias("z_min"), F.max("p.z").alias("z_max"))
    counts = entities.groupBy("path", "layer", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("path", "layer").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    numeric = entities.groupBy("path", "layer").agg(F.coalesce(F.max(F.expr("try_cast(text AS double) IS NOT NULL")), F.lit(False)).alias("numeric_text"))
    return counts.join(heights, ["path", "layer"], "left").join(numeric, ["path", "layer"]).withColumn("terrain", F.col("numeric_text") | (F.coalesce("share_z", F.lit(0.0)) > 0.5))


def point_cloud(entities: DataFrame, layers: list[str] | None = None, texts: bool = False) -> DataFrame:
    """Points of chosen layers; numeric texts may give heights."""
    rows = entities.filter(F.col("layer").isin(layers)) if layers else entities
    height = F.expr("try_cast(text AS double)")
    points = rows.filter("kind <> 'text'").select("path", "layer", F.explode("points").alias("p")).select("path", "layer", "p.x", "p.y", "p.z")
    if texts:
        points = points.union(rows.filter((F.col("kind") == "text") & height.isNotNull()).select("path", "layer", F.col("points")[0]["x"], F.col("points")[0]["y"], height))
    return points


def png_pixels(raw: bytes) -> np.ndarray:
    """(rows, cols, 3) of an eight-bit RGB or RGBA picture without interlacing."""
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in (2, 6) or interlace:
        raise ValueError("only eight-bit RGB(A) pictures without interlacing")
    step = 3 if colour == 2 else 4
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.int64)
    for r in range(height):
        line, up = rows[r, 1:].astype(np.int64), out[r - 1] if r else np.zeros(width * step, np.int64)
        kind = rows[r, 0]
        if kind == 0:
            out[r] = line
        elif kind == 2:
            out[r] = (line + up) & 255
        else:
            for i in range(width * step):
                a, b, c = out[r, i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[r, i] = (line[i] + {1: a, 3: (a + b) // 2, 4: near}[kind]) & 255
    return out.reshape(height, width, step)[:, :, :3]


def read_terrain_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Height tiles named .../zoom/x/y.png as (zoom, x, y, row, col, z); height = 256 R + G + B / 256 - 32768."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0), batch.column(1)):
                zoom, x, y = map(int, re.search(r"(\d+)/(\d+)/(\d+)\.png$", file.as_py()).groups())
                p = png_pixels(raw.as_py())
                z = p[:, :, 0] * 256.0 + p[:, :, 1] + p[:, :, 2] / 256.0 - 32768
                row, col = np.indices(z.shape)
                n = z.size
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, v, np.int32)) for v in (zoom, x, y)), pa.array(row.ravel().astype(np.int32)), pa.array(col.ravel().astype(np.int32)), pa.array(z.ravel())], ["zoom", "x", "y", "row", "col", "z"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, "zoom int, x int, y int, row int, col int, z double")


# --- sinks -----------------------------------------------------------------------------------------------


def geojson(kind: str, ring: Column, properties: Column) -> Column:
    """A feature as text: kind Point, LineString or Polygon over array<struct<lon,lat>>."""
    pairs = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), pairs).otherwise(F.concat(pairs, F.slice(pairs, 1, 1)))
    coordinates = {"Point": F.to_json(pairs[0]), "LineString": F.to_json(pairs), "Polygon": F.to_json(F.array(closed))}[kind]
    return F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":'), coordinates, F.lit('},"properties":'), F.to_json(properties), F.lit("}"))


def kml_placemark(name: Column, ring: Column) -> Column:
    text = F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p["lon"], p["lat"], F.lit(0))), " ")
    return F.concat(F.lit("<Placemark><name>"), F.regexp_replace(F.regexp_replace(name, "&", "&amp;"), "<", "&lt;"), F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), text, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))


def ascii_grid(cells: DataFrame, grid: str, cell: float, west: float = 0.0, south: float = 0.0, missing: float = -9999.0) -> DataFrame:
    """(grid, row, line): the lines of an ASCII grid, rows from north to south; the header has row -1."""
    rows = cells.groupBy(grid, "row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("z", F.lit(missing)).alias("z")))).alias("v"))
    body = rows.select(grid, "row", F.array_join(F.transform("v", lambda x: F.round(x["z"], 3).cast("string")), " ").alias("line"))
    head = cells.groupBy(grid).agg((F.max("col") + 1).alias("nc"), (F.max("row") + 1).alias("nr"))
    lines = F.concat_ws("\n", F.concat(F.lit("ncols "), "nc"), F.concat(F.lit("nrows "), "nr"), F.lit(f"xllcorner {west}"), F.lit(f"yllcorner {south}"), F.lit(f"cellsize {cell}"), F.lit(f"NODATA_value {missing}"))
    return head.select(grid, F.lit(-1).alias("row"), lines.alias("line")).union(body)
