"""Polygons in zipped binary shape files: several rings and holes, read by Spark from whatever store the archives are in.

An archive is one row (``path``, ``content``), as Spark's binary files are; each
is unpacked in the task that reads it, as the format has no smaller unit.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the published format: file code, version, polygon type, record header.
FILE_CODE, VERSION, POLYGON, HEAD = 9994, 1000, 5, 100
RING = "array<struct<x: double, y: double>>"
SCHEMA = f"path string, record int, id string, rings array<{RING}>"


def polygon_records(content: bytes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Number and rings (arrays of points) of the polygons of a .shp file; other shapes have no rings.  A file that breaks off raises."""
    if struct.unpack(">i", content[:4])[0] != FILE_CODE:
        raise ValueError("not a shape file")
    at = HEAD
    while at < len(content):
        number, words = struct.unpack(">2i", content[at:at + 8])
        body = content[at + 8:at + 8 + 2 * words]
        if len(body) < 2 * words:
            raise ValueError(f"record {number} breaks off")
        at += 8 + 2 * words
        rings: list[np.ndarray] = []
        if struct.unpack("<i", body[:4])[0] % 10 == POLYGON:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44:44 + 4 * parts]), points]
            xy = np.frombuffer(body, dtype="<f8", count=2 * points, offset=44 + 4 * parts).reshape(-1, 2)
            rings = [xy[a:b] for a, b in zip(starts, starts[1:])]
        yield number, rings


def table_values(content: bytes, field: str) -> list[str | None]:
    """The values of one field of a .dbf file, by record; empty and deleted ones are null, a missing field raises."""
    count, head, width = struct.unpack("<ihh", content[4:12])
    at, names = 1, {}
    for k in range(32, head - 1, 32):
        name = content[k:k + 11].split(b"\0")[0].decode("latin-1").lower()
        names[name] = (at, content[k + 16])
        at += content[k + 16]
    begin, size = names[field.lower()]
    rows = (content[head + i * width:head + (i + 1) * width] for i in range(count))
    return [None if r[:1] == b"*" else r[begin:begin + size].decode("utf-8", "replace").strip() or None for r in rows]


def pack_shapes(rows: list[tuple[str, list[list[tuple[float, float]]]]], field: str = "id", width: int = 20) -> bytes:
    """A zip archive with the .shp and .dbf files of polygons (id, rings)."""
    body = b""
    for k, (_, rings) in enumerate(rows, 1):
        points = [p for ring in rings for p in ring]
        xs, ys = zip(*points) if points else ((0.0,), (0.0,))
        starts = np.cumsum([0, *map(len, rings)])[:-1].tolist()
        shape = struct.pack("<i4d2i", POLYGON, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", k, len(shape) // 2) + shape
    head = struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, (HEAD + len(body)) // 2) + struct.pack("<2i8d", VERSION, POLYGON, *[0.0] * 8)
    fields = struct.pack("<11sc4xBB14x", field.encode(), b"C", width, 0) + b"\r"
    table = struct.pack("<B3xihh20x", 3, len(rows), 32 + len(fields), 1 + width) + fields + b"".join(b" " + str(i).encode()[:width].ljust(width) for i, _ in rows) + b"\x1a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("area/shapes.shp", head + body)
        z.writestr("area/shapes.dbf", table)
    return out.getvalue()


def archives(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """``path`` and ``content`` of the archives of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def shapes(packed: DataFrame, field: str = "id") -> DataFrame:
    """``path``, ``record``, ``id`` (a field of the table beside it; null without one) and ``rings`` of every polygon; null contents and other shapes give none."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if content is None:
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".shp")):
                        beside = name[:-4] + ".dbf"
                        ids = table_values(z.read(beside), field) if beside in z.namelist() else []
                        found = [(path, k, ids[k - 1] if k <= len(ids) else None, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in polygon_records(z.read(name)) if rings]
                        for i in range(0, len(found), 1000):
                            yield pd.DataFrame(found[i:i + 1000], columns=["path", "record", "id", "rings"])

    return packed.select("path", "content").mapInPandas(read, SCHEMA)


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings: a point in a hole is outside, one on an island within the hole inside."""
    from ..operators.joins import in_polygon

    inside = F.transform(rings, lambda r: in_polygon(x, y, r).cast("int"))
    return F.aggregate(inside, F.lit(0), lambda a, b: a + b) % 2 == 1


def rings_join(points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str, tile: float) -> DataFrame:
    """Points with the polygons (several rings) that hold them: polygons are dealt into the tiles of their bounding box, points into one tile."""
    def ends(c: str, least: bool) -> Column:
        values = F.transform(F.flatten(F.col(rings)), lambda p: p[c])
        return F.floor((F.array_min(values) if least else F.array_max(values)) / tile).cast("int")

    tiles = polygons.withColumn("_tx", F.explode(F.sequence(ends("x", True), ends("x", False)))).withColumn("_ty", F.explode(F.sequence(ends("y", True), ends("y", False))))
    at = points.withColumn("_tx", F.floor(F.col(x) / tile).cast("int")).withColumn("_ty", F.floor(F.col(y) / tile).cast("int"))
    return at.join(tiles, ["_tx", "_ty"]).filter(in_rings(F.col(x), F.col(y), F.col(rings))).drop("_tx", "_ty")
