"""ESRI shapefiles as a Spark data source: geometry from .shp, attributes from .dbf, decoded by record ranges.

The .shx index gives each record's place, so a task reads only its own range of both files. Files are
opened through Arrow's file systems, so a path is a URI that the executors reach.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Kinds of shapes (fixed values of the format): plain, with Z, with M.
POINTS, LINES, POLYGONS, MULTIPOINTS = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)
RECORDS = 50_000


def opened(uri: str):
    # Hadoop writes local files with one slash
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
    return fs.open_input_file(path)


def sibling(uri: str, suffix: str) -> str:
    stem, old = uri.rsplit(".", 1)
    return f"{stem}.{suffix.upper() if old.isupper() else suffix}"


def dbf_fields(data: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, header length, record length, [(name, kind, length, decimals)])."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return n, head, size, fields


def dbf_value(raw: bytes, kind: str, decimals: int, encoding: str):
    text = raw.decode(encoding, "replace").strip().strip("\0")
    if kind in "NF":
        if not text or set(text) <= {"*"}:
            return None
        return float(text) if decimals or kind == "F" else int(float(text))
    if kind == "L":
        return True if text in "YyTt" and text else False if text in "NnFf" and text else None
    return text or None


def spark_type(kind: str, decimals: int):
    if kind in "NF":
        return DoubleType() if decimals or kind == "F" else LongType()
    return BooleanType() if kind == "L" else StringType()


def turn(ring: np.ndarray) -> float:
    """Positive counter-clockwise."""
    r = ring - ring[0]
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())


def rings_of(data: bytes) -> list[np.ndarray]:
    parts, points = struct.unpack_from("<ii", data, 36)
    first = np.frombuffer(data, "<i4", parts, 44)
    xy = np.frombuffer(data, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return [r for r in np.split(xy, first[1:]) if len(r)]


def polygons_of(rings: list[np.ndarray]) -> list[list[list[dict]]]:
    """Shells turn clockwise in the format and begin a polygon each; a hole goes to the shell that holds its first vertex, else to the last."""
    from furrow.operators.filters import inside_polygon

    shells, out = [r for r in rings if turn(r) <= 0], []
    for s in shells:
        out.append([s])
    for h in (r for r in rings if turn(r) > 0):
        at = next((i for i, s in enumerate(shells) if inside_polygon(h[:1], [s])[0]), None)
        if at is None and not out:
            out.append([h])
        else:
            out[len(out) - 1 if at is None else at].append(h)
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in out]


def shape_of(data: bytes) -> tuple[str, tuple[float, float] | list | None]:
    kind = struct.unpack_from("<i", data, 0)[0]
    if kind in POINTS:
        return "point", struct.unpack_from("<dd", data, 4)
    if kind in MULTIPOINTS:
        n = struct.unpack_from("<i", data, 36)[0]
        xy = np.frombuffer(data, "<f8", 2 * n, 40).reshape(-1, 2)
        return "point", tuple(xy.mean(0)) if n else None
    if kind in POLYGONS:
        return "polygon", polygons_of(rings_of(data))
    if kind in LINES:
        return "polygon", [[[{"x": float(x), "y": float(y)} for x, y in r]] for r in rings_of(data)]
    return "null", None


class Records(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.encoding, self.columns = options.get("encoding", "utf-8"), options.get("columns")

    def partitions(self) -> list[InputPartition]:
        with opened(sibling(self.path, "shx")) as f:
            n = (f.size() - 100) // 8
        return [Records(a, min(a + RECORDS, n)) for a in range(0, n, RECORDS)] or [Records(0, 0)]

    def read(self, part: Records) -> Iterator[tuple]:
        if part.last <= part.first:
            return
        with opened(sibling(self.path, "shx")) as f:
            places = np.frombuffer(f.read_at(8 * (part.last - part.first), 100 + 8 * part.first), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with opened(sibling(self.path, "dbf")) as f:
            _, head, size, fields = dbf_fields(f.read_at(min(f.size(), 65536), 0))
            rows = f.read_at(size * (part.last - part.first), head + size * part.first)
        with opened(self.path) as f:
            begin = int(places[0, 0])
            shapes = f.read_at(int(places[-1, 0] + places[-1, 1] + 8) - begin, begin)
        names = self.schema.names
        for i, (at, length) in enumerate(places):
            kind, shape = shape_of(shapes[at - begin + 8 : at - begin + 8 + length])
            row = {"rid": part.first + i}
            if "geometry" in names:
                row["geometry"] = shape if kind == "polygon" else None
            else:
                row["x"], row["y"] = shape if kind == "point" and shape else (None, None)
            pos = i * size + 1
            for name, k, width, decimals in fields:
                if name in names:
                    row[name] = dbf_value(rows[pos : pos + width], k, decimals, self.encoding)
                pos += width
            yield tuple(row.get(n) for n in names)


class Shapefile(DataSource):
    """format("shapefile"): points as x and y, polygons and lines as geometry, rid, and the attributes (option columns: a comma-separated choice)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as f:
            kind = struct.unpack("<i", f.read_at(4, 32))[0]
        with opened(sibling(self.options["path"], "dbf")) as f:
            fields = dbf_fields(f.read_at(min(f.size(), 65536), 0))[3]
        chosen = self.options.get("columns")
        if chosen is not None:
            fields = [f for f in fields if f[0] in chosen.split(",")]
        vertex = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
        place = vertex.fields if kind in (*POINTS, *MULTIPOINTS) else [StructField("geometry", ArrayType(ArrayType(ArrayType(vertex))))]
        return StructType([StructField("rid", LongType()), *place, *(StructField(n, spark_type(k, d)) for n, k, _, d in fields)])

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(schema, dict(self.options))


def read_shapefile(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").options(**options).load(path)
