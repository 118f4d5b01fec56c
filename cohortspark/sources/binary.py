"""Binary sources as tables: rasters with headers, PNG images, shapes with their attribute files.

Files come through ``spark.read.format("binaryFile")`` (``path, content``), so any store that Spark
reads will do; one file is decoded in one task and leaves as rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Type letters of header rasters.
RASTER_TYPES = {"u": "u1", "s": "<i2", "i": "<i4", "l": "<i8", "f": "<f4", "d": "<f8"}
_MAGIC, _HEAD = 7, struct.Struct("<cii6d")


def parse_raster(content: bytes) -> tuple[dict[str, float], np.ndarray]:
    """Header and pixels (rows from the first latitude) of a raster file.

    Seven bytes of magic, the last of which is the version (2: three names of eight bytes and a
    reserved double follow the numbers), a type letter, width, height, then step, least and
    largest longitude, and the same of latitude.
    """
    kind, w, h, dlon, lon0, lon1, dlat, lat0, lat1 = _HEAD.unpack_from(content, _MAGIC)
    at = _MAGIC + _HEAD.size + (32 if content[_MAGIC - 1 : _MAGIC] == b"2" else 0)
    values = np.frombuffer(content, RASTER_TYPES[kind.decode()], w * h, at).reshape(h, w)
    return {"width": w, "height": h, "lon_min": lon0, "lon_max": lon1, "dlon": dlon, "lat_min": lat0, "lat_max": lat1, "dlat": dlat}, values


def raster_bytes(values: np.ndarray, magic: bytes, kind: str, lon: tuple[float, float, float], lat: tuple[float, float, float], names: tuple[str, str, str] = ("Val", "Lon", "Lat")) -> bytes:
    """A raster file; ``lon`` and ``lat`` are (step, least, largest)."""
    h, w = values.shape
    tail = b"".join(n.encode()[:8].ljust(8, b"\0") for n in names) + bytes(8) if magic[-1:] == b"2" else b""
    return magic + _HEAD.pack(kind.encode(), w, h, *lon, *lat) + tail + np.ascontiguousarray(values, RASTER_TYPES[kind]).tobytes()


def parse_png(content: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit, not interlaced image; palettes are applied."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, palette = 8, [], None
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced:
                raise ValueError("only 8-bit images without interlacing are read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(w * channels, int)
        match raw[y, 0]:
            case 0:
                out[y] = line
            case 2:
                out[y] = line + up & 255
            case kind:
                now = np.zeros(w * channels + channels, int)
                corner = np.concatenate([np.zeros(channels, int), up])
                for i, value in enumerate(line):
                    a, b, c = now[i], up[i], corner[i]
                    if kind == 1:
                        guess = a
                    elif kind == 3:
                        guess = (a + b) // 2
                    else:
                        guess = min((a, b, c), key=lambda v, t=a + b - c: abs(t - v))
                    now[i + channels] = value + guess & 255
                out[y] = now[channels:]
    pixels = out.reshape(h, w, channels)
    return palette[pixels[:, :, 0]] if palette is not None and colour == 3 else pixels


def parse_shapes(content: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(record, part, points) of a shapefile's points, polylines and polygons; null shapes have none."""
    out, at = [], 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">ii", content, at)
        body = content[at + 8 : at + 8 + words * 2]
        (kind,) = struct.unpack_from("<i", body)
        if kind in (1, 11, 21):
            out.append((number, 0, np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)))
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n_points = struct.unpack_from("<ii", body, 36)
            starts = [*np.frombuffer(body, "<i4", n_parts, 44), n_points]
            points = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
            out += [(number, p, points[starts[p] : starts[p + 1]]) for p in range(n_parts)]
        at += 8 + words * 2
    return out


def parse_dbf(content: bytes) -> list[dict[str, str]]:
    """The records of an attribute file as texts; deleted ones are left out but keep their numbers free."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    out = []
    for r in range(n):
        record, place, row = content[head + r * size : head + (r + 1) * size], 1, {"record": str(r + 1)}
        for name, width in fields:
            row[name] = record[place : place + width].decode("latin-1").strip()
            place += width
        if record[:1] != b"*":
            out.append(row)
    return out


def _rows(files: DataFrame, decode: Callable[[bytes], Iterator[tuple]], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held: list[tuple] = []
                for row in decode(content.as_py()):
                    held.append((path.as_py(), *row))
                    if len(held) == 50_000:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [() for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def _raster_rows(content: bytes) -> Iterator[tuple]:
    _, values = parse_raster(content)
    for (y, x), v in np.ndenumerate(values):
        yield y, x, float(v)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """``path, y, x, v`` of header rasters."""
    files = spark.read.format("binaryFile").load(path)
    return _rows(files, _raster_rows, "path string, y int, x int, v double", ["path", "y", "x", "v"], [pa.string(), pa.int32(), pa.int32(), pa.float64()])


def read_images(spark: SparkSession, path: str, translation: dict[tuple[int, ...], float], default: float = float("nan")) -> DataFrame:
    """``path, y, x, v``: pixels of PNG images, their colours translated to values."""

    def decode(content: bytes) -> Iterator[tuple]:
        pixels = parse_png(content)
        for y in range(pixels.shape[0]):
            for x in range(pixels.shape[1]):
                yield y, x, float(translation.get(tuple(int(c) for c in pixels[y, x]), default))

    files = spark.read.format("binaryFile").load(path)
    return _rows(files, decode, "path string, y int, x int, v double", ["path", "y", "x", "v"], [pa.string(), pa.int32(), pa.int32(), pa.float64()])


def _shape_rows(content: bytes) -> Iterator[tuple]:
    for record, part, points in parse_shapes(content):
        for n, (lon, lat) in enumerate(points):
            yield int(record), part, n, float(lon), float(lat)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """``path, record, part, n, lon, lat`` of shapefiles."""
    files = spark.read.format("binaryFile").load(path)
    names, kinds = ["path", "record", "part", "n", "lon", "lat"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    return _rows(files, _shape_rows, "path string, record int, part int, n int, lon double, lat double", names, kinds)


def read_attributes(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``path, record, value``: one field of attribute files."""

    def decode(content: bytes) -> Iterator[tuple]:
        for row in parse_dbf(content):
            yield int(row["record"]), row[field]

    files = spark.read.format("binaryFile").load(path)
    return _rows(files, decode, "path string, record int, value string", ["path", "record", "value"], [pa.string(), pa.int32(), pa.string()])


def bin_table(rows: DataFrame, lon_min: float, dlon: float, lat_min: float, dlat: float) -> DataFrame:
    """``y, x`` of a table with ``lon, lat`` (tab or space separated climate tables): indices by truncation."""
    from pyspark.sql import functions as F

    return rows.withColumns({"y": F.floor((F.col("lat") - lat_min) / dlat).cast("int"), "x": F.floor((F.col("lon") - lon_min) / dlon).cast("int")})


def read_value_table(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """``lon, lat, v0, v1, ...`` of white-space separated lines; lines without two leading numbers are left out."""
    from pyspark.sql import functions as F

    parts = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    rows = spark.read.text(path).select(at(0).alias("lon"), at(1).alias("lat"), *(at(i + 2).alias(f"v{i}") for i in range(columns)))
    return rows.where("lon is not null and lat is not null")
