"""Well-known binary to and from geometry columns, a batch of rows at a time."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The codes of the kinds, and the flags of the extended form.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}
HAS_Z, HAS_M, HAS_CODE = 0x80000000, 0x40000000, 0x20000000

_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(_XY))))])


class Unreadable(Exception):
    """Bytes that are no well-formed geometry of a known kind."""


def _header(data: bytes, at: int) -> tuple[str, str, int, int]:
    """Byte order, kind, numbers per coordinate, and where the body begins."""
    if len(data) < at + 5 or data[at] > 1:
        raise Unreadable
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 9 if code & HAS_CODE else 5
    plain = code & 0x0FFFFFFF
    form, kind = divmod(plain, 1000)
    z, m = bool(code & HAS_Z) or form in (1, 3), bool(code & HAS_M) or form in (2, 3)
    if kind not in KINDS or form > 3:
        raise Unreadable
    return order, KINDS[kind], 2 + z + m, at


def _count(data: bytes, at: int, order: str) -> tuple[int, int]:
    if len(data) < at + 4:
        raise Unreadable
    return struct.unpack_from(order + "I", data, at)[0], at + 4


def _points(data: bytes, at: int, order: str, size: int, n: int) -> tuple[np.ndarray, int]:
    end = at + 8 * size * n
    if end > len(data):
        raise Unreadable
    return np.frombuffer(data, order + "f8", size * n, at).reshape(n, size)[:, :2].astype(float), end


def _read(data: bytes, at: int = 0) -> tuple[str, list[list[np.ndarray]], int]:
    """Kind, parts and end of the geometry at a place; rings closed, lines of two points or more."""
    order, kind, size, at = _header(data, at)
    if kind == "POINT":
        xy, at = _points(data, at, order, size, 1)
        return kind, [] if np.isnan(xy).all() else [[xy]], at
    n, at = _count(data, at, order)
    if kind == "LINESTRING":
        xy, at = _points(data, at, order, size, n)
        if n == 1:
            raise Unreadable
        return kind, [[xy]] if n else [], at
    if kind == "POLYGON":
        rings = []
        for _ in range(n):
            m, at = _count(data, at, order)
            xy, at = _points(data, at, order, size, m)
            if m < 4 or (xy[0] != xy[-1]).any():
                raise Unreadable
            rings.append(xy)
        return kind, [rings] if rings else [], at
    parts = []
    for _ in range(n):
        member, own, at = _read(data, at)
        if member != kind.removeprefix("MULTI"):
            raise Unreadable
        parts += own
    return kind, parts, at


def decoded(values: pa.Array) -> pa.StructArray:
    """Geometry structs of a binary array; null where the bytes can't be read."""
    kinds, parts, rings, points, xy = [], [0], [0], [0], []
    for value in values:
        data, found = value.as_py(), None
        if data is not None:
            try:
                kind, found, end = _read(data)
                found = found if end == len(data) else None
            except (Unreadable, RecursionError):
                found = None
        kinds.append(kind if found is not None else None)
        for part in found or []:
            for ring in part:
                xy.append(ring)
                points.append(points[-1] + len(ring))
            rings.append(rings[-1] + len(part))
        parts.append(parts[-1] + len(found or []))
    flat = np.concatenate(xy) if xy else np.empty((0, 2))
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    nested = pairs
    for offsets in (points, rings, parts):
        nested = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nested)
    kind = pa.array(kinds, pa.string())
    return pa.StructArray.from_arrays([kind, nested], ["kind", "parts"], mask=kind.is_null())


def _written(kind: str, parts: list) -> bytes:
    line = lambda pts: struct.pack("<I", len(pts)) + np.array([(p["x"], p["y"]) for p in pts], "<f8").tobytes()
    code = next(c for c, k in KINDS.items() if k == kind)
    head = struct.pack("<BI", 1, code)
    if kind == "POINT":
        p = parts[0][0][0] if parts else {"x": np.nan, "y": np.nan}
        return head + struct.pack("<dd", p["x"], p["y"])
    if kind == "LINESTRING":
        return head + (line(parts[0][0]) if parts else struct.pack("<I", 0))
    if kind == "POLYGON":
        rings = parts[0] if parts else []
        return head + struct.pack("<I", len(rings)) + b"".join(map(line, rings))
    return head + struct.pack("<I", len(parts)) + b"".join(_written(kind.removeprefix("MULTI"), [part]) for part in parts)


def _added(df: DataFrame, value: Column, name: str, kind: T.DataType, convert: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with a column made from ``value`` batch by batch; a column of that name is replaced."""
    kept = df.drop(name)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], convert(batch.columns[-1])], names=[*batch.schema.names[:-1], name])

    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])
    return df.select(*[F.col(f"`{c}`") for c in kept.columns], value.alias("_value")).mapInArrow(run, schema)


def add_from_wkb(df: DataFrame, value: Column, name: str) -> DataFrame:
    """A geometry column from binary of either byte order, with Z, M and code or without; unreadable bytes are NULL."""
    return _added(df, value, name, GEOMETRY_TYPE, decoded)


def add_as_wkb(df: DataFrame, geometry: Column, name: str) -> DataFrame:
    """A column of little-endian binary from geometry."""
    encode = lambda v: pa.array([None if x is None else _written(x["kind"], x["parts"]) for x in v.to_pylist()], pa.binary())
    return _added(df, geometry, name, T.BinaryType(), encode)


def code_of(value: Column) -> Column:
    """The EPSG code inside extended binary, or NULL."""
    text = F.hex(F.substring(value, 1, 9))
    little = F.substring(text, 1, 2) == "01"
    number = lambda at: F.conv(F.when(little, F.concat(*[F.substring(text, at + 2 * k, 2) for k in (3, 2, 1, 0)])).otherwise(F.substring(text, at, 8)), 16, 10).cast("bigint")
    return F.when(number(3).bitwiseAND(F.lit(HAS_CODE)) != 0, number(11)).cast("int")
