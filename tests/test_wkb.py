"""Binary geometry of every form against its text."""

import struct

import pytest
from pyspark.sql import functions as F

from terraprofile.functions import geometry as G
from terraprofile.functions import wkb
from terraprofile.plans.dataset_profile import dataset_profile

TEXTS = [
    "POINT (1.5 -2)", "LINESTRING (0 0, 1 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 1, 2 0.5, 1 0.5))", "MULTIPOINT ((1 2), (3 4))",
    "MULTILINESTRING ((0 0, 1 1), (5 5, 6 6, 7 5))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POLYGON EMPTY", "POINT EMPTY",
]


def decode(spark, rows):
    df = spark.createDataFrame([(bytearray(r) if r is not None else None,) for r in rows], "b binary")
    return [r.w for r in wkb.add_from_wkb(df, F.col("b"), "g").select(G.as_wkt(F.col("g")).alias("w")).collect()]


def test_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    back = wkb.add_from_wkb(wkb.add_as_wkb(df, G.from_wkt(F.col("t")), "b"), F.col("b"), "g")
    rows = back.select("t", G.as_wkt(F.col("g")).alias("w")).collect()
    assert [(r.t, r.w) for r in rows] == [(t, t) for t in TEXTS]


def test_orders_dimensions_and_codes(spark):
    forms = []
    for order, byte in (("<", 1), (">", 0)):
        for code, extra in ((1, []), (1001, [9]), (2001, [9]), (3001, [9, 8]), (1 | wkb.HAS_Z, [9]), (1 | wkb.HAS_Z | wkb.HAS_M, [9, 8])):
            forms.append(struct.pack(f"{order}BI", byte, code) + struct.pack(f"{order}{2 + len(extra)}d", 3, 4, *extra))
        forms.append(struct.pack(f"{order}BII", byte, 1 | wkb.HAS_CODE, 2154) + struct.pack(f"{order}dd", 3, 4))
    assert decode(spark, forms) == ["POINT (3 4)"] * len(forms)
    df = spark.createDataFrame([(bytearray(f),) for f in forms], "b binary")
    assert [r.c for r in df.select(wkb.code_of(F.col("b")).alias("c")).collect()] == ([None] * 6 + [2154]) * 2
    # a big-endian member inside a little-endian collection
    member = struct.pack(">BI", 0, 1) + struct.pack(">dd", 1, 2)
    assert decode(spark, [struct.pack("<BII", 1, 4, 1) + member]) == ["MULTIPOINT ((1 2))"]


def test_unreadable_bytes_are_null(spark):
    point = struct.pack("<BIdd", 1, 1, 1, 2)
    bad = [None, b"", b"\x01", point[:-1], point + b"x", b"\x02" + point[1:], struct.pack("<BI", 1, 7) + b"\0" * 4, struct.pack("<BII", 1, 2, 1 << 30),
           struct.pack("<BIII", 1, 3, 1, 3) + b"\0" * 48, struct.pack("<BII", 1, 4, 1) + struct.pack("<BII", 1, 2, 0)]
    assert decode(spark, bad) == [None] * len(bad)


@pytest.mark.parametrize("name, build", [("the_geom", lambda b, g: G.as_wkt(g)), ("WKB_Geometry", lambda b, g: b), ("geom", lambda b, g: F.hex(b)), ("shape", lambda b, g: G.as_geojson(g))])
def test_profiles_measure_native_columns(spark, name, build):
    points = spark.range(20).select("id", G.point(F.col("id") % 5, 43 + F.col("id") % 3).alias("p"))
    df = wkb.add_as_wkb(points, F.col("p"), "b").select("id", build(F.col("b"), F.col("p")).alias(name))
    row = dataset_profile(df, "x").first()
    assert row["Types de géométrie"] == "Point" and row["CRS"] == "EPSG:4326" and row["Score de complétude géographique"][0] == 100.0
