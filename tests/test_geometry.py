import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraprofile.functions import geometry as G

TEXTS = {
    "POINT (1 2)": "POINT (1 2)",
    "point(1.5 -2e3)": "POINT (1.5 -2000)",
    "POINT Z (1 2 3)": "POINT (1 2)",
    "POINT (.5 +1.)": "POINT (0.5 1)",
    "POINT EMPTY": "POINT EMPTY",
    "LINESTRING (0 0, 3 4, 3 10)": "LINESTRING (0 0, 3 4, 3 10)",
    "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1))": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))",
    "MULTIPOINT ((1 2), (3 4))": "MULTIPOINT ((1 2), (3 4))",
    "MULTIPOINT (1 2, 3 4)": "MULTIPOINT ((1 2), (3 4))",
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))": "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
    "not wkt": None,
    "POINT (1)": None,
    "POINT (1 2": None,
    "LINESTRING (0 0)": None,
    "POLYGON ((0 0, 1 1, 2 2))": None,
    "POLYGON ((0 0, 1 0, 1 1, 5 5))": None,
    "GEOMETRYCOLLECTION (POINT (1 2))": None,
}


def test_wkt_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "w string").withColumn("g", G.from_wkt(F.col("w")))
    got = {r["w"]: r["o"] for r in df.select("w", G.as_wkt(F.col("g")).alias("o")).collect()}
    assert got == TEXTS


def test_geojson_round_trip_and_closing(spark):
    good = [t for t, o in TEXTS.items() if o and "EMPTY" not in o]
    df = spark.createDataFrame([(t,) for t in good], "w string").withColumn("g", G.from_wkt(F.col("w")))
    again = df.select(G.as_wkt(F.col("g")).alias("a"), G.as_wkt(G.from_geojson(G.as_geojson(F.col("g")))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in again)
    open_ring = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}'
    bad = ["{broken", '{"type":"Point"}', '{"type":"Point","coordinates":["a",1]}', '{"type":"Circle","coordinates":[1,2]}', None]
    rows = spark.createDataFrame([(t,) for t in [open_ring, *bad]], "j string").select(G.as_wkt(G.from_geojson(F.col("j"))).alias("w")).collect()
    assert [r["w"] for r in rows] == ["POLYGON ((0 0, 1 0, 1 1, 0 0))", *[None] * 5]


def test_measures(spark):
    w = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"
    g = G.from_wkt(F.lit(w))
    r = spark.range(1).select(G.area(g).alias("a"), G.length(g).alias("l"), G.centroid(g).alias("c"), G.vertex_count(g).alias("n"), G.bbox(g).alias("b")).first()
    assert (r["a"], r["l"], r["n"], tuple(r["b"])) == (15.0, 20.0, 10, (0.0, 0.0, 4.0, 4.0))
    assert r["c"]["x"] == pytest.approx((16 * 2 - 1.5) / 15)


def test_latlon_text(spark):
    rows = spark.createDataFrame([("45.5, 3.25",), ("45.5",), ("a,b",), ("1,2,3",), (None,)], "t string")
    got = rows.select(G.as_wkt(G.from_latlon_text(F.col("t"))).alias("w")).collect()
    assert [r["w"] for r in got] == ["POINT (3.25 45.5)", None, None, None, None]


VALID = {
    "POINT (1 2)": True,
    "LINESTRING (0 0, 0 0)": False,
    "LINESTRING (0 0, 1 1, 0 1, 1 0)": True,
    "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))": False,
    "POLYGON ((0 0, 1 0, 2 0, 0 0))": False,
    "POLYGON ((0 0, 4 0, 4 4, 2 1, 0 4, 0 0))": True,
    "POLYGON ((0 0, 4 0, 4 4, 2 0, 0 4, 0 0))": False,
}


def test_validity(spark):
    df = spark.createDataFrame([(t,) for t in VALID], "w string").withColumn("g", G.from_wkt(F.col("w")))
    assert {r["w"]: r["v"] for r in df.select("w", G.is_valid(F.col("g")).alias("v")).collect()} == VALID


RELATED = {
    # holes: inside, touching the shell at a point, along it, outside, crossing, nested, side by side, equal
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))": True,
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (0 5, 2 4, 2 6, 0 5))": True,
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (0 4, 2 4, 2 6, 0 6, 0 4))": False,
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (20 1, 20 2, 22 2, 22 1, 20 1))": False,
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (8 1, 8 2, 12 2, 12 1, 8 1))": False,
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 8, 8 8, 8 1, 1 1), (2 2, 2 3, 3 3, 3 2, 2 2))": False,
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1), (2 2, 2 3, 3 3, 3 2, 2 2))": True,
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1), (1 1, 1 2, 2 2, 2 1, 1 1))": False,
    # all vertices of the hole on a notched shell, one edge outside it
    "POLYGON ((0 0, 9 0, 9 9, 5 5, 0 9, 0 0), (9 9, 5 5, 0 9, 9 9))": False,
    # a spike, and a straight vertex
    "POLYGON ((0 0, 9 0, 9 9, 9 0, 0 9, 0 0))": False,
    "POLYGON ((0 0, 5 0, 9 0, 9 9, 0 9, 0 0))": True,
    "POLYGON ((0 0, 0 0, 9 0, 9 9, 0 9, 0 0))": True,
    # parts: apart, at a corner, along an edge, overlapping, one in the other, one in the other's hole, equal
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))": True,
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 1, 2 1, 2 2, 1 2, 1 1)))": True,
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 0, 2 0, 2 1, 1 1, 1 0)))": False,
    "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((1 1, 3 1, 3 3, 1 3, 1 1)))": False,
    "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0)), ((1 1, 2 1, 2 2, 1 2, 1 1)))": False,
    "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 8, 8 8, 8 1, 1 1)), ((2 2, 3 2, 3 3, 2 3, 2 2)))": True,
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((0 0, 1 0, 1 1, 0 1, 0 0)))": False,
    "MULTIPOLYGON (((2 2, 3 2, 3 3, 2 3, 2 2)), ((0 0, 9 0, 9 9, 0 9, 0 0)))": False,
}


def test_validity_of_rings_and_parts(spark):
    df = spark.createDataFrame([(t,) for t in RELATED], "w string")
    assert {r["w"]: r["v"] for r in df.select("w", G.is_valid(G.from_wkt(F.col("w"))).alias("v")).collect()} == RELATED


def test_validity_in_a_condition_over_the_parser(spark):
    df = spark.createDataFrame([(t,) for t in [*VALID, "nonsense"]], "w string")
    kept = {r["w"] for r in df.where(G.is_valid(G.from_wkt(F.col("w")))).collect()}
    assert kept == {w for w, v in VALID.items() if v}


def test_rings_against_all_pairs(spark):
    def clash(ring, i, j):
        (p, q), (r, s), m = ring[i : i + 2], ring[j : j + 2], len(ring) - 1
        side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        over = [min(max(p[k], q[k]), max(r[k], s[k])) - max(min(p[k], q[k]), min(r[k], s[k])) for k in (0, 1)]
        contact = min(over) >= 0 and side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0
        if j - i in (1, m - 1):
            return contact and side(p, q, r) == 0 and side(p, q, s) == 0 and max(over) > 0
        return contact

    rng = np.random.default_rng(1)
    expected = {}
    for _ in range(400):
        pts = rng.integers(0, 12, (int(rng.integers(4, 9)), 2))
        ring = [tuple(map(int, p)) for k, p in enumerate(pts) if k == 0 or tuple(p) != tuple(pts[k - 1])]
        ring = ring[:-1] if ring[-1] == ring[0] else ring
        if len(ring) < 3:
            continue
        ring.append(ring[0])
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
        m = len(ring) - 1
        valid = area != 0 and not any(clash(ring, i, j) for i in range(m) for j in range(i + 1, m))
        expected["POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring) + "))"] = valid
    df = spark.createDataFrame([(t,) for t in expected], "w string")
    assert {r["w"]: r["v"] for r in df.select("w", G.is_valid(G.from_wkt(F.col("w"))).alias("v")).collect()} == expected
    assert len(set(expected.values())) == 2


def test_validity_of_a_long_ring(spark):
    n = 20_000
    ring = [f"{np.cos(2 * np.pi * k / n):.9f} {np.sin(2 * np.pi * k / n):.9f}" for k in range(n)]
    texts = {"round": ring, "knot": [*ring[:100], "0.5 0.5", "-0.9 -0.9", *ring[100:]]}
    df = spark.createDataFrame([(k, f"POLYGON (({', '.join(r)}, {r[0]}))") for k, r in texts.items()], "k string, w string")
    assert {r["k"]: r["v"] for r in df.select("k", G.is_valid(G.from_wkt(F.col("w"))).alias("v")).collect()} == {"round": True, "knot": False}


def _clip_area(poly, rect):
    """Independent: area by fine sampling of the rectangle."""
    (x0, y0, x1, y1), n = rect, 400
    xs, ys = np.meshgrid(x0 + (np.arange(n) + 0.5) * (x1 - x0) / n, y0 + (np.arange(n) + 0.5) * (y1 - y0) / n)
    inside = np.zeros(xs.shape, bool)
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
        hit = (ay <= ys) != (by <= ys)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= hit & (ax + (ys - ay) * (bx - ax) / (by - ay) > xs)
    return inside.mean() * (x1 - x0) * (y1 - y0)


def test_clip_to_rectangle(spark):
    star = [(0, 0), (5, 2), (9, 0), (7, 5), (9, 9), (5, 7), (0, 9), (2, 5)]
    wkt = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*star, star[0]]) + "))"
    rects = [(1, 1, 6, 6), (-5, -5, 20, 20), (3, 3, 4, 4), (20, 20, 21, 21), (0, 0, 9, 1)]
    for r in rects:
        got = spark.range(1).select(G.clipped_area(G.from_wkt(F.lit(wkt)), G.rectangle_edges(*[F.lit(float(v)) for v in r])).alias("a")).first()["a"]
        assert got == pytest.approx(_clip_area(star, r), rel=0.02, abs=0.02)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-1000, 1000), st.integers(-1000, 1000)), min_size=2, max_size=6))
def test_line_text_survives(spark, pts):
    text = "LINESTRING (" + ", ".join(f"{x / 8} {y / 8}" for x, y in pts) + ")"
    r = spark.range(1).select(G.vertices(G.from_wkt(F.lit(text))).alias("v")).first()
    assert [(p["x"], p["y"]) for p in r["v"]] == [(x / 8, y / 8) for x, y in pts]


def test_wkt_of_any_length(spark):
    ring = ", ".join(f"{i} {i % 7}" for i in range(50_000))
    texts = [f"POLYGON (({ring}, 0 0))", "POLYGON ((0 0, 1-2 3, 0 0))", "POINT (1 2)", "POINT (1E 2)", "POINT (E)"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    found = {r.i: r.n for r in rows.select("i", G.vertex_count(G.from_wkt(F.col("t"))).alias("n")).collect()}
    assert found[0] >= 50_000 and found[1] is None and found[2] == 1 and found[3] is None and found[4] is None
