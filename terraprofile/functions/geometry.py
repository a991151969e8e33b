"""Geometry as ordinary columns.

A geometry is ``struct<kind, parts>`` where ``parts`` is a list of parts, a
part a list of rings or lines, and those are lists of ``(x, y)``. A point is a
part with one single-coordinate line. Everything here is a column expression.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XY = "struct<x:double,y:double>"
PARTS = f"array<array<array<{XY}>>>"
GEOMETRY = f"struct<kind:string,parts:{PARTS}>"
_NESTED = "array<array<array<array<double>>>>"

# Geometry kinds and the bracket depth of their coordinates.
KIND_DEPTH = {
    "POINT": 1,
    "LINESTRING": 2,
    "POLYGON": 3,
    "MULTIPOINT": 2,
    "MULTILINESTRING": 3,
    "MULTIPOLYGON": 4,
}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def is_geometry(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and dtype.fieldNames() == ["kind", "parts"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Catalyst inlines a column that is defined in one projection and used in
    the next; accessors bind their argument this way, so that a parsed geometry
    is not parsed again at each mention.
    """
    return F.transform(F.array(value), body)[0]


def computed(geometry: Column) -> Column:
    """A geometry column, to be selected alone, that is computed before anything above it.

    Filters and several accessors in one projection mention a column's expression again each;
    what a generator gives is never inlined.
    """
    return F.explode(F.array(geometry))


def _bound(accessor: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An accessor that evaluates its geometry once."""

    @functools.wraps(accessor)
    def on(g: Column) -> Column:
        return let(g, accessor)

    return on


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _geometry(kind: Column, parts: Column) -> Column:
    return F.struct(kind.alias("kind"), parts.cast(PARTS).alias("parts"))


# ---------------------------------------------------------------- construction

def point(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, _geometry(F.lit("POINT"), F.array(F.array(F.array(xy(x, y))))))


def polygon(ring: Column) -> Column:
    """A polygon without holes from a closed vertex list."""
    return F.when(ring.isNotNull(), _geometry(F.lit("POLYGON"), F.array(F.array(ring))))


def line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    present = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(present, _geometry(F.lit("LINESTRING"), F.array(F.array(F.array(xy(x1, y1), xy(x2, y2))))))


def from_latlon_text(text: Column) -> Column:
    """``"lat,lon"`` to a point; other shapes or bad numbers give NULL."""
    bits = F.split(text, ",")
    number = lambda i: F.trim(F.get(bits, F.lit(i))).try_cast("double")
    return F.when(F.size(bits) == 2, point(number(1), number(0)))


def _lift(kind: Column, coords: Column) -> Column:
    """JSON text of a kind's coordinates, lifted to the common four levels."""
    four = kind.isin("MULTIPOLYGON")
    three = kind.isin("POLYGON")
    lines = kind.isin("MULTILINESTRING")
    points = kind.isin("MULTIPOINT")
    return (
        F.when(four, coords)
        .when(three | lines, F.concat(F.lit("["), coords, F.lit("]")))
        .when(points | (kind == "LINESTRING"), F.concat(F.lit("[["), coords, F.lit("]]")))
        .when(kind == "POINT", F.concat(F.lit("[[["), coords, F.lit("]]]")))
    )


def _build(kind: Column, json_text: Column, close_rings: bool) -> Column:
    """Parse lifted JSON and apply the structural rules of the kind."""

    def shaped(raw: Column) -> Column:
        coords_ok = F.forall(F.flatten(F.flatten(raw)), lambda c: (F.size(c) >= 2) & c[0].isNotNull() & c[1].isNotNull())
        points = F.transform(
            raw,
            lambda part: F.transform(
                part, lambda ring: F.transform(ring, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
            ),
        )
        # a multi-line or multi-point arrives as one part; give each member its own
        split_lines = F.transform(points[0], lambda ln: F.array(ln))
        split_points = F.transform(points[0][0], lambda p: F.array(F.array(p)))
        parts = (
            F.when(kind == "MULTILINESTRING", split_lines)
            .when(kind == "MULTIPOINT", split_points)
            .otherwise(points)
        )

        def closed(ring: Column) -> Column:
            head, tail = ring[0], F.element_at(ring, -1)
            return F.when(head == tail, ring).otherwise(F.concat(ring, F.array(head)))

        polygonal = kind.isin("POLYGON", "MULTIPOLYGON")
        linear = kind.isin("LINESTRING", "MULTILINESTRING")

        def checked(ps: Column) -> Column:
            if close_rings:
                ps = F.when(
                    polygonal,
                    F.transform(ps, lambda part: F.transform(part, lambda r: F.when(F.size(r) >= 3, closed(r)).otherwise(r))),
                ).otherwise(ps)
            rings_ok = F.forall(
                F.flatten(ps), lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1))
            )
            lines_ok = F.forall(F.flatten(ps), lambda r: F.size(r) >= 2)
            ok = F.when(polygonal, rings_ok).when(linear, lines_ok).otherwise(F.lit(True))
            return F.when(ok, ps)

        return F.when(coords_ok, let(parts, checked))

    parts = let(F.from_json(json_text, _NESTED), shaped)
    return let(parts, lambda p: F.when(p.isNotNull(), _geometry(kind, p)))


def from_wkt(text: Column) -> Column:
    """WKT to geometry; text that is not well-formed WKT gives NULL.

    Parentheses and coordinates are rewritten to JSON brackets, which the
    built-in JSON parser then reads. Z and M values are dropped.
    """
    head = r"^\s*(MULTI)?(POINT|LINESTRING|POLYGON)(\s+(Z|M|ZM))?\s*"

    def parse(up: Column) -> Column:
        kind = F.regexp_extract(up, r"^\s*((?:MULTI)?(?:POINT|LINESTRING|POLYGON))", 1)
        # one class of characters, so shapes of any length match without recursion; the JSON parser judges the rest
        whole = up.rlike(head + r"\([\s(),0-9.E+-]*\)\s*$")
        empty = up.rlike(head + r"EMPTY\s*$")
        return let(
            F.struct(kind.alias("kind"), F.regexp_replace(up, head, "").alias("body")),
            lambda t: F.when(whole, rewritten(t["kind"], t["body"])).when(empty, _geometry(t["kind"], F.array().cast(PARTS))),
        )

    def rewritten(kind: Column, body: Column) -> Column:
        # MULTIPOINT ((1 2), (3 4)) is the same as MULTIPOINT (1 2, 3 4)
        bare = F.regexp_replace(body, rf"\(\s*({NUMBER}[^(),]*)\)(?=\s*[,)])", "$1")
        pairs = F.regexp_replace(
            F.when(kind == "MULTIPOINT", bare).otherwise(body), rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*", "[$1,$2]"
        )
        # JSON numbers may not start with '+' or '.', or end with '.'
        json_text = F.regexp_replace(F.translate(pairs, "()", "[]"), r"(?<=[\[,\s])\+", "")
        json_text = F.regexp_replace(json_text, r"(?<=[\[,\s-])\.(?=\d)", "0.")
        json_text = F.regexp_replace(json_text, r"(?<=\d)\.(?!\d)", "")
        # a point's own parentheses already give one extra level
        lifted = let(
            json_text, lambda j: F.when(kind == "POINT", F.concat(F.lit("[["), j, F.lit("]]"))).otherwise(_lift(kind, j))
        )
        return _build(kind, lifted, close_rings=False)

    return let(F.upper(text), parse)


def from_geojson(text: Column) -> Column:
    """A GeoJSON geometry object (as text) to geometry; errors give NULL."""
    return from_geojson_value(F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates"))


def from_geojson_value(kind: Column, coordinates: Column) -> Column:
    """Geometry from a ``type`` and the JSON text of its ``coordinates``."""

    def parse(t: Column) -> Column:
        known = t["kind"].isin(*KIND_DEPTH) & t["json"].isNotNull()
        return F.when(known, _build(t["kind"], _lift(t["kind"], t["json"]), close_rings=True))

    return let(F.struct(F.upper(kind).alias("kind"), coordinates.alias("json")), parse)


# -------------------------------------------------------------------- accessors

def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def is_empty(g: Column) -> Column:
    return F.size(vertices(g)) == 0


@_bound
def present(g: Column) -> Column:
    """Neither NULL nor empty."""
    return g.isNotNull() & (F.size(vertices(g)) > 0)


@_bound
def vertex_count(g: Column) -> Column:
    return F.when(g.isNotNull(), F.size(vertices(g)).cast("bigint"))


def number_text(v: Column) -> Column:
    """Shortest text of a double, without a trailing ``.0``."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, F.when(whole, v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def _coords_text(pts: Column, pair: Callable[[Column], Column], sep: str) -> Column:
    return F.array_join(F.transform(pts, pair), sep)


@_bound
def as_wkt(g: Column) -> Column:
    pair = lambda p: F.concat(number_text(p["x"]), F.lit(" "), number_text(p["y"]))
    wrap = lambda c: F.concat(F.lit("("), c, F.lit(")"))
    ring = lambda r: wrap(_coords_text(r, pair, ", "))
    poly = lambda part: wrap(F.array_join(F.transform(part, ring), ", "))
    parts, kind = g["parts"], g["kind"]
    flat = wrap(_coords_text(vertices(g), pair, ", "))
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), flat)
        .when(kind == "POLYGON", poly(parts[0]))
        .when(kind == "MULTIPOINT", wrap(F.array_join(F.transform(parts, lambda p: ring(p[0])), ", ")))
        .when(kind == "MULTILINESTRING", wrap(F.array_join(F.transform(parts, lambda p: ring(p[0])), ", ")))
        .when(kind == "MULTIPOLYGON", wrap(F.array_join(F.transform(parts, poly), ", ")))
    )
    return F.when(
        g.isNotNull(), F.concat(kind, F.lit(" "), F.when(is_empty(g), F.lit("EMPTY")).otherwise(body))
    )


# GeoJSON spelling of the kinds.
GEOJSON_KIND = {
    "POINT": "Point",
    "LINESTRING": "LineString",
    "POLYGON": "Polygon",
    "MULTIPOINT": "MultiPoint",
    "MULTILINESTRING": "MultiLineString",
    "MULTIPOLYGON": "MultiPolygon",
}


def kind_label(kind: Column) -> Column:
    out = kind
    for upper, label in GEOJSON_KIND.items():
        out = F.when(kind == upper, F.lit(label)).otherwise(out)
    return out


@_bound
def as_geojson(g: Column) -> Column:
    pair = lambda p: F.concat(F.lit("["), number_text(p["x"]), F.lit(","), number_text(p["y"]), F.lit("]"))
    wrap = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    ring = lambda r: wrap(_coords_text(r, pair, ","))
    poly = lambda part: wrap(F.array_join(F.transform(part, ring), ","))
    parts, kind = g["parts"], g["kind"]
    body = (
        F.when(kind == "POINT", pair(vertices(g)[0]))
        .when(kind.isin("LINESTRING", "MULTIPOINT"), ring(vertices(g)))
        .when(kind == "POLYGON", poly(parts[0]))
        .when(kind == "MULTILINESTRING", wrap(F.array_join(F.transform(parts, lambda p: ring(p[0])), ",")))
        .when(kind == "MULTIPOLYGON", wrap(F.array_join(F.transform(parts, poly), ",")))
    )
    return F.when(
        g.isNotNull() & ~is_empty(g),
        F.concat(F.lit('{"type":"'), kind_label(kind), F.lit('","coordinates":'), body, F.lit("}")),
    )


# --------------------------------------------------------------------- measures

def steps(pts: Column) -> Column:
    """Consecutive vertex pairs ``(a, b)`` of a line or closed ring."""
    n = F.size(pts)
    return F.when(
        n >= 2,
        F.arrays_zip(F.slice(pts, F.lit(1), n - 1).alias("a"), F.slice(pts, F.lit(2), n - 1).alias("b")),
    ).otherwise(F.array().cast(f"array<struct<a:{XY},b:{XY}>>"))


def _ring_moments(ring: Column) -> Column:
    """Signed double area and first moments of a closed ring, about its first vertex."""

    def fold(r: Column) -> Column:
        o = r[0]

        def add(acc: Column, s: Column) -> Column:
            ax, ay = s["a"]["x"] - o["x"], s["a"]["y"] - o["y"]
            bx, by = s["b"]["x"] - o["x"], s["b"]["y"] - o["y"]
            cross = ax * by - bx * ay
            return F.struct(
                (acc["a"] + cross).alias("a"),
                (acc["sx"] + (ax + bx) * cross).alias("sx"),
                (acc["sy"] + (ay + by) * cross).alias("sy"),
            )

        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

        def oriented(m: Column) -> Column:
            # outer rings count positive whatever their direction
            s = F.signum(m["a"])
            area = F.abs(m["a"]) / 2
            return F.struct(
                area.alias("area"),
                (area * o["x"] + s * m["sx"] / 6).alias("mx"),
                (area * o["y"] + s * m["sy"] / 6).alias("my"),
            )

        return let(F.aggregate(steps(r), zero, add), oriented)

    return let(ring, fold)


def polygon_moments(parts: Column) -> Column:
    """Area and first moments over parts, holes subtracted."""

    def add_part(acc: Column, part: Column) -> Column:
        def add_ring(a: Column, item: Column) -> Column:
            sign, m = item["sign"], item["m"]
            return F.struct(
                (a["area"] + sign * m["area"]).alias("area"),
                (a["mx"] + sign * m["mx"]).alias("mx"),
                (a["my"] + sign * m["my"]).alias("my"),
            )

        rings = F.transform(
            part,
            lambda ring, i: F.struct(
                F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"), _ring_moments(ring).alias("m")
            ),
        )
        return F.aggregate(rings, acc, add_ring)

    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(parts, zero, add_part)


def _is(g: Column, *kinds: str) -> Column:
    return g["kind"].isin(*kinds)


@_bound
def area(g: Column) -> Column:
    """Planar area; 0 for points and lines."""
    return F.when(
        g.isNotNull(), F.when(_is(g, "POLYGON", "MULTIPOLYGON"), polygon_moments(g["parts"])["area"]).otherwise(0.0)
    )


def _step_length(s: Column) -> Column:
    return F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))


@_bound
def length(g: Column) -> Column:
    """Total length of lines, or of all rings of polygons."""
    lines = F.flatten(g["parts"])
    total = F.aggregate(
        lines, F.lit(0.0), lambda acc, ln: acc + F.aggregate(steps(ln), F.lit(0.0), lambda a, s: a + _step_length(s))
    )
    return F.when(g.isNotNull(), F.when(_is(g, "POINT", "MULTIPOINT"), F.lit(0.0)).otherwise(total))


def _mean_vertex(pts: Column) -> Column:
    n = F.size(pts)
    total = lambda f: F.aggregate(pts, F.lit(0.0), lambda a, p: a + p[f])
    return xy(total("x") / n, total("y") / n)


def _line_centroid(lines: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, s: Column) -> Column:
        return let(
            _step_length(s),
            lambda w: F.struct(
                (acc["w"] + w).alias("w"),
                (acc["mx"] + w * (s["a"]["x"] + s["b"]["x"]) / 2).alias("mx"),
                (acc["my"] + w * (s["a"]["y"] + s["b"]["y"]) / 2).alias("my"),
            ),
        )

    folded = F.aggregate(lines, zero, lambda acc, ln: F.aggregate(steps(ln), acc, add))
    return let(folded, lambda m: F.when(m["w"] > 0, xy(m["mx"] / m["w"], m["my"] / m["w"])))


@_bound
def centroid(g: Column) -> Column:
    """Centroid as ``struct<x, y>``: area-, length- or count-weighted by kind."""
    by_area = let(
        polygon_moments(g["parts"]), lambda m: F.when(m["area"] > 0, xy(m["mx"] / m["area"], m["my"] / m["area"]))
    )
    by_length = _line_centroid(F.flatten(g["parts"]))
    by_count = let(vertices(g), _mean_vertex)
    polygonal = _is(g, "POLYGON", "MULTIPOLYGON")
    pointwise = _is(g, "POINT", "MULTIPOINT")
    return F.when(
        g.isNotNull() & ~is_empty(g),
        F.when(pointwise, by_count)
        .when(polygonal, F.coalesce(by_area, by_length, by_count))
        .otherwise(F.coalesce(by_length, by_count)),
    )


@_bound
def bbox(g: Column) -> Column:
    def box(pts: Column) -> Column:
        xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
        return F.struct(
            F.array_min(xs).alias("minx"),
            F.array_min(ys).alias("miny"),
            F.array_max(xs).alias("maxx"),
            F.array_max(ys).alias("maxy"),
        )

    return F.when(g.isNotNull() & ~is_empty(g), let(vertices(g), box))


def map_coordinates(g: Column, move: Callable[[Column, Column], Column]) -> Column:
    """Apply ``move(x, y) -> struct<x, y>`` to every coordinate."""
    moved = lambda ring: F.transform(ring, lambda p: move(p["x"], p["y"]))
    return let(
        g, lambda v: F.when(v.isNotNull(), _geometry(v["kind"], F.transform(v["parts"], lambda part: F.transform(part, moved))))
    )


# --------------------------------------------------------------------- validity

_EDGE = "struct<x0:double,ring:int,i:int,n:int,ax:double,ay:double,bx:double,by:double,x1:double,y0:double,y1:double>"


def _side(e: Column, x: Column, y: Column) -> Column:
    return F.signum((e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]))


def _ring_edges(ring: Column, number: Column) -> Column:
    """Edges of a closed ring in order, repeated vertices left out, with their boxes."""
    distinct = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))

    def edges(pairs: Column) -> Column:
        return F.transform(
            pairs,
            lambda s, i: F.struct(
                F.least(s["a"]["x"], s["b"]["x"]).alias("x0"), number.cast("int").alias("ring"), i.alias("i"), F.size(pairs).alias("n"),
                s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), s["b"]["x"].alias("bx"), s["b"]["y"].alias("by"),
                F.greatest(s["a"]["x"], s["b"]["x"]).alias("x1"), F.least(s["a"]["y"], s["b"]["y"]).alias("y0"), F.greatest(s["a"]["y"], s["b"]["y"]).alias("y1"),
            ),
        )

    return let(steps(distinct), edges).cast(f"array<{_EDGE}>")


def _clash(e: Column, f: Column) -> Column:
    """Whether two edges meet in a way that no valid polygon has.

    Edges of one ring meet at the vertex between them only. Edges of two rings may touch, but
    neither cross nor lie on each other.
    """
    apart = (e["x0"] > f["x1"]) | (f["x0"] > e["x1"]) | (e["y0"] > f["y1"]) | (f["y0"] > e["y1"])

    def judged(s: Column) -> Column:
        contact = (s["a"] * s["b"] <= 0) & (s["c"] * s["d"] <= 0)
        crossing = (s["a"] * s["b"] < 0) & (s["c"] * s["d"] < 0)
        length = F.greatest(F.least(e["x1"], f["x1"]) - F.greatest(e["x0"], f["x0"]), F.least(e["y1"], f["y1"]) - F.greatest(e["y0"], f["y0"]))
        along = (s["a"] == 0) & (s["b"] == 0) & (length > 0)
        gap = F.abs(e["i"] - f["i"])
        neighbours = (gap == 1) | (gap == e["n"] - 1)
        return F.when((e["ring"] == f["ring"]) & ~neighbours, contact).when(e["ring"] == f["ring"], along).otherwise(crossing | along)

    sides = F.struct(
        _side(e, f["ax"], f["ay"]).alias("a"), _side(e, f["bx"], f["by"]).alias("b"), _side(f, e["ax"], e["ay"]).alias("c"), _side(f, e["bx"], e["by"]).alias("d")
    )
    return ~apart & let(sides, judged)


def _any_clash(edges: Column) -> Column:
    """Whether any two edges clash: a sweep in order of the left ends against the edges not yet passed."""
    state = f"struct<active:array<{_EDGE}>,bad:boolean>"

    def step(acc: Column, e: Column) -> Column:
        def met(active: Column) -> Column:
            return F.struct(F.concat(active, F.array(e)).alias("active"), F.exists(active, lambda f: _clash(e, f)).alias("bad")).cast(state)

        return F.when(acc["bad"], acc).otherwise(let(F.filter(acc["active"], lambda f: f["x1"] >= e["x0"]), met))

    start = F.struct(F.array().cast(f"array<{_EDGE}>").alias("active"), F.lit(False).alias("bad")).cast(state)
    return F.aggregate(F.array_sort(edges), start, step)["bad"]


def _place(edges: Column, x: Column, y: Column) -> Column:
    """1 inside the ring, 0 on it, -1 outside, by counting the edges to the right."""
    on = F.exists(edges, lambda e: (_side(e, x, y) == 0) & x.between(e["x0"], e["x1"]) & y.between(e["y0"], e["y1"]))
    right = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
    return F.when(on, 0).when(F.size(right) % 2 == 1, 1).otherwise(-1)


def _any_place(ring: Column, other: Column, wanted: Callable[[Column, Column], Column]) -> Column:
    """Whether a vertex or an edge's middle of ``ring`` is at a wanted place; rings that don't cross need no more."""
    middle = lambda e, c: (e[f"a{c}"] + e[f"b{c}"]) / 2
    return F.exists(ring, lambda e: wanted(e["ax"], e["ay"])) | F.exists(ring, lambda e: wanted(middle(e, "x"), middle(e, "y")))


def _meets(a: Column, b: Column) -> Column:
    """Whether the boxes of two rings' edges overlap."""
    low, high = lambda r, c: F.array_min(F.transform(r, lambda e: e[c])), lambda r, c: F.array_max(F.transform(r, lambda e: e[c]))
    return (low(a, "x0") <= high(b, "x1")) & (low(b, "x0") <= high(a, "x1")) & (low(a, "y0") <= high(b, "y1")) & (low(b, "y0") <= high(a, "y1"))


def _hole_misplaced(rings: Column) -> Column:
    """Whether a hole leaves its shell, or has part of another hole in it."""
    shell = rings[0]
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    outside = F.exists(holes, lambda h: _any_place(h, shell, lambda x, y: _place(shell, x, y) == -1))

    def nested(hs: Column) -> Column:
        numbered = F.transform(hs, lambda h, i: F.struct(i.alias("i"), h.alias("h")))
        return F.exists(numbered, lambda a: F.exists(numbered, lambda b: (a["i"] != b["i"]) & _meets(a["h"], b["h"]) & _any_place(a["h"], b["h"], lambda x, y: _place(b["h"], x, y) == 1)))

    return outside | ((F.size(holes) > 1) & let(holes, nested))


def _parts_overlap(parts: Column) -> Column:
    """Whether a part's shell enters the inside of another part; a hole of it is not its inside."""
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))

    def enters(a: Column, b: Column) -> Column:
        holes = F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))
        within = lambda x, y: (_place(b[0], x, y) == 1) & ~F.exists(holes, lambda h: _place(h, x, y) >= 0)
        return _meets(a[0], b[0]) & _any_place(a[0], b[0], within)

    return F.exists(numbered, lambda a: F.exists(numbered, lambda b: (a["i"] != b["i"]) & enters(a["p"], b["p"])))


def is_valid(g: Column) -> Column:
    """Topological validity by rule, as a column that stands anywhere, in conditions too.

    Coordinates are finite; a line has two distinct points; a ring is closed, has four or more
    points and a non-zero area and does not touch itself; rings of a shape neither cross nor lie on
    each other; holes are inside their shell and not in each other; parts don't overlap. Holes that
    together cut a shape's inside in two by touching at points are not looked for.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    def by_rule(v: Column) -> Column:
        finite = ~F.exists(vertices(v), lambda p: bad(p["x"]) | bad(p["y"]))
        lines_ok = F.forall(F.flatten(v["parts"]), lambda ln: F.size(F.array_distinct(ln)) >= 2)
        rings_ok = F.forall(
            F.flatten(v["parts"]),
            lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)) & (_ring_moments(r)["area"] > 0),
        )
        # rings are numbered through the parts
        parts = F.transform(v["parts"], lambda part, k: F.transform(part, lambda r, i: _ring_edges(r, k * 1000000 + i)))
        placed = let(
            parts,
            lambda ps: ~_any_clash(F.flatten(F.flatten(ps))) & ~F.exists(ps, lambda p: (F.size(p) > 1) & _hole_misplaced(p)) & ~((F.size(ps) > 1) & _parts_overlap(ps)),
        )
        simple = (F.size(v["parts"]) == 1) & (F.size(vertices(v)) <= 4)
        polygons_ok = F.when(~finite | ~rings_ok, False).otherwise(simple | placed)
        return (
            F.when(v.isNull(), F.lit(None).cast("boolean"))
            .when(_is(v, "POLYGON", "MULTIPOLYGON"), polygons_ok)
            .when(_is(v, "LINESTRING", "MULTILINESTRING"), finite & lines_ok)
            .otherwise(finite)
        )

    return let(g, by_rule)


# --------------------------------------------------------------------- clipping

def clip_convex(ring: Column, edges: Column) -> Column:
    """Clip an open vertex list by a convex polygon given as directed edges.

    ``edges`` are ``(a, b)`` pairs in counter-clockwise order; the result is an
    open list whose shoelace area is the area of the intersection.
    """

    def cut(pts: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]

        def scored(ps: Column) -> Column:
            n = F.size(ps)
            offset = lambda p: (bx - ax) * (p["y"] - ay) - (by - ay) * (p["x"] - ax)
            return F.transform(
                ps,
                lambda p, i: let(
                    F.get(ps, (i + 1) % n),
                    lambda q: F.struct(p.alias("p"), q.alias("q"), offset(p).alias("sp"), offset(q).alias("sq")),
                ),
            )

        def emitted(s: Column) -> Column:
            t = s["sp"] / (s["sp"] - s["sq"])
            meet = xy(
                s["p"]["x"] + t * (s["q"]["x"] - s["p"]["x"]), s["p"]["y"] + t * (s["q"]["y"] - s["p"]["y"])
            )
            p_in, q_in = s["sp"] >= 0, s["sq"] >= 0
            return (
                F.when(p_in & q_in, F.array(s["q"]))
                .when(p_in, F.array(meet))
                .when(q_in, F.array(meet, s["q"]))
                .otherwise(F.array().cast(f"array<{XY}>"))
            )

        return F.flatten(F.transform(let(pts, scored), emitted))

    return F.aggregate(edges, ring, cut)


def open_area(pts: Column) -> Column:
    """Absolute shoelace area of an open vertex list."""

    def total(ps: Column) -> Column:
        n = F.size(ps)
        crosses = F.transform(
            ps,
            lambda p, i: let(
                F.get(ps, (i + 1) % n),
                lambda q: (p["x"] - ps[0]["x"]) * (q["y"] - ps[0]["y"])
                - (q["x"] - ps[0]["x"]) * (p["y"] - ps[0]["y"]),
            ),
        )
        return F.when(n >= 3, F.abs(F.aggregate(crosses, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(0.0)

    return let(pts, total)


def clipped_area(g: Column, edges: Column) -> Column:
    """Area of a polygonal geometry inside a convex polygon; holes subtracted."""

    def ring_area(ring: Column) -> Column:
        return open_area(clip_convex(F.slice(ring, F.lit(1), F.size(ring) - 1), edges))

    def part_area(part: Column) -> Column:
        signed = F.transform(
            part, lambda ring, i: F.when(i == 0, ring_area(ring)).otherwise(-ring_area(ring))
        )
        return F.aggregate(signed, F.lit(0.0), lambda a, v: a + v)

    def total(v: Column) -> Column:
        areas = F.aggregate(F.transform(v["parts"], part_area), F.lit(0.0), lambda a, b: a + b)
        return F.when(v.isNotNull(), F.when(_is(v, "POLYGON", "MULTIPOLYGON"), areas).otherwise(0.0))

    return let(g, total)


def rectangle_edges(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Counter-clockwise edges of a rectangle, for :func:`clip_convex`."""
    corners = [xy(minx, miny), xy(maxx, miny), xy(maxx, maxy), xy(minx, maxy)]
    return F.array(
        *[F.struct(corners[i].alias("a"), corners[(i + 1) % 4].alias("b")) for i in range(4)]
    )
