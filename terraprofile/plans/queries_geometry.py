"""Registered queries: geometry columns and reference systems."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terraprofile.functions import crs
from terraprofile.functions import geometry as G
from terraprofile.functions.crs import PROJECTIONS, Ellipsoid
from terraprofile.operators import locate
from terraprofile.operators.clean import decimal_comma
from terraprofile.plans.fixtures import Inputs
from terraprofile.plans.queries_table import CAST_LINES, CODES, JSON, LINES, POINTS, POLYS
from terraprofile.plans.registry import query


def num(v: str) -> str:
    """A double as shortest text in SQL."""
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


# vertices of the rectangle view, in order: (key, i, x, y)
POLY_VERTICES = """pv AS (SELECT poly_id, generate_subscripts(m, 1) AS i, unnest(m) AS t FROM (SELECT poly_id, regexp_extract_all(geometry, '-?[0-9.]+ -?[0-9.]+') AS m FROM geo_polys)),
v AS (SELECT poly_id, i, CAST(split_part(t, ' ', 1) AS DOUBLE) AS x, CAST(split_part(t, ' ', 2) AS DOUBLE) AS y FROM pv),
e AS (SELECT poly_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY poly_id ORDER BY i))
"""


@query("point_from_xy", f"""
SELECT event_id, concat('POINT (', {num("longitude")}, ' ', {num("latitude")}, ')') AS wkt FROM geo_points WHERE longitude IS NOT NULL AND latitude IS NOT NULL
UNION ALL SELECT event_id, NULL FROM geo_points WHERE longitude IS NULL OR latitude IS NULL""", POINTS)
def _(t: Inputs):
    g = G.point(F.col("longitude"), F.col("latitude"))
    return t.view("geo_points").select("event_id", G.as_wkt(g).alias("wkt"))


@query("point_from_latlon_text", """
SELECT c_custkey, CASE WHEN len(p) = 2 THEN TRY_CAST(trim(p[2]) AS DOUBLE) END AS lon, CASE WHEN len(p) = 2 THEN TRY_CAST(trim(p[1]) AS DOUBLE) END AS lat
FROM (SELECT c_custkey, string_split("geo point", ',') AS p FROM geo_codes)""", CODES)
def _(t: Inputs):
    df = locate.add_geometry(t.view("geo_codes"), "geopoint", ["geo point"], "g")
    p = G.vertices(F.col("g"))[0]
    return df.select("c_custkey", p["x"].alias("lon"), p["y"].alias("lat"))


@query("geometry_from_geojson", """
WITH p AS (SELECT s_suppkey, CASE WHEN json_valid(geom) THEN geom END AS j FROM geo_json)
SELECT s_suppkey, upper(json_extract_string(j, '$.type')) AS kind, CAST(json_extract(j, '$.coordinates[0]') AS DOUBLE) AS x, CAST(json_extract(j, '$.coordinates[1]') AS DOUBLE) AS y FROM p""", JSON)
def _(t: Inputs):
    df = locate.add_geometry(t.view("geo_json"), "geojson", ["geom"], "g")
    p = G.vertices(F.col("g"))[0]
    return df.select("s_suppkey", F.col("g.kind").alias("kind"), p["x"].alias("x"), p["y"].alias("y"))


@query("geometry_from_wkt", """
SELECT s_suppkey, CASE WHEN shape LIKE 'LINESTRING%' THEN 'LINESTRING' END AS kind, CASE WHEN shape LIKE 'LINESTRING%' THEN CAST(3 AS BIGINT) END AS n_vertices,
CASE WHEN shape LIKE 'LINESTRING%' THEN CAST(regexp_extract(shape, '([0-9]+) ([0-9]+)\\)$', 2) AS DOUBLE) END AS last_y FROM geo_json""", JSON)
def _(t: Inputs):
    df = locate.add_geometry(t.view("geo_json"), "from_wkt", ["shape"], "g")
    return df.select(
        "s_suppkey", F.col("g.kind").alias("kind"), G.vertex_count(F.col("g")).alias("n_vertices"), F.try_element_at(G.vertices(F.col("g")), F.lit(-1))["y"].alias("last_y")
    )


@query("geometry_malformed", """
SELECT count(geom) AS n_present, count(geom) FILTER (NOT json_valid(geom)) AS n_malformed FROM geo_json""", JSON)
def _(t: Inputs):
    return locate.malformed_count(locate.add_geometry(t.view("geo_json"), "geojson", ["geom"], "g"), "geom", "g")


@query("line_from_endpoints", CAST_LINES + f"""
SELECT road_id, concat('LINESTRING (', {num("x_s")}, ' ', {num("y_s")}, ', ', {num("x_e")}, ' ', {num("y_e")}, ')') AS wkt FROM c""", LINES)
def _(t: Inputs):
    df = locate.add_geometry(t.view("geo_lines"), "linestring_coords", ["xD", "yD", "xF", "yF"], "g")
    return df.where("g IS NOT NULL").select("road_id", G.as_wkt(F.col("g")).alias("wkt"))


@query("geometry_as_wkt", "SELECT poly_id, geometry AS wkt FROM geo_polys", POLYS)
def _(t: Inputs):
    return polygons(t).select("poly_id", G.as_wkt(F.col("g")).alias("wkt"))


def polygons(t: Inputs):
    # a small file is one task, which parsing its shapes is too much for; no filter on shapes moves before this
    rows = t.view("geo_polys").repartition("poly_id")
    return locate.add_geometry(rows, "from_wkt", ["geometry"], "parsed").select(*rows.columns, G.computed(F.col("parsed")).alias("g"))


def lines(t: Inputs):
    return locate.add_geometry(t.view("geo_lines"), "linestring_coords", ["xD", "yD", "xF", "yF"], "g")


def points(t: Inputs):
    return t.view("geo_points").select("event_id", G.point(F.col("longitude"), F.col("latitude")).alias("g"))


def all_shapes(t: Inputs):
    return polygons(t).select("g").unionByName(lines(t).select("g")).unionByName(points(t).select("g"))


@query("geometry_type_counts", CAST_LINES + """,
k AS (SELECT 'Polygon' AS kind, count(*) AS n FROM geo_polys UNION ALL SELECT 'LineString', count(*) FROM c UNION ALL SELECT 'Point', count(*) FROM geo_points WHERE longitude IS NOT NULL AND latitude IS NOT NULL)
SELECT string_agg(kind, ', ' ORDER BY n DESC, kind) AS kinds, CAST(sum(n) AS BIGINT) AS n FROM k""", LINES + POINTS + POLYS)
def _(t: Inputs):
    return locate.geometry_type_counts(all_shapes(t), "g")


LINE_MID = "SELECT road_id AS id, (x_s + x_e) / 2 AS cx, (y_s + y_e) / 2 AS cy FROM c"
AREA_CENTRE = """, a AS (SELECT poly_id AS id, sum(x * y2 - x2 * y) AS a2, sum((x + x2) * (x * y2 - x2 * y)) AS sx, sum((y + y2) * (x * y2 - x2 * y)) AS sy FROM e WHERE x2 IS NOT NULL GROUP BY poly_id)
"""


@query("centroid", f"WITH {POLY_VERTICES}{AREA_CENTRE}, {CAST_LINES.strip()[5:]}" + f"""
SELECT 'polygon' AS layer, CAST(id AS BIGINT) AS id, round(sx / (3 * a2), 6) AS cx, round(sy / (3 * a2), 6) AS cy FROM a
UNION ALL SELECT 'line', id, round(cx, 6), round(cy, 6) FROM ({LINE_MID})
UNION ALL SELECT 'point', event_id, longitude, latitude FROM geo_points WHERE longitude IS NOT NULL AND latitude IS NOT NULL""", POLYS + LINES + POINTS)
def _(t: Inputs):
    rows = (
        polygons(t).select(F.lit("polygon").alias("layer"), F.col("poly_id").cast("bigint").alias("id"), "g")
        .unionByName(lines(t).select(F.lit("line").alias("layer"), F.col("road_id").alias("id"), "g"))
        .unionByName(points(t).select(F.lit("point").alias("layer"), F.col("event_id").alias("id"), "g"))
    )
    c = rows.where("g IS NOT NULL").select("layer", "id", G.centroid(F.col("g")).alias("c"))
    return c.select("layer", "id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query("vertex_count", f"WITH {POLY_VERTICES} SELECT CAST(poly_id AS BIGINT) AS id, count(*) AS n_vertices FROM v GROUP BY poly_id UNION ALL SELECT s_suppkey, CAST(len(regexp_extract_all(shape, '[0-9]+ [0-9]+')) AS BIGINT) FROM geo_json WHERE shape LIKE 'LINESTRING%'", POLYS + JSON)
def _(t: Inputs):
    json_lines = locate.add_geometry(t.view("geo_json"), "from_wkt", ["shape"], "g").where("g IS NOT NULL").select(F.col("s_suppkey").alias("id"), "g")
    rows = polygons(t).select(F.col("poly_id").cast("bigint").alias("id"), "g").unionByName(json_lines)
    return rows.select("id", G.vertex_count(F.col("g")).alias("n_vertices"))


BOWTIE = r"\(\(([^,]+), ([^,]+), ([^,]+), "


@query("is_valid", "SELECT poly_id, poly_id % 2 = 0 AS valid FROM geo_polys", POLYS)
def _(t: Inputs):
    # two swapped corners make every second rectangle cross itself
    crossed = F.regexp_replace("geometry", BOWTIE, "(($1, $3, $2, ")
    df = t.view("geo_polys").withColumn("geometry", F.when(F.col("poly_id") % 2 == 1, crossed).otherwise(F.col("geometry")))
    return locate.add_geometry(df, "from_wkt", ["geometry"], "g").select("poly_id", G.is_valid(F.col("g")).alias("valid"))


@query("area_length", f"""WITH {POLY_VERTICES}
SELECT poly_id, round(abs(sum(CASE WHEN x2 IS NOT NULL THEN x * y2 - x2 * y END)) / 2, 6) AS area, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 6) AS length,
min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM e GROUP BY poly_id""", POLYS)
def _(t: Inputs):
    g = F.col("g")
    return polygons(t).select("poly_id", F.round(G.area(g), 6).alias("area"), F.round(G.length(g), 6).alias("length"), G.bbox(g).alias("b")).select(
        "poly_id", "area", "length", "b.*"
    )


@query("filter_bounds_geometry", """
WITH """ + POLY_VERTICES + """, k AS (SELECT poly_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM v GROUP BY poly_id)
SELECT poly_id FROM k WHERE cx BETWEEN -5.5 AND 4.0 AND cy BETWEEN 41.0 AND 48.0""", POLYS)
def _(t: Inputs):
    return locate.filter_bounds_geometry(polygons(t), "g", 4326, (-5.5, 41.0, 4.0, 48.0)).select("poly_id")


# -------------------------------------------------------------------------- CRS

def guess_sql(x: str, y: str, source: str, by: str = "") -> str:
    key = f"{by} AS dataset_id, " if by else ""
    group = " GROUP BY dataset_id" if by else ""
    keep = "dataset_id, " if by else ""
    return f"""SELECT {keep}n AS n_located, CAST(CASE WHEN mx > -10 AND mx < 10 AND my > 40 AND my < 60 THEN 4326 WHEN mx > 100000 AND mx < 1300000 AND my > 6000000 AND my < 7400000 THEN 2154
WHEN mx > -2200000 AND mx < 2200000 AND my > -2200000 AND my < 2200000 THEN 3857 END AS INTEGER) AS epsg
FROM (SELECT {key}count(*) AS n, median({x}) AS mx, median({y}) AS my FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL{group})"""


@query("guess_crs_points", guess_sql("longitude", "latitude", "geo_points"), POINTS)
def _(t: Inputs):
    return locate.guess_crs(t.view("geo_points"), F.col("longitude"), F.col("latitude"))


@query("guess_crs_by_dataset", guess_sql("longitude", "latitude", "geo_points", "event_type") + " UNION ALL " + guess_sql("x", "y", "grid_points", "'grid'") +
       " UNION ALL " + guess_sql("x", "y", "(SELECT CAST(value * 9000 AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y FROM events)", "'small'"), POINTS + ("grid_points",))
def _(t: Inputs):
    small = t.table("events").select((F.col("value") * 9000).alias("x"), F.col("user_id").alias("y"))
    parts = [
        locate.guess_crs(t.view("geo_points"), F.col("longitude"), F.col("latitude"), F.col("event_type")),
        locate.guess_crs(t.view("grid_points"), F.col("x"), F.col("y"), F.lit("grid")),
        locate.guess_crs(small, F.col("x"), F.col("y"), F.lit("small")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("guess_crs_geometry", f"WITH {POLY_VERTICES}, k AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM v GROUP BY poly_id) " + guess_sql("cx", "cy", "k"), POLYS)
def _(t: Inputs):
    return locate.guess_crs_geometry(polygons(t), "g")


def forward_sql(epsg: int, lon: str, lat: str) -> tuple[str, str]:
    """Textbook forward formulas as SQL, in forms other than the column expressions."""
    p = PROJECTIONS[epsg]
    lam, phi = f"radians({lon})", f"radians({lat})"
    if p["method"] == "mercator":
        return f"({lam} * {p['radius']!r})", f"({p['radius']!r} * ln(tan(pi() / 4 + {phi} / 2)))"
    ell = Ellipsoid.named(p["ellipsoid"])
    a, e = repr(ell.a), repr(ell.e)
    es = f"({e} * sin({phi}))"
    lam0, phi0 = math.radians(p["lon0"]), math.radians(p["lat0"])
    if p["method"] == "lcc":
        phi1, phi2 = math.radians(p["lat1"]), math.radians(p["lat2"])
        t = lambda f: math.tan(math.pi / 4 - f / 2) / ((1 - ell.e * math.sin(f)) / (1 + ell.e * math.sin(f))) ** (ell.e / 2)
        n = math.sin(phi1) if phi1 == phi2 else math.log(ell.m(phi1) / ell.m(phi2)) / math.log(t(phi1) / t(phi2))
        big = ell.a * ell.m(phi1) / (n * t(phi1) ** n)
        rho = f"({big!r} * pow(tan(pi() / 4 - {phi} / 2) / pow((1 - {es}) / (1 + {es}), {e} / 2), {n!r}))"
        th = f"({n!r} * ({lam} - {lam0!r}))"
        return f"({p['x0']!r} + {rho} * sin({th}))", f"({p['y0']!r} + {big * t(phi0) ** n!r} - {rho} * cos({th}))"
    q = lambda f: f"((1 - {e} * {e}) * (sin({f}) / (1 - {e} * {e} * sin({f}) * sin({f})) - ln((1 - {e} * sin({f})) / (1 + {e} * sin({f}))) / (2 * {e})))"
    if p["method"] == "aea":
        phi1, phi2 = math.radians(p["lat1"]), math.radians(p["lat2"])
        n = (ell.m(phi1) ** 2 - ell.m(phi2) ** 2) / (ell.q(phi2) - ell.q(phi1))
        c = ell.m(phi1) ** 2 + n * ell.q(phi1)
        rho = f"({a} * sqrt({c!r} - {n!r} * {q(phi)}) / {n!r})"
        rho0 = ell.a * math.sqrt(c - n * ell.q(phi0)) / n
        th = f"({n!r} * ({lam} - {lam0!r}))"
        return f"({p['x0']!r} + {rho} * sin({th}))", f"({p['y0']!r} + {rho0!r} - {rho} * cos({th}))"
    if p["method"] == "laea":
        qp = ell.q(math.pi / 2)
        b0 = math.asin(ell.q(phi0) / qp)
        rq = ell.a * math.sqrt(qp / 2)
        d = ell.a * ell.m(phi0) / (rq * math.cos(b0))
        sb, cb = f"({q(phi)} / {qp!r})", f"sqrt(1 - pow({q(phi)} / {qp!r}, 2))"
        b = f"({rq!r} * sqrt(2 / (1 + {math.sin(b0)!r} * {sb} + {math.cos(b0)!r} * {cb} * cos({lam} - {lam0!r}))))"
        return (
            f"({p['x0']!r} + {b} * {d!r} * {cb} * sin({lam} - {lam0!r}))",
            f"({p['y0']!r} + {b} / {d!r} * ({math.cos(b0)!r} * {sb} - {math.sin(b0)!r} * {cb} * cos({lam} - {lam0!r})))",
        )
    # transverse Mercator: Krueger's series
    n = ell.n
    rect = ell.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    co = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    chi0 = 2 * math.atan(1 / ell.isometric_t(phi0)) - math.pi / 2
    xi0 = chi0 + sum(c * math.sin(2 * j * chi0) for j, c in enumerate(co, 1))
    dl = f"({lam} - {lam0!r})"
    tau = f"sinh(asinh(tan({phi})) - {e} * atanh({es}))"
    xi, eta = f"atan2({tau}, cos({dl}))", f"asinh(sin({dl}) / sqrt(pow({tau}, 2) + pow(cos({dl}), 2)))"
    east = " + ".join(f"{c!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(co, 1))
    north = " + ".join(f"{c!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(co, 1))
    k = p["k0"] * rect
    return f"({p['x0']!r} + {k!r} * ({eta} + {east}))", f"({p['y0']!r} + {k!r} * ({xi} + {north} - {xi0!r}))"


def reproject_query(epsg: int, digits: int):
    x, y = forward_sql(epsg, "longitude", "latitude")
    name = f"reproject_{epsg}"

    @query(name, f"SELECT event_id, round({x}, {digits}) AS x, round({y}, {digits}) AS y FROM geo_points WHERE longitude IS NOT NULL AND latitude IS NOT NULL", POINTS)
    def _(t: Inputs):
        rows = t.view("geo_points").where("longitude IS NOT NULL AND latitude IS NOT NULL")
        moved = locate.reproject_points(rows, "longitude", "latitude", 4326, epsg, ("x", "y"))
        return moved.select("event_id", F.round("x", digits).alias("x"), F.round("y", digits).alias("y"))


for _epsg, _digits in ((2154, 3), (3857, 3), (3035, 3), (5070, 3), (2062, 3), (27700, 3), (25832, 3)):
    reproject_query(_epsg, _digits)


METRIC_CODES = sorted(PROJECTIONS)


@query("reproject", " UNION ALL ".join("SELECT {0} AS epsg, event_id, round({1}, 3) AS x, round({2}, 3) AS y FROM geo_points WHERE longitude IS NOT NULL AND latitude IS NOT NULL".format(e, *forward_sql(e, "longitude", "latitude")) for e in METRIC_CODES), POINTS)
def _(t: Inputs):
    rows = t.view("geo_points").where("longitude IS NOT NULL AND latitude IS NOT NULL")
    # all codes from one scan
    targets = [F.struct(F.lit(e).alias("epsg"), *[c.alias(n) for c, n in zip(crs.transformer(4326, e)(F.col("longitude"), F.col("latitude")), "xy")]) for e in METRIC_CODES]
    return rows.select("event_id", F.inline(F.array(*targets))).select("epsg", "event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def inverse_lcc_sql() -> str:
    p, ell = PROJECTIONS[2154], Ellipsoid.named("GRS80")
    phi1, phi2, phi0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = math.log(ell.m(phi1) / ell.m(phi2)) / math.log(ell.isometric_t(phi1) / ell.isometric_t(phi2))
    big = ell.a * ell.m(phi1) / (n * ell.isometric_t(phi1) ** n)
    rho0 = big * ell.isometric_t(phi0) ** n
    e = repr(ell.e)
    steps = ["s0 AS (SELECT event_id, atan2(x - 700000, %r - (y - 6600000)) / %r + %r AS lam, pow(sqrt(pow(x - 700000, 2) + pow(%r - (y - 6600000), 2)) / %r, 1 / %r) AS t FROM grid_points)" % (rho0, n, math.radians(3.0), rho0, big, n),
             "p0 AS (SELECT *, pi() / 2 - 2 * atan(t) AS phi FROM s0)"]
    for i in range(1, 8):
        steps.append(f"p{i} AS (SELECT event_id, lam, t, pi() / 2 - 2 * atan(t * pow((1 - {e} * sin(phi)) / (1 + {e} * sin(phi)), {e} / 2)) AS phi FROM p{i - 1})")
    return "WITH " + ",\n".join(steps) + " SELECT event_id, round(degrees(lam), 8) AS lon, round(degrees(phi), 8) AS lat FROM p7"


@query("reproject_to_wgs84", inverse_lcc_sql(), ("grid_points",))
def _(t: Inputs):
    moved = locate.reproject_points(t.view("grid_points"), "x", "y", 2154, crs.GEOGRAPHIC, ("lon", "lat"))
    return moved.select("event_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query("reproject_geometry", "WITH " + POLY_VERTICES + "SELECT poly_id, CAST(i AS BIGINT) AS i, round({}, 3) AS x, round({}, 3) AS y FROM v".format(*forward_sql(2154, "x", "y")), POLYS)
def _(t: Inputs):
    moved = locate.reproject_geometry(polygons(t), "g", 4326, 2154)
    return moved.select("poly_id", F.posexplode(G.vertices(F.col("g"))).alias("i", "p")).select(
        "poly_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y")
    )


GUARD = f"""WITH d AS ({guess_sql("longitude", "latitude", "geo_points", "event_type")} UNION ALL {guess_sql("x", "y", "grid_points", "'grid'")})
SELECT dataset_id, n_located, epsg, CASE WHEN epsg IS NULL OR epsg = 4326 THEN CAST(n_located AS DOUBLE) END AS coverage FROM d"""


@query("crs_guard", GUARD, POINTS + ("grid_points",))
def _(t: Inputs):
    found = locate.guess_crs(t.view("geo_points"), F.col("longitude"), F.col("latitude"), F.col("event_type")).unionByName(
        locate.guess_crs(t.view("grid_points"), F.col("x"), F.col("y"), F.lit("grid"))
    )
    return locate.crs_guard(found.withColumn("coverage", F.col("n_located").cast("double")), 4326)


def line_columns(t: Inputs):
    """Castable segments as flat columns x1, y1, x2, y2."""
    pairs = zip(("xD", "yD", "xF", "yF"), ("x1", "y1", "x2", "y2"))
    return t.view("geo_lines").select("road_id", *[decimal_comma(F.col(c)).alias(a) for c, a in pairs]).dropna()
