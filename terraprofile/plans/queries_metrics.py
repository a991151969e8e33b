"""Registered queries: spatial metrics, neighbour statistics and metric rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraprofile.functions import geometry as G
from terraprofile.operators import cover, hull, locate, metrics, neighbours
from terraprofile.operators.clean import col
from terraprofile.plans.dataset_profile import (
    Rules,
    Territory,
    compute_all_metrics,
    default_geo_profile,
    profile_geometry,
    profile_lines,
    profile_points,
)
from terraprofile.plans.fixtures import Inputs
from terraprofile.plans.queries_geometry import POLY_VERTICES, forward_sql, guess_sql, line_columns, lines, points, polygons
from terraprofile.plans.queries_table import CAST_LINES, LINES, POINTS, POLYS
from terraprofile.plans.registry import query

GRID = ("grid_points",)
X93, Y93 = forward_sql(2154, "longitude", "latitude")
# in-bounds points in Lambert 93
METRIC_POINTS = f"""f AS (SELECT event_id, longitude, latitude, {X93} AS mx, {Y93} AS my FROM geo_points WHERE longitude BETWEEN -5.5 AND 10.0 AND latitude BETWEEN 41.0 AND 51.5)
"""


def metric_points(t: Inputs):
    rows = t.view("geo_points").where("longitude BETWEEN -5.5D AND 10.0D AND latitude BETWEEN 41.0D AND 51.5D")
    return locate.reproject_points(rows, "longitude", "latitude", 4326, 2154, ("mx", "my"))


TILES = ("metric_tiles",)


def tiles(t: Inputs, east: int = 0, north: int = 0):
    """The tiles in metres as shapes."""
    x0, y0, x1, y1 = F.col("x0") + east, F.col("y0") + north, F.col("x1") + east, F.col("y1") + north
    ring = F.array(*[G.xy(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return t.view("metric_tiles").select("poly_id", "value", G.polygon(ring).alias("g"))


def territory(t: Inputs) -> Territory:
    return Territory(tiles(t), "g", 2154)


def metric_polygons(t: Inputs):
    return locate.reproject_geometry(polygons(t), "g", 4326, 2154)


@query("presence_validity", """
WITH s AS (SELECT s_suppkey % 10 <> 9 AS ok FROM geo_json)
SELECT round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 1) AS present_pct, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 1) AS valid_pct FROM s""", ("geo_json",))
def _(t: Inputs):
    return metrics.presence_validity(locate.add_geometry(t.view("geo_json"), "from_wkt", ["shape"], "g"), "g")


@query("envelope_extent", f"""WITH {METRIC_POINTS}
SELECT round(min(mx), 3) AS minx, round(min(my), 3) AS miny, round(max(mx), 3) AS maxx, round(max(my), 3) AS maxy, round((max(mx) - min(mx)) * (max(my) - min(my)) / 1e6::DOUBLE, 4) AS extent_km2, count(*) AS n FROM f""", POINTS)
def _(t: Inputs):
    x, y = F.col("mx"), F.col("my")
    df = metrics.envelope_extent(metric_points(t), x, y, x, y)
    return df.select(*[F.round(c, 3).alias(c) for c in ("minx", "miny", "maxx", "maxy")], F.round("extent_km2", 4).alias("extent_km2"), "n")


@query("centroid_bbox", CAST_LINES + """SELECT round(min((x_s + x_e) / 2), 6) AS minx, round(min((y_s + y_e) / 2), 6) AS miny, round(max((x_s + x_e) / 2), 6) AS maxx, round(max((y_s + y_e) / 2), 6) AS maxy FROM c""", LINES)
def _(t: Inputs):
    c = lines(t).select(G.centroid(F.col("g")).alias("c")).where("c IS NOT NULL").select("c.x", "c.y")
    x, y = F.col("x"), F.col("y")
    return metrics.envelope_extent(c, x, y, x, y).select(*[F.round(n, 6).alias(n) for n in ("minx", "miny", "maxx", "maxy")])


@query("density", f"""WITH {METRIC_POINTS} SELECT round(count(*) / ((max(mx) - min(mx)) * (max(my) - min(my)) / 1e6::DOUBLE), 8) AS density FROM f""", POINTS)
def _(t: Inputs):
    x, y = F.col("mx"), F.col("my")
    df = metrics.envelope_extent(metric_points(t), x, y, x, y)
    return df.select(F.round(metrics.density(F.col("n"), F.col("extent_km2")), 8).alias("density"))


@query("fill_rate_bbox", CAST_LINES + """, s AS (SELECT min(least(x_s, x_e)) AS a, min(least(y_s, y_e)) AS b, max(greatest(x_s, x_e)) AS c, max(greatest(y_s, y_e)) AS d,
min((x_s + x_e) / 2) AS ca, min((y_s + y_e) / 2) AS cb, max((x_s + x_e) / 2) AS cc, max((y_s + y_e) / 2) AS cd FROM c)
SELECT round((c - a) * (d - b) / ((cc - ca) * (cd - cb)) * 100, 4) AS fill_rate_pct FROM s""", LINES)
def _(t: Inputs):
    s = line_columns(t).agg(
        ((F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))) * (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))) / 1e6).alias("e"),
        F.min((F.col("x1") + F.col("x2")) / 2).alias("a"), F.min((F.col("y1") + F.col("y2")) / 2).alias("b"),
        F.max((F.col("x1") + F.col("x2")) / 2).alias("c"), F.max((F.col("y1") + F.col("y2")) / 2).alias("d"),
    )
    return s.select(F.round(metrics.fill_rate_bbox(*[F.col(k) for k in "eabcd"]), 4).alias("fill_rate_pct"))


def hull_sql(source: str) -> str:
    """CTEs from points ``x, y`` of ``source`` to hull edges ``e``.

    A point is on the lower hull if it is the lowest at its x and every slope to
    the left is below every slope to the right; the upper hull is its mirror.
    """
    return f"""ends AS (SELECT x, min(y) AS lo, max(y) AS hi FROM {source} GROUP BY x),
lo AS (SELECT m.x, m.lo AS y, coalesce(max((m.lo - l.lo) / (m.x - l.x)) FILTER (l.x < m.x), -1e300) AS left_slope, coalesce(min((l.lo - m.lo) / (l.x - m.x)) FILTER (l.x > m.x), 1e300) AS right_slope FROM ends m, ends l GROUP BY m.x, m.lo),
hi AS (SELECT m.x, m.hi AS y, coalesce(min((m.hi - l.hi) / (m.x - l.x)) FILTER (l.x < m.x), 1e300) AS left_slope, coalesce(max((l.hi - m.hi) / (l.x - m.x)) FILTER (l.x > m.x), -1e300) AS right_slope FROM ends m, ends l GROUP BY m.x, m.hi),
ring AS (SELECT x, y, 0 AS side, x AS o FROM lo WHERE left_slope < right_slope UNION ALL SELECT x, y, 1, -x FROM hi WHERE left_slope > right_slope),
e AS (SELECT x - x0 AS x, y - y0 AS y, coalesce(lead(x) OVER w, first(x) OVER w) - x0 AS x2, coalesce(lead(y) OVER w, first(y) OVER w) - y0 AS y2 FROM ring, (SELECT min(x) AS x0, min(y) AS y0 FROM ring) WINDOW w AS (ORDER BY side, o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
area AS (SELECT abs(sum(CAST(x * y2 - x2 * y AS DOUBLE))) / 2 AS area FROM e)
"""


@query("fill_rate_points", f"""WITH {METRIC_POINTS}, p AS (SELECT mx AS x, my AS y FROM f), {hull_sql("p")}
SELECT (SELECT count(*) FROM p) AS n, round(area / (SELECT (max(x) - min(x)) * (max(y) - min(y)) FROM p) * 100, 4) AS fill_rate FROM area""", POINTS)
def _(t: Inputs):
    return metrics.fill_rate_points(metric_points(t), "mx", "my")


@query("convex_hull_area", f"WITH {hull_sql('grid_points')} SELECT round(area, 1) AS area FROM area", GRID)
def _(t: Inputs):
    return hull.convex_hull(t.view("grid_points"), F.col("x"), F.col("y")).select(F.round("area", 1).alias("area"))


def fill_lines_sql() -> str:
    return CAST_LINES + """,
b AS (SELECT min(least(x_s, x_e)) AS x0, min(least(y_s, y_e)) AS y0, max(greatest(x_s, x_e)) - min(least(x_s, x_e)) AS w, max(greatest(y_s, y_e)) - min(least(y_s, y_e)) AS h FROM c),
f AS (SELECT x0, y0, w * h AS area, sqrt(w * w + h * h) * 0.001::DOUBLE AS buf, sqrt(w * w + h * h) * 0.001::DOUBLE / 2 AS cell FROM b),
-- every cell centre near a segment's box, kept if its distance to the segment is within the buffer
k AS (SELECT DISTINCT ix, iy FROM (SELECT least(x_s, x_e) AS a, greatest(x_s, x_e) AS a2, least(y_s, y_e) AS d, greatest(y_s, y_e) AS d2, x_s, y_s, x_e, y_e, f.*,
  unnest(generate_series(CAST(floor((least(x_s, x_e) - buf - x0) / cell) AS BIGINT) - 1, CAST(floor((greatest(x_s, x_e) + buf - x0) / cell) AS BIGINT) + 1)) AS ix FROM c, f) s,
  LATERAL (SELECT unnest(generate_series(CAST(floor((d - buf - y0) / cell) AS BIGINT) - 1, CAST(floor((d2 + buf - y0) / cell) AS BIGINT) + 1)) AS iy) j
  WHERE pow(x0 + (ix + 0.5) * cell - (x_s + greatest(0, least(1, ((x0 + (ix + 0.5) * cell - x_s) * (x_e - x_s) + (y0 + (iy + 0.5) * cell - y_s) * (y_e - y_s)) / (pow(x_e - x_s, 2) + pow(y_e - y_s, 2)))) * (x_e - x_s)), 2)
      + pow(y0 + (iy + 0.5) * cell - (y_s + greatest(0, least(1, ((x0 + (ix + 0.5) * cell - x_s) * (x_e - x_s) + (y0 + (iy + 0.5) * cell - y_s) * (y_e - y_s)) / (pow(x_e - x_s, 2) + pow(y_e - y_s, 2)))) * (y_e - y_s)), 2) <= buf * buf)
SELECT count(*) AS n_cells, round(count(*) * max(cell) * max(cell) / max(area) * 100, 4) AS fill_rate FROM k, f"""


@query("fill_rate_lines", fill_lines_sql(), LINES)
def _(t: Inputs):
    return cover.fill_rate_lines(line_columns(t))


RECT = f"""WITH {POLY_VERTICES}, r AS (SELECT v.poly_id, any_value(zone) AS region, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM v JOIN geo_polys USING (poly_id) GROUP BY v.poly_id)
"""


@query("fill_rate_polygons", RECT + "SELECT round(sum((c - a) * (d - b)) / ((max(c) - min(a)) * (max(d) - min(b))) * 100, 4) AS fill_rate FROM r", POLYS)
def _(t: Inputs):
    return cover.fill_rate_polygons(polygons(t), "g")


@query("polygon_cells", RECT + """, f AS (SELECT min(a) AS x0, min(b) AS y0, sqrt(pow(max(c) - min(a), 2) + pow(max(d) - min(b), 2)) * 0.001::DOUBLE / 2 AS cell FROM r),
k AS (SELECT poly_id, CAST(ceil((a - x0) / cell - 0.5) AS BIGINT) AS i0, CAST(ceil((c - x0) / cell - 0.5) AS BIGINT) AS i1, CAST(ceil((b - y0) / cell - 0.5) AS BIGINT) AS j0, CAST(ceil((d - y0) / cell - 0.5) AS BIGINT) AS j1 FROM r, f)
SELECT CAST(sum((i1 - i0) * (j1 - j0)) AS BIGINT) AS n_cells FROM k""", POLYS)
def _(t: Inputs):
    ref = polygons(t)
    return cover.polygon_cells(ref, "g", cover.frame(cover.geometry_box(ref, "g"))).agg(F.count(F.lit(1)).alias("n_cells"))


@query("convex_hull_extent", "WITH " + POLY_VERTICES + ", p AS (SELECT {} AS x, {} AS y FROM v), ".format(*forward_sql(2154, "x", "y")) + hull_sql("p").replace("e AS (SELECT x -", "he AS (SELECT x -").replace("FROM e)", "FROM he)") + "SELECT round(area / 1e6::DOUBLE, 4) AS hull_km2 FROM area", POLYS)
def _(t: Inputs):
    return metrics.convex_hull_extent(metric_polygons(t), "g").select("hull_km2")


@query("coverage_envelope", RECT + """, env AS (SELECT min(longitude) AS a, min(latitude) AS b, max(longitude) AS c, max(latitude) AS d FROM geo_points)
SELECT round(sum(greatest(0, least(r.c, env.c) - greatest(r.a, env.a)) * greatest(0, least(r.d, env.d) - greatest(r.b, env.b))) / sum((r.c - r.a) * (r.d - r.b)) * 100, 4) AS coverage_pct FROM r, env""", POLYS + POINTS)
def _(t: Inputs):
    x, y = F.col("longitude"), F.col("latitude")
    return cover.coverage_envelope(polygons(t), "g", metrics.envelope_extent(t.view("geo_points"), x, y, x, y))


# the hull between its lower and upper edges, integrated over each tile: between all breaks the height is linear
HULL_COVER = """lw AS (SELECT x AS xa, y AS ya, lead(x) OVER (ORDER BY x) AS xb, lead(y) OVER (ORDER BY x) AS yb FROM lo WHERE left_slope < right_slope QUALIFY xb IS NOT NULL),
up AS (SELECT x AS xa, y AS ya, lead(x) OVER (ORDER BY x) AS xb, lead(y) OVER (ORDER BY x) AS yb FROM hi WHERE left_slope > right_slope QUALIFY xb IS NOT NULL),
hx AS (SELECT min(xa) AS h0, max(xb) AS h1 FROM lw),
sides AS (SELECT * FROM lw UNION ALL SELECT * FROM up),
rt AS (SELECT poly_id, greatest(x0, h0) AS a, least(x1, h1) AS c, CAST(y0 AS DOUBLE) AS b, CAST(y1 AS DOUBLE) AS d FROM metric_tiles, hx WHERE x0 < h1 AND x1 > h0),
bp AS (SELECT poly_id, CAST(a AS DOUBLE) AS x FROM rt UNION SELECT poly_id, c FROM rt UNION SELECT poly_id, xa FROM rt JOIN sides ON xa > a AND xa < c
  UNION SELECT poly_id, xa + (b - ya) * (xb - xa) / (yb - ya) FROM rt JOIN sides ON ya <> yb AND (ya < b) <> (yb < b) WHERE xa + (b - ya) * (xb - xa) / (yb - ya) BETWEEN a AND c
  UNION SELECT poly_id, xa + (d - ya) * (xb - xa) / (yb - ya) FROM rt JOIN sides ON ya <> yb AND (ya < d) <> (yb < d) WHERE xa + (d - ya) * (xb - xa) / (yb - ya) BETWEEN a AND c),
sg AS (SELECT poly_id, x, lead(x) OVER (PARTITION BY poly_id ORDER BY x) AS xn FROM bp),
ht AS (SELECT sg.poly_id, xn - x AS w, (x + xn) / 2 AS m FROM sg WHERE xn > x),
cut AS (SELECT coalesce(sum(w * greatest(0, least(d, u.ya + (m - u.xa) * (u.yb - u.ya) / (u.xb - u.xa)) - greatest(b, l.ya + (m - l.xa) * (l.yb - l.ya) / (l.xb - l.xa)))), 0) AS inside
  FROM ht JOIN rt USING (poly_id) JOIN up u ON m > u.xa AND m <= u.xb JOIN lw l ON m > l.xa AND m <= l.xb),
cv AS (SELECT round(inside / (SELECT sum((x1 - x0) * (y1 - y0)) FROM metric_tiles) * 100, 4) AS coverage_pct FROM cut)
"""


@query("coverage_hull", f"WITH {hull_sql('grid_points')}, {HULL_COVER} SELECT coverage_pct FROM cv", GRID + TILES)
def _(t: Inputs):
    ring = hull.convex_hull(t.view("grid_points"), F.col("x"), F.col("y"))
    return cover.coverage_hull(tiles(t), "g", ring)


@query("coverage_lines", CAST_LINES + f""", {POLY_VERTICES}, r AS (SELECT poly_id, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM v GROUP BY poly_id),
f AS (SELECT min(a) AS x0, min(b) AS y0, sqrt(pow(max(c) - min(a), 2) + pow(max(d) - min(b), 2)) * 0.001::DOUBLE AS buf, sqrt(pow(max(c) - min(a), 2) + pow(max(d) - min(b), 2)) * 0.001::DOUBLE / 2 AS cell FROM r),
k AS (SELECT DISTINCT ix, iy FROM (SELECT least(y_s, y_e) AS lo, greatest(y_s, y_e) AS hi, x_s, y_s, x_e, y_e, f.*,
  unnest(generate_series(CAST(floor((least(x_s, x_e) - buf - x0) / cell) AS BIGINT) - 1, CAST(floor((greatest(x_s, x_e) + buf - x0) / cell) AS BIGINT) + 1)) AS ix FROM c, f) s,
  LATERAL (SELECT unnest(generate_series(CAST(floor((lo - buf - y0) / cell) AS BIGINT) - 1, CAST(floor((hi + buf - y0) / cell) AS BIGINT) + 1)) AS iy) j
  WHERE pow(x0 + (ix + 0.5) * cell - (x_s + greatest(0, least(1, ((x0 + (ix + 0.5) * cell - x_s) * (x_e - x_s) + (y0 + (iy + 0.5) * cell - y_s) * (y_e - y_s)) / (pow(x_e - x_s, 2) + pow(y_e - y_s, 2)))) * (x_e - x_s)), 2)
      + pow(y0 + (iy + 0.5) * cell - (y_s + greatest(0, least(1, ((x0 + (ix + 0.5) * cell - x_s) * (x_e - x_s) + (y0 + (iy + 0.5) * cell - y_s) * (y_e - y_s)) / (pow(x_e - x_s, 2) + pow(y_e - y_s, 2)))) * (y_e - y_s)), 2) <= buf * buf),
g AS (SELECT CAST(ceil((a - x0) / cell - 0.5) AS BIGINT) AS i0, CAST(ceil((c - x0) / cell - 0.5) AS BIGINT) AS i1, CAST(ceil((b - y0) / cell - 0.5) AS BIGINT) AS j0, CAST(ceil((d - y0) / cell - 0.5) AS BIGINT) AS j1 FROM r, f)
SELECT round((SELECT count(*) FROM k WHERE EXISTS (SELECT 1 FROM g WHERE ix >= i0 AND ix < i1 AND iy >= j0 AND iy < j1)) * max(cell) * max(cell) / (SELECT sum((c - a) * (d - b)) FROM r) * 100, 4) AS coverage_pct FROM f""", LINES + POLYS)
def _(t: Inputs):
    segs = line_columns(t)
    ref = polygons(t)
    f = cover.frame(cover.geometry_box(ref, "g"))
    return cover.coverage_cells(ref, "g", cover.buffered_cells(segs, f), f)


OVERLAP = """SELECT EXISTS (SELECT 1 FROM q p JOIN q s ON p.poly_id < s.poly_id AND p.a < s.c AND s.a < p.c AND p.b < s.d AND s.b < p.d) AS overlaps"""


@query("reference_overlap_check", RECT + ", q AS (SELECT * FROM r) " + OVERLAP, POLYS)
def _(t: Inputs):
    return cover.reference_overlap_check(polygons(t), "g")


@query("reference_overlap_found", RECT + ", q AS (SELECT * REPLACE (CASE WHEN poly_id % 7 = 0 THEN c + 1 ELSE c END AS c) FROM r) " + OVERLAP, POLYS)
def _(t: Inputs):
    rows = polygons(t).select("poly_id", G.bbox(F.col("g")).alias("b")).select("poly_id", "b.*")
    wide = rows.withColumn("maxx", F.when(F.col("poly_id") % 7 == 0, F.col("maxx") + 1).otherwise(F.col("maxx")))
    return cover.reference_overlap_check(wide.select(G.line(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("g")), "g")


@query("complexity", """
WITH s AS (SELECT CAST(5 AS BIGINT) AS n FROM geo_polys UNION ALL SELECT len(regexp_extract_all(shape, '[0-9]+ [0-9]+')) FROM geo_json WHERE shape LIKE 'LINESTRING%')
SELECT round(avg(n), 2) AS mean_vertices, round(stddev_pop(n), 2) AS std_vertices, CAST(NULL AS VARCHAR) AS note FROM s""", POLYS + ("geo_json",))
def _(t: Inputs):
    shapes = locate.add_geometry(t.view("geo_json"), "from_wkt", ["shape"], "g").select("g")
    return metrics.complexity(polygons(t).select("g").unionByName(shapes), "g")


@query("complexity_points", "SELECT CAST(NULL AS DOUBLE) AS mean_vertices, CAST(NULL AS DOUBLE) AS std_vertices, 'None : POINT' AS note FROM geo_points LIMIT 1", POINTS)
def _(t: Inputs):
    return metrics.complexity(points(t), "g")


DUPLICATES = """SELECT count(*) AS n_total, count(DISTINCT ({k})) AS n_unique, count(*) - count(DISTINCT ({k})) AS n_duplicates, round((count(*) - count(DISTINCT ({k}))) * 100.0::DOUBLE / count(*), 2) AS duplicate_pct"""


@query("duplicates_exact", DUPLICATES.format(k="concat(longitude, ' ', latitude)") + " FROM geo_points WHERE longitude IS NOT NULL AND latitude IS NOT NULL", POINTS)
def _(t: Inputs):
    return metrics.duplicates_exact(points(t).where("g IS NOT NULL"), "g")


@query("duplicates_sampled", "WITH s AS (SELECT * FROM geo_points ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 1000) "
       + DUPLICATES.format(k="coalesce(concat(longitude || '', ' ', latitude || ''), '')").replace("concat(longitude || '', ' ', latitude || '')", "longitude || ' ' || latitude")
       + ", (SELECT count(*) FROM geo_points) > 1000 AS sampled FROM s", POINTS)
def _(t: Inputs):
    return metrics.duplicates_sampled(points(t), G.as_wkt(F.col("g")), "event_id")


@query("duplicate_coordinate_rows", DUPLICATES.format(k="concat(x, ' ', y)") + " FROM grid_points", GRID)
def _(t: Inputs):
    return metrics.duplicate_coordinate_rows(t.view("grid_points"), "event_id", "x", "y")


@query("first_of_coordinates", "SELECT x, y, min(event_id) AS event_id FROM grid_points GROUP BY x, y", GRID)
def _(t: Inputs):
    return metrics.first_of_coordinates(t.view("grid_points"), "event_id", "x", "y")


@query("sample_unique_coordinates", """
WITH k AS (SELECT min(event_id) AS event_id FROM grid_points GROUP BY x, y ORDER BY md5(CAST(min(event_id) AS VARCHAR)), min(event_id) LIMIT 5000)
SELECT * FROM grid_points WHERE event_id IN (SELECT event_id FROM k)""", GRID)
def _(t: Inputs):
    return metrics.sample_unique_coordinates(t.view("grid_points"), "event_id", ["x", "y"])


def variation_sql(source: str, size: str = "50000.0::DOUBLE") -> str:
    """``source`` gives feature boxes a, b, c, d; every grid cell is joined and counted."""
    return f"""g AS (SELECT min(a) AS x0, min(b) AS y0, CAST(ceil((max(c) - min(a)) / {size}) AS BIGINT) AS nx, CAST(ceil((max(d) - min(b)) / {size}) AS BIGINT) AS ny FROM {source}),
cells AS (SELECT x0 + ix * {size} AS cx, y0 + iy * {size} AS cy FROM g, LATERAL (SELECT unnest(generate_series(0, nx - 1)) AS ix), LATERAL (SELECT unnest(generate_series(0, ny - 1)) AS iy)),
k AS (SELECT cx, cy, count(s.a) AS n FROM cells LEFT JOIN {source} s ON s.a <= cx + {size} AND s.c >= cx AND s.b <= cy + {size} AND s.d >= cy GROUP BY cx, cy)
SELECT round(stddev_pop(n) / avg(n) * 100, 2) AS cv_pct, round(avg(n), 2) AS mean_per_cell, round(stddev_pop(n), 2) AS std_per_cell, round(count(*) FILTER (n > 0) * 100.0::DOUBLE / count(*), 2) AS occupied_pct,
count(*) AS n_cells, {size} / 1000 AS cell_km, CASE WHEN stddev_pop(n) / avg(n) * 100 < 50 THEN 'Distribution reguliere' WHEN stddev_pop(n) / avg(n) * 100 < 100 THEN 'Distribution moderement irreguliere' ELSE 'Distribution tres irreguliere (clustered)' END AS interpretation FROM k"""


@query("grid_variation", "WITH s AS (SELECT CAST(x AS DOUBLE) AS a, CAST(y AS DOUBLE) AS b, CAST(x AS DOUBLE) AS c, CAST(y AS DOUBLE) AS d FROM grid_points), " + variation_sql("s"), GRID)
def _(t: Inputs):
    return metrics.grid_variation_points(t.view("grid_points"), "x", "y")


@query("grid_variation_polygons", RECT + ", s AS (SELECT a, b, c, d FROM r), " + variation_sql("s", "1.817::DOUBLE"), POLYS)
def _(t: Inputs):
    return metrics.grid_variation_geometry(polygons(t), "g", 1.817)


# ------------------------------------------------------------------- neighbours

# the k nearest rows by squared distance and id, packed into one integer for the ordered minimum
KNN = """e AS (SELECT src, unnest(m) % 1000000 AS dst FROM (SELECT a.event_id AS src, min(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 1000000 + b.event_id, 4) AS m
  FROM grid_points a, grid_points b WHERE a.event_id <> b.event_id GROUP BY a.event_id))
"""


@query("moran_knn", f"""WITH {KNN}, s AS (SELECT avg(value) AS m, count(*) AS n FROM grid_points), z AS (SELECT event_id, value - m AS z FROM grid_points, s),
l AS (SELECT src, avg(z) AS lag FROM e JOIN z ON dst = event_id GROUP BY src)
SELECT round(sum(z * lag) / sum(z * z), 4) AS moran_i, round(-1.0::DOUBLE / (count(*) - 1), 4) AS expected_i, count(*) AS n FROM z JOIN l ON src = event_id""", GRID)
def _(t: Inputs):
    return neighbours.moran_knn(t.view("grid_points"), "event_id", "x", "y", "value")


@query("knn_edges", f"""WITH {KNN} SELECT src, dst, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance FROM e JOIN grid_points a ON a.event_id = src JOIN grid_points b ON b.event_id = dst""", GRID)
def _(t: Inputs):
    return neighbours.knn_edges(t.view("grid_points"), "event_id", "x", "y").select("src", "dst", F.round("distance", 4).alias("distance"))


def valued_polygons(t: Inputs):
    """The tiles with a value, the size of their part."""
    value = t.table("part").select(F.col("p_partkey").cast("int").alias("poly_id"), F.col("p_size").cast("double").alias("value"))
    return polygons(t).join(value, "poly_id").select("poly_id", "g", "value")


@query("moran_queen", f"""WITH {POLY_VERTICES}, w AS (SELECT DISTINCT a.poly_id AS src, b.poly_id AS dst FROM v a JOIN v b ON a.x = b.x AND a.y = b.y AND a.poly_id <> b.poly_id),
p AS (SELECT poly_id, CAST(p_size AS DOUBLE) AS value FROM geo_polys JOIN part ON p_partkey = poly_id),
s AS (SELECT avg(value) AS m FROM p), z AS (SELECT poly_id, value - m AS z FROM p, s), l AS (SELECT src, avg(z) AS lag FROM w JOIN z ON dst = poly_id GROUP BY src)
SELECT round(count(*) * sum(z * lag) / (count(lag) * sum(z * z)), 4) AS moran_i, round(-1.0::DOUBLE / (count(*) - 1), 4) AS expected_i, count(*) AS n FROM z LEFT JOIN l ON src = poly_id""", POLYS)
def _(t: Inputs):
    return neighbours.moran_queen(valued_polygons(t), "g", "value")


def significance_sql(permutations: int = 999, seed: int = neighbours.SEED) -> str:
    """CTEs from ``nd`` (id, z) and ``ed`` (src, dst, w), weights of each row adding up to one, to the test's row ``sig``."""
    draw = lambda what: f"CAST(concat('0x', left(md5(concat('{seed}:', r, ':{what}')), 8)) AS BIGINT)"
    return f"""ni AS MATERIALIZED (SELECT id, z, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS idx FROM nd),
ex AS MATERIALIZED (SELECT src, dst, w FROM ed),
cn AS MATERIALIZED (SELECT count(*) AS n, sum(z * z) AS den, (SELECT count(DISTINCT src) FROM ex) AS s0 FROM ni),
dr AS (SELECT r, 1 + {draw('a')} % greatest(1, least(n - 1, 4611686018427387904 // n)) AS a0, {draw('b')} % n AS b FROM cn, range(1, {permutations + 1}) q(r)),
mp AS MATERIALIZED (SELECT 0 AS r, 1 AS a, 0 AS b UNION ALL SELECT r, min(a0 + j), any_value(b) FROM dr, range(0, 200) q(j), cn WHERE gcd(a0 + j, n) = 1 GROUP BY r),
ei AS MATERIALIZED (SELECT s.idx AS si, d.idx AS di, w FROM ex JOIN ni s ON s.id = src JOIN ni d ON d.id = dst),
pr AS (SELECT r, w, (a * si + b) % n AS sx, (a * di + b) % n AS dx FROM mp, ei, (SELECT n FROM cn)),
im AS MATERIALIZED (SELECT r, max(n) * sum(w * s.z * d.z) / (max(s0) * max(den)) AS i FROM pr JOIN ni s ON s.idx = sx JOIN ni d ON d.idx = dx, (SELECT n, s0, den FROM cn) GROUP BY r),
ob AS (SELECT i FROM im WHERE r = 0),
st AS (SELECT ob.i, avg(im.i) AS mean, stddev_pop(im.i) AS std, count(*) FILTER (im.i >= ob.i - abs(ob.i) * 1e-9) AS larger FROM im, ob WHERE r > 0 GROUP BY ob.i),
pv_ AS (SELECT *, (least(larger, {permutations} - larger) + 1) / {permutations + 1}::DOUBLE AS p FROM st),
sig AS (SELECT round(i, 4) AS moran_i, round(-1.0::DOUBLE / (n - 1), 4) AS expected_i, round(p, 4) AS p_value, round((i - mean) / std, 4) AS z_score,
  CASE WHEN p >= 0.05 THEN '{neighbours.RANDOM}' WHEN i > 0 THEN '{neighbours.POSITIVE}' ELSE '{neighbours.NEGATIVE}' END AS interpretation, n FROM pv_, cn)"""


KNN_NODES = f"""{KNN.strip()}, nd AS (SELECT event_id AS id, value - (SELECT avg(value) FROM grid_points) AS z FROM grid_points), ed AS (SELECT src, dst, 0.25::DOUBLE AS w FROM e)"""
# tiles are neighbours if they have a corner in common
QUEEN_NODES = """tv AS (SELECT poly_id, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM {tiles}),
nd AS (SELECT poly_id AS id, value - (SELECT avg(value) FROM {tiles}) AS z FROM {tiles}),
qe AS (SELECT DISTINCT a.poly_id AS src, b.poly_id AS dst FROM tv a JOIN tv b USING (x, y) WHERE a.poly_id <> b.poly_id), ed AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM qe)"""


@query("moran_significance", f"WITH {KNN_NODES}, {significance_sql()} SELECT * FROM sig", GRID)
def _(t: Inputs):
    return neighbours.moran_significance(t.view("grid_points"), "event_id", "x", "y", "value")


@query("moran_queen_significance", f"WITH {QUEEN_NODES.format(tiles='metric_tiles')}, {significance_sql()} SELECT * FROM sig", TILES)
def _(t: Inputs):
    return neighbours.moran_queen_significance(tiles(t), "poly_id", "g", "value")


# ------------------------------------------------------------------ metric rows

def metric_row_sql(kind: str, epsg: str, coverage: str, source: str) -> str:
    """``source`` gives n, n_valid, n_distinct, the envelope a..d and the centroid box ca..cd, complexity."""
    return f"""SELECT n AS n_objects, {epsg} AS crs, '{kind}' AS geometry_types, round(100.0::DOUBLE, 1) AS present_pct, round(n_valid * 100.0::DOUBLE / n, 1) AS valid_pct, round((c - a) * (d - b) / 1e6::DOUBLE, 2) AS extent_km2,
round(n / ((c - a) * (d - b) / 1e6::DOUBLE), 2) AS density, round((c - a) * (d - b) / ((cc - ca) * (cd - cb)) * 100, 2) AS fill_rate_pct, round(complexity, 2) AS complexity,
round((n - n_distinct) * 100.0::DOUBLE / n, 2) AS duplicate_pct, {coverage} AS coverage_pct FROM {source}"""


@query("profile_points", f"WITH {METRIC_POINTS}, q AS (SELECT count(*) AS n, count(*) AS n_valid, count(DISTINCT concat(longitude, ' ', latitude)) AS n_distinct, min(mx) AS a, min(my) AS b, max(mx) AS c, max(my) AS d, min(mx) AS ca, min(my) AS cb, max(mx) AS cc, max(my) AS cd, CAST(NULL AS DOUBLE) AS complexity FROM f), "
       + f"g AS ({guess_sql('longitude', 'latitude', 'geo_points')}) " + metric_row_sql("Point", "(SELECT concat('EPSG:', epsg) FROM g)", "CAST(NULL AS DOUBLE)", "q"), POINTS)
def _(t: Inputs):
    return profile_points(t.view("geo_points"), "longitude", "latitude")


ENVELOPE_COVER = """round((SELECT sum(greatest(0, least(x1, c) - greatest(x0, a)) * greatest(0, least(y1, d) - greatest(y0, b))) FROM metric_tiles) / (SELECT sum((x1 - x0) * (y1 - y0)) FROM metric_tiles) * 100, 2)"""


@query("profile_points_coverage", f"WITH {METRIC_POINTS}, q AS (SELECT count(*) AS n, count(*) AS n_valid, count(DISTINCT concat(longitude, ' ', latitude)) AS n_distinct, min(mx) AS a, min(my) AS b, max(mx) AS c, max(my) AS d, min(mx) AS ca, min(my) AS cb, max(mx) AS cc, max(my) AS cd, CAST(NULL AS DOUBLE) AS complexity FROM f) "
       + metric_row_sql("Point", "'EPSG:4326'", ENVELOPE_COVER, "q"), POINTS + TILES)
def _(t: Inputs):
    return profile_points(t.view("geo_points"), "longitude", "latitude", territory=territory(t))


SRC = Rules(source_units=True, digits=10)


@query("profile_points_source_units", f"""WITH {METRIC_POINTS} SELECT count(*) AS n_objects, round((max(longitude) - min(longitude)) * (max(latitude) - min(latitude)) / 1e6::DOUBLE, 10) AS extent_km2, round(count(*) / ((max(longitude) - min(longitude)) * (max(latitude) - min(latitude)) / 1e6::DOUBLE), 4) AS density FROM f""", POINTS)
def _(t: Inputs):
    row = profile_points(t.view("geo_points"), "longitude", "latitude", SRC)
    return row.select("n_objects", "extent_km2", F.round("density", 4).alias("density"))


SX, SY = forward_sql(2154, "x_s", "y_s")
EX, EY = forward_sql(2154, "x_e", "y_e")


LINE_STATS = CAST_LINES + f""", m AS (SELECT *, {SX} AS ax, {SY} AS ay, {EX} AS bx, {EY} AS by_ FROM c WHERE x_s BETWEEN -5.5 AND 10.0 AND y_s BETWEEN 41.0 AND 51.5),
q AS (SELECT count(*) AS n, count(*) FILTER (x_s <> x_e OR y_s <> y_e) AS n_valid, count(DISTINCT concat_ws(' ', x_s, y_s, x_e, y_e)) AS n_distinct, min(least(ax, bx)) AS a, min(least(ay, by_)) AS b, max(greatest(ax, bx)) AS c, max(greatest(ay, by_)) AS d,
min((ax + bx) / 2) AS ca, min((ay + by_) / 2) AS cb, max((ax + bx) / 2) AS cc, max((ay + by_) / 2) AS cd, 2.0::DOUBLE AS complexity FROM m) """


@query("profile_lines", LINE_STATS + metric_row_sql("LineString", "'EPSG:4326'", "CAST(NULL AS DOUBLE)", "q"), LINES)
def _(t: Inputs):
    return profile_lines(t.view("geo_lines"), ["xD", "yD", "xF", "yF"])


PX, PY = forward_sql(2154, "x", "y")


@query("profile_geometry", f"WITH {POLY_VERTICES}" + f""", inside AS (SELECT poly_id FROM v GROUP BY poly_id HAVING (min(x) + max(x)) / 2 BETWEEN -5.5 AND 10.0 AND (min(y) + max(y)) / 2 BETWEEN 41.0 AND 51.5), mv AS (SELECT poly_id, i, {PX} AS x, {PY} AS y FROM v JOIN inside USING (poly_id)), me AS (SELECT poly_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM mv WINDOW w AS (PARTITION BY poly_id ORDER BY i)),
o AS (SELECT poly_id, arg_min(x, i) AS ox, arg_min(y, i) AS oy FROM mv GROUP BY poly_id),
ac AS (SELECT me.poly_id, ox + sum(((x - ox) + (x2 - ox)) * ((x - ox) * (y2 - oy) - (x2 - ox) * (y - oy))) / (3 * sum((x - ox) * (y2 - oy) - (x2 - ox) * (y - oy))) AS cx,
  oy + sum(((y - oy) + (y2 - oy)) * ((x - ox) * (y2 - oy) - (x2 - ox) * (y - oy))) / (3 * sum((x - ox) * (y2 - oy) - (x2 - ox) * (y - oy))) AS cy FROM me JOIN o USING (poly_id) WHERE x2 IS NOT NULL GROUP BY me.poly_id, ox, oy),
q AS (SELECT (SELECT count(*) FROM inside) AS n, (SELECT count(*) FROM inside) AS n_valid, (SELECT count(*) FROM inside) AS n_distinct, (SELECT min(x) FROM mv) AS a, (SELECT min(y) FROM mv) AS b, (SELECT max(x) FROM mv) AS c, (SELECT max(y) FROM mv) AS d,
min(cx) AS ca, min(cy) AS cb, max(cx) AS cc, max(cy) AS cd, 5.0::DOUBLE AS complexity FROM ac) """ + metric_row_sql("Polygon", "'EPSG:4326'", "CAST(NULL AS DOUBLE)", "q"), POLYS)
def _(t: Inputs):
    return profile_geometry(polygons(t), "g")


# a tenth of the texts can't be read; all lines lie inside the bounds
@query("profile_geometry_text", """
WITH s AS (SELECT s_suppkey % 10 <> 9 AS ok, shape FROM geo_json)
SELECT count(*) FILTER (ok) AS n_objects, 'LineString' AS geometry_types, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 1) AS present_pct, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 1) AS valid_pct, 3.0::DOUBLE AS complexity,
round((count(*) FILTER (ok) - count(DISTINCT shape) FILTER (ok)) * 100.0::DOUBLE / count(*) FILTER (ok), 2) AS duplicate_pct FROM s""", ("geo_json",))
def _(t: Inputs):
    shapes = locate.add_geometry(t.view("geo_json"), "from_wkt", ["shape"], "g")
    return profile_geometry(shapes, "g").select("n_objects", "geometry_types", "present_pct", "valid_pct", "complexity", "duplicate_pct")


@query("default_geo_profile", """
SELECT count(*) AS n_objects, CAST(NULL AS VARCHAR) AS crs, CAST(NULL AS VARCHAR) AS geometry_types, CAST(NULL AS DOUBLE) AS present_pct, CAST(NULL AS DOUBLE) AS valid_pct, CAST(NULL AS DOUBLE) AS extent_km2, CAST(NULL AS DOUBLE) AS density,
CAST(NULL AS DOUBLE) AS fill_rate_pct, CAST(NULL AS DOUBLE) AS complexity, CAST(NULL AS DOUBLE) AS duplicate_pct, CAST(NULL AS DOUBLE) AS coverage_pct FROM grid_points WHERE x BETWEEN -5.5 AND 10 AND y BETWEEN 41 AND 51.5""", GRID)
def _(t: Inputs):
    # metric coordinates under the rule that filters by WGS84 bounds whatever the CRS: nothing is left
    row = profile_points(t.view("grid_points"), "x", "y", Rules(always_filter=True))
    return row.select(*default_geo_profile(t.spark).columns)


def flat_metrics(df):
    """The structs of all metrics as columns; the counts of rows are the same everywhere."""
    return df.select(
        "fill.fill_rate", "complexity.mean_vertices", "complexity.std_vertices", "complexity.note", "duplicates.n_total", "duplicates.n_unique", "duplicates.duplicate_pct",
        "variation.cv_pct", "variation.mean_per_cell", "variation.occupied_pct", "variation.n_cells", F.col("variation.interpretation").alias("distribution"), "coverage.coverage_pct",
        "moran.moran_i", "moran.expected_i", "moran.p_value", "moran.z_score", F.col("moran.interpretation").alias("reading"), "kinds.other",
    )


@query("compute_all_metrics", f"""WITH {hull_sql('grid_points')}, {HULL_COVER}, {KNN_NODES.replace('e AS (SELECT src', 'ke AS (SELECT src').replace('AS w FROM e)', 'AS w FROM ke)')}, {significance_sql()},
s AS (SELECT CAST(x AS DOUBLE) AS a, CAST(y AS DOUBLE) AS b, CAST(x AS DOUBLE) AS c, CAST(y AS DOUBLE) AS d FROM grid_points), vr AS (WITH {variation_sql("s")})
SELECT (SELECT round(area / (SELECT (max(x) - min(x)) * (max(y) - min(y)) FROM grid_points) * 100, 4) FROM area) AS fill_rate, CAST(NULL AS DOUBLE) AS mean_vertices, CAST(NULL AS DOUBLE) AS std_vertices, 'None : POINT' AS note,
 (SELECT count(*) FROM grid_points) AS n_total, (SELECT count(DISTINCT (x, y)) FROM grid_points) AS n_unique, (SELECT round((count(*) - count(DISTINCT (x, y))) * 100.0::DOUBLE / count(*), 2) FROM grid_points) AS duplicate_pct,
 cv_pct, mean_per_cell, occupied_pct, n_cells, vr.interpretation AS distribution, coverage_pct, moran_i, expected_i, p_value, z_score, sig.interpretation AS reading, CAST(0 AS BIGINT) AS other FROM vr, cv, sig""", GRID + TILES)
def _(t: Inputs):
    df = t.view("grid_points").select("event_id", "value", G.point(F.col("x"), F.col("y")).alias("g"))
    return flat_metrics(compute_all_metrics(df, "event_id", "g", territory(t), "value"))


@query("compute_all_metrics_polygons", f"""WITH td AS (SELECT poly_id, value, x0 + 2500 AS x0, x1 + 2500 AS x1, y0 + 1000 AS y0, y1 + 1000 AS y1 FROM metric_tiles WHERE poly_id % 3 <> 0), {QUEEN_NODES.format(tiles='td')}, {significance_sql()},
s AS (SELECT CAST(x0 AS DOUBLE) AS a, CAST(y0 AS DOUBLE) AS b, CAST(x1 AS DOUBLE) AS c, CAST(y1 AS DOUBLE) AS d FROM td), vr AS (WITH {variation_sql("s")}),
fr AS (SELECT min(a) AS fx, min(b) AS fy, max(c) AS gx, max(d) AS gy, sqrt(pow(max(c) - min(a), 2) + pow(max(d) - min(b), 2)) * 0.001::DOUBLE / 2 AS cell FROM s),
cr AS (SELECT layer, CAST(ceil((a - fx) / cell - 0.5) AS BIGINT) AS i0, CAST(ceil((c - fx) / cell - 0.5) AS BIGINT) AS i1, CAST(ceil((b - fy) / cell - 0.5) AS BIGINT) AS j0, CAST(ceil((d - fy) / cell - 0.5) AS BIGINT) AS j1
  FROM (SELECT 0 AS layer, a, b, c, d FROM s UNION ALL SELECT 1, x0, y0, x1, y1 FROM metric_tiles), fr),
ce AS (SELECT DISTINCT layer, ix, iy FROM cr, LATERAL (SELECT unnest(range(i0, i1)) AS ix) p, LATERAL (SELECT unnest(range(j0, j1)) AS iy) q),
hit AS (SELECT count(*) AS n FROM (SELECT ix, iy FROM ce GROUP BY ix, iy HAVING count(*) = 2))
SELECT (SELECT round(sum((c - a) * (d - b)) / ((max(c) - min(a)) * (max(d) - min(b))) * 100, 4) FROM s) AS fill_rate, 5.0::DOUBLE AS mean_vertices, 0.0::DOUBLE AS std_vertices, CAST(NULL AS VARCHAR) AS note,
 (SELECT count(*) FROM s) AS n_total, (SELECT count(*) FROM s) AS n_unique, 0.0::DOUBLE AS duplicate_pct, cv_pct, mean_per_cell, occupied_pct, n_cells, vr.interpretation AS distribution,
 round(hit.n * cell * cell / (SELECT sum((x1 - x0) * (y1 - y0)) FROM metric_tiles) * 100, 4) AS coverage_pct, moran_i, expected_i, p_value, z_score, sig.interpretation AS reading, CAST(0 AS BIGINT) AS other FROM vr, sig, hit, fr""", TILES)
def _(t: Inputs):
    return flat_metrics(compute_all_metrics(tiles(t, 2500, 1000).where("poly_id % 3 <> 0"), "poly_id", "g", territory(t), "value"))
