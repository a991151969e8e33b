"""Spatial quality metrics (group H, without neighbour graphs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraprofile.functions import geometry as G
from terraprofile.operators.clean import col
from terraprofile.operators.hull import convex_hull, vertex_rows
from terraprofile.operators.selection import sample_rows

GRID_SIZE = 50000.0
DUPLICATE_SAMPLE = 1000
UNIQUE_SAMPLE = 5000
POINT_COMPLEXITY = "None : POINT"


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def presence_validity(df: DataFrame, geometry: str) -> DataFrame:
    """Share of rows with a geometry, and with a valid one, in percent."""
    g = col(geometry)
    rows = df.select((G.present(g)).alias("present"), G.is_valid(g).alias("valid"))
    return rows.agg(
        F.round(_safe(F.count_if("present") * 100.0, F.count(F.lit(1))), 1).alias("present_pct"),
        F.round(_safe(F.count_if("valid") * 100.0, F.count(F.lit(1))), 1).alias("valid_pct"),
    )


def envelope_extent(df: DataFrame, minx: Column, miny: Column, maxx: Column, maxy: Column) -> DataFrame:
    """Envelope of all boxes and its area in square kilometres."""
    return df.select(minx.alias("a"), miny.alias("b"), maxx.alias("c"), maxy.alias("d")).agg(
        F.min("a").alias("minx"), F.min("b").alias("miny"), F.max("c").alias("maxx"), F.max("d").alias("maxy"),
        ((F.max("c") - F.min("a")) * (F.max("d") - F.min("b")) / 1e6).alias("extent_km2"),
        F.count("a").alias("n"),
    )


def density(n: Column, extent_km2: Column) -> Column:
    return F.when(extent_km2 > 0, n / extent_km2).otherwise(0.0)


def fill_rate_bbox(extent_km2: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Extent over the box of centroids, in percent; 0 for a degenerate box."""
    box = (maxx - minx) * (maxy - miny) / 1e6
    return F.when((maxx > minx) & (maxy > miny), extent_km2 / box * 100).otherwise(0.0)


def fill_rate_points(df: DataFrame, x: str, y: str, hull: DataFrame | None = None) -> DataFrame:
    """Convex hull over bounding box, in percent.

    Fewer than three points or non-finite coordinates give 0, a box narrower
    than a micrometre 100.
    """
    finite = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")))
    pts = df.select(col(x).alias("x"), col(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    hull = hull if hull is not None else convex_hull(pts.where(finite(F.col("x")) & finite(F.col("y"))), F.col("x"), F.col("y"))
    box = pts.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(finite(F.col("x")) & finite(F.col("y"))).alias("finite"),
        (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"),
    )
    area = hull.select("area").scalar()
    rate = (
        F.when((F.col("n") == 0) | ~F.col("finite"), 0.0)
        .when((F.col("w") < 1e-6) | (F.col("h") < 1e-6), 100.0)
        .when(F.col("n") < 3, 0.0)
        .otherwise(area / (F.col("w") * F.col("h")) * 100)
    )
    return box.select("n", F.round(rate, 4).alias("fill_rate"))


def convex_hull_extent(df: DataFrame, geometry: str) -> DataFrame:
    """Hull of every vertex: number of hull vertices and area in square kilometres."""
    v = vertex_rows(df, col(geometry))
    return convex_hull(v, F.col("x"), F.col("y")).select("n_vertices", F.round(F.col("area") / 1e6, 4).alias("hull_km2"))


def complexity(df: DataFrame, geometry: str) -> DataFrame:
    """Mean and spread of vertex counts over non-empty geometries; points have none."""
    g = col(geometry)
    rows = df.where(G.present(g)).select(G.vertex_count(g).alias("n"), g["kind"].alias("kind"))
    points = F.coalesce(F.min("kind") == "POINT", F.lit(False)) & F.coalesce(F.max("kind") == "POINT", F.lit(False))
    return rows.agg(
        F.when(~points, F.round(F.avg("n"), 2)).alias("mean_vertices"),
        F.when(~points, F.round(F.stddev_pop("n"), 2)).alias("std_vertices"),
        F.when(points, F.lit(POINT_COMPLEXITY)).alias("note"),
    )


def duplicates(df: DataFrame, *keys: Column, approximate: bool = False) -> DataFrame:
    """Share of rows beyond the first of each distinct value, in percent; NULL is a value."""
    flagged = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    distinct = F.approx_count_distinct(F.xxhash64(*keys)) if approximate else F.countDistinct(flagged)
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_total"), distinct.alias("n_unique")).select(
        "n_total", "n_unique", (F.col("n_total") - F.col("n_unique")).alias("n_duplicates"),
        F.round(_safe((F.col("n_total") - F.col("n_unique")) * 100.0, F.col("n_total")), 2).alias("duplicate_pct"),
    )


def geometry_key(g: Column) -> Column:
    """A fixed-size stand-in for a geometry's text, so long shapes do not cross the shuffle."""
    return F.sha2(G.as_wkt(g), 256)


def duplicates_exact(df: DataFrame, geometry: str) -> DataFrame:
    return duplicates(df, geometry_key(col(geometry)))


def duplicates_sampled(df: DataFrame, geometry: Column, key: str, n: int = DUPLICATE_SAMPLE) -> DataFrame:
    """:func:`duplicates` on at most ``n`` rows, saying whether that was a sample."""
    rows = df.select(col(key).alias("key"), geometry.alias("g"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return duplicates(sample_rows(rows, "key", n), F.col("g")).select("*", (total > n).alias("sampled"))


def duplicate_coordinate_rows(df: DataFrame, key: str, *coordinates: str) -> DataFrame:
    """Share of rows whose coordinates occur in an earlier row, in percent."""
    return duplicates(df, *[col(c) for c in coordinates])


def first_of_coordinates(df: DataFrame, key: str, *coordinates: str) -> DataFrame:
    """Per distinct coordinates the key of the first row; partial sums tame repeated places."""
    return df.groupBy(*[col(c) for c in coordinates]).agg(F.min(col(key)).alias(key))


def sample_unique_coordinates(df: DataFrame, key: str, coordinates: list[str], n: int = UNIQUE_SAMPLE) -> DataFrame:
    """Full rows of at most ``n`` rows with different coordinates."""
    kept = sample_rows(first_of_coordinates(df, key, *coordinates).select(col(key)), key, n)
    return df.join(kept, key, "left_semi")


# ------------------------------------------------------------------------- grid

def touched_cells(lo: Column, hi: Column, origin: Column, size: float, n: Column) -> Column:
    """Indices of the cells a closed range touches; an edge belongs to both sides."""
    a, b = (lo - origin) / size, (hi - origin) / size
    first = F.greatest(F.ceil(a) - 1, F.lit(0))
    last = F.least(F.floor(b), n - 1)
    return F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def _touches(edges: Column, polygonal: Column, x0: Column, y0: Column, size: float) -> Column:
    """Whether a shape's edges or inside meet a square cell."""
    x1, y1 = x0 + size, y0 + size

    def meets(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        apart = (F.least(ax, bx) > x1) | (F.greatest(ax, bx) < x0) | (F.least(ay, by) > y1) | (F.greatest(ay, by) < y0)
        cross = lambda px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        corners = [cross(px, py) for px in (x0, x1) for py in (y0, y1)]
        return ~apart & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    crossings = F.size(
        F.filter(
            edges,
            lambda e: ((e["a"]["y"] <= y0) != (e["b"]["y"] <= y0))
            & (e["a"]["x"] + (y0 - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]) > x0),
        )
    )
    return F.exists(edges, meets) | (polygonal & (crossings % 2 == 1))


def _grid_scalar(box: DataFrame, size: float) -> Column:
    cells = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / size)
    return box.select(F.struct("minx", "miny", cells("minx", "maxx").alias("nx"), cells("miny", "maxy").alias("ny")).alias("g")).scalar()


def cell_counts_points(df: DataFrame, x: str, y: str, size: float = GRID_SIZE) -> tuple[DataFrame, Column]:
    """Features per touched cell, and the grid as a scalar."""
    pts = df.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    box = pts.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    grid = _grid_scalar(box, size)
    placed = pts.select("x", "y", grid.alias("g"))
    ix = touched_cells(F.col("x"), F.col("x"), F.col("g.minx"), size, F.col("g.nx"))
    iy = touched_cells(F.col("y"), F.col("y"), F.col("g.miny"), size, F.col("g.ny"))
    cells = placed.select(ix.alias("xs"), iy.alias("ys")).select(F.explode("xs").alias("ix"), "ys").select("ix", F.explode("ys").alias("iy"))
    return cells.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("c")), grid


def cell_counts_geometry(df: DataFrame, geometry: str, size: float = GRID_SIZE) -> tuple[DataFrame, Column]:
    """The same for lines and polygons, with an exact test per candidate cell."""
    g = col(geometry)
    rows = df.where(G.present(g)).select(
        F.flatten(F.transform(F.flatten(g["parts"]), G.steps)).alias("edges"), g["kind"].isin("POLYGON", "MULTIPOLYGON").alias("solid"), G.bbox(g).alias("b")
    )
    box = rows.agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))
    grid = _grid_scalar(box, size)
    placed = rows.select("*", grid.alias("g"))
    ix = touched_cells(F.col("b.minx"), F.col("b.maxx"), F.col("g.minx"), size, F.col("g.nx"))
    iy = touched_cells(F.col("b.miny"), F.col("b.maxy"), F.col("g.miny"), size, F.col("g.ny"))
    cells = placed.select("*", F.explode(ix).alias("ix")).select("*", F.explode(iy).alias("iy")).where(
        _touches(F.col("edges"), F.col("solid"), F.col("g.minx") + F.col("ix") * size, F.col("g.miny") + F.col("iy") * size, size)
    )
    return cells.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("c")), grid


# Reading of the variation coefficient.
VARIATION_LABELS = [
    (50.0, "Distribution reguliere"),
    (100.0, "Distribution moderement irreguliere"),
    (None, "Distribution tres irreguliere (clustered)"),
]


def grid_variation(counts: DataFrame, grid: Column, size: float = GRID_SIZE) -> DataFrame:
    """Variation of features per cell; empty cells enter by arithmetic, not as rows."""
    sums = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("s"),
        F.coalesce(F.sum(F.col("c").cast("double") * F.col("c")), F.lit(0.0)).alias("ss"),
        F.count(F.lit(1)).alias("occupied"),
    ).select("*", (grid["nx"] * grid["ny"]).alias("n"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    std = F.sqrt(F.greatest(F.try_divide(F.col("ss"), F.col("n")) - mean * mean, F.lit(0.0)))
    rows = sums.select("n", "occupied", mean.alias("mean"), std.alias("std"), F.coalesce(F.try_divide(std, mean) * 100, F.lit(0.0)).alias("cv"))
    label = F.when(F.col("cv") < VARIATION_LABELS[0][0], VARIATION_LABELS[0][1]).when(
        F.col("cv") < VARIATION_LABELS[1][0], VARIATION_LABELS[1][1]
    ).otherwise(VARIATION_LABELS[2][1])
    return rows.select(
        F.round("cv", 2).alias("cv_pct"), F.round("mean", 2).alias("mean_per_cell"), F.round("std", 2).alias("std_per_cell"),
        F.round(F.try_divide(F.col("occupied") * 100.0, F.col("n")), 2).alias("occupied_pct"),
        F.col("n").alias("n_cells"), F.lit(size / 1000).alias("cell_km"), label.alias("interpretation"),
    )


def grid_variation_points(df: DataFrame, x: str, y: str, size: float = GRID_SIZE) -> DataFrame:
    return grid_variation(*cell_counts_points(df, x, y, size), size)


def grid_variation_geometry(df: DataFrame, geometry: str, size: float = GRID_SIZE) -> DataFrame:
    return grid_variation(*cell_counts_geometry(df, geometry, size), size)
