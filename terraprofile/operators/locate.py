"""CRS guessing, reprojection and geometry columns for tables (groups F and G)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraprofile.functions import crs
from terraprofile.functions import geometry as G
from terraprofile.operators.clean import FRANCE_BOUNDS, col, decimal_comma, in_bounds

# Fixed values: (code, x window, y window); medians lie strictly inside, first match wins.
CRS_WINDOWS = [
    (4326, (-10.0, 10.0), (40.0, 60.0)),
    (2154, (100000.0, 1300000.0), (6000000.0, 7400000.0)),
    (3857, (-2200000.0, 2200000.0), (-2200000.0, 2200000.0)),
]


class _MedianTest:
    """Compares an exact median with constants through counts.

    Where the middle ranks fall relative to a constant follows from how many
    values lie below it and at it; only when the two middle values straddle it
    are its nearest neighbours needed. So a constant costs four aggregates of
    fixed size, and no task ever holds the values.
    """

    def __init__(self, value: Column, valid: Column, prefix: str, limits: Sequence[float]):
        self.prefix, self.limits = prefix, sorted(set(limits))
        v = F.when(valid, value)
        self.aggregates = [
            a
            for i, c in enumerate(self.limits)
            for a in (
                F.count_if(v < c).alias(f"{prefix}lt{i}"),
                F.count_if(v <= c).alias(f"{prefix}le{i}"),
                F.max(F.when(v < c, v)).alias(f"{prefix}below{i}"),
                F.min(F.when(v > c, v)).alias(f"{prefix}above{i}"),
            )
        ]

    def _parts(self, c: float):
        i = self.limits.index(c)
        lt, le, below, above = (F.col(f"{self.prefix}{k}{i}") for k in ("lt", "le", "below", "above"))
        low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        return lt, le, below, above, low, high

    def less(self, c: float) -> Column:
        lt, le, below, above, low, high = self._parts(c)
        upper = F.when(le > lt, F.lit(c)).otherwise(above)
        return F.when(high < lt, True).when(low >= lt, False).otherwise((below + upper) / 2 < c)

    def greater(self, c: float) -> Column:
        lt, le, below, above, low, high = self._parts(c)
        lower = F.when(le > lt, F.lit(c)).otherwise(below)
        return F.when(low >= le, True).when(high < le, False).otherwise((lower + above) / 2 > c)


def guess_crs(df: DataFrame, x: Column, y: Column, by: Column | None = None) -> DataFrame:
    """EPSG code whose window holds the medians of ``x`` and ``y``, or NULL.

    One aggregate over rows with both coordinates, per dataset when ``by`` is given.
    """
    df = df.select(*([by.alias("dataset_id")] if by is not None else []), x.cast("double").alias("x"), y.cast("double").alias("y"))
    valid = F.col("x").isNotNull() & F.col("y").isNotNull()
    xs = _MedianTest(F.col("x"), valid, "x_", [v for _, w, _ in CRS_WINDOWS for v in w])
    ys = _MedianTest(F.col("y"), valid, "y_", [v for _, _, w in CRS_WINDOWS for v in w])
    aggregates = [F.count_if(valid).alias("n"), *xs.aggregates, *ys.aggregates]
    stats = df.groupBy("dataset_id").agg(*aggregates) if by is not None else df.agg(*aggregates)
    epsg = F.lit(None).cast("int")
    for code, (x0, x1), (y0, y1) in reversed(CRS_WINDOWS):
        inside = xs.greater(x0) & xs.less(x1) & ys.greater(y0) & ys.less(y1)
        epsg = F.when((F.col("n") > 0) & inside, F.lit(code)).otherwise(epsg)
    keys = ["dataset_id"] if by is not None else []
    return stats.select(*keys, F.col("n").alias("n_located"), epsg.alias("epsg"))


def guess_crs_geometry(df: DataFrame, geometry: str, by: Column | None = None) -> DataFrame:
    """:func:`guess_crs` on centroids."""
    c = G.centroid(col(geometry))
    keep = [by.alias("d")] if by is not None else []
    rows = df.select(*keep, c.alias("c"))
    return guess_crs(rows, F.col("c.x"), F.col("c.y"), F.col("d") if by is not None else None)


def reproject_points(df: DataFrame, x: str, y: str, source: int, target: int, names: tuple[str, str] | None = None) -> DataFrame:
    """Replace or add projected coordinates; equal codes change nothing."""
    px, py = crs.transformer(source, target)(col(x), col(y))
    nx, ny = names or (x, y)
    return df.withColumns({nx: px, ny: py})


def reproject_geometry(df: DataFrame, geometry: str, source: int, target: int) -> DataFrame:
    if source == target:
        return df
    moved = G.map_coordinates(col(geometry), crs.move_struct(source, target))
    return df.withColumn(geometry, moved)


def add_geometry(df: DataFrame, method: str, columns: Sequence[str], name: str = "geometry") -> DataFrame:
    """A geometry column from a detected encoding; unreadable values are NULL."""
    c = [col(n) for n in columns]
    if method == "points_from_xy":
        g = G.point(decimal_comma(c[0]), decimal_comma(c[1]))
    elif method == "geopoint":
        g = G.from_latlon_text(c[0])
    elif method == "geojson":
        g = G.from_geojson(c[0])
    elif method == "from_wkt":
        g = G.from_wkt(c[0])
    elif method == "linestring_coords":
        g = G.line(*[decimal_comma(v) for v in c])
    else:
        raise ValueError(f"no geometry can be built by method {method}")
    return df.withColumn(name, g)


def malformed_count(df: DataFrame, raw: str, geometry: str) -> DataFrame:
    """How many present values gave no geometry."""
    present = col(raw).isNotNull()
    return df.agg(
        F.count_if(present).alias("n_present"), F.count_if(present & col(geometry).isNull()).alias("n_malformed")
    )


def filter_bounds_geometry(df: DataFrame, geometry: str, epsg: int | None, bounds=FRANCE_BOUNDS) -> DataFrame:
    """Rows whose centroid lies in the WGS84 bounds; other CRS keep all located rows."""
    located = df.where(col(geometry).isNotNull())
    if epsg != crs.GEOGRAPHIC:
        return located
    inside = G.let(G.centroid(col(geometry)), lambda c: in_bounds(c["x"], c["y"], bounds))
    return located.where(inside)


def geometry_type_counts(df: DataFrame, geometry: str) -> DataFrame:
    """Kinds by falling frequency, joined by commas, with the number of kinds."""
    kinds = df.where(col(geometry).isNotNull()).groupBy(G.kind_label(col(geometry)["kind"]).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind")))
    return kinds.agg(
        F.array_join(F.transform(ordered, lambda r: r["kind"]), ", ").alias("kinds"), F.sum("n").alias("n")
    )


def crs_guard(datasets: DataFrame, reference_epsg: int | None) -> DataFrame:
    """Keep ``coverage`` only where the dataset's code equals the reference's or one is unknown."""
    same = F.col("epsg").isNull() | F.lit(reference_epsg).cast("int").isNull() | (F.col("epsg") == F.lit(reference_epsg).cast("int"))
    return datasets.withColumn("coverage", F.when(same, F.col("coverage")))
