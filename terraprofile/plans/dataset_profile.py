"""Whole-dataset profiles: metric rows per encoding and full reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.functions import crs
from terraprofile.functions import geometry as G
from terraprofile.functions import wkb
from terraprofile.functions.tables import AREA_CRS, COUNTRIES, DEFAULT_COUNTRY, LABEL_GEOSPATIAL, LABEL_NATIVE
from terraprofile.operators import cover, detect, hull, keys, locate, metrics, neighbours, profile
from terraprofile.operators.clean import col, decimal_comma, in_bounds
from terraprofile.session import materialize


@dataclass(frozen=True)
class Territory:
    """Reference polygons for coverage: a geometry column and its code.

    ``overlaps`` says whether polygons share area; it is looked up where unknown.
    """

    df: DataFrame
    geometry: str
    epsg: int
    overlaps: bool | None = None

    def moved(self, epsg: int | None) -> DataFrame:
        """The territory in ``epsg``; as it is where that is unknown."""
        if epsg is None:
            return self.df.select(col(self.geometry).alias("ref"))
        return locate.reproject_geometry(self.df.select(col(self.geometry).alias("ref")), "ref", self.epsg, epsg)


@dataclass(frozen=True)
class Rules:
    """Options of the metric rows.

    ``source_units`` keeps areas in the data's own coordinates, and
    ``always_filter`` applies the WGS84 bounds whatever the CRS.
    """

    country: str = DEFAULT_COUNTRY
    source_units: bool = False
    always_filter: bool = False
    digits: int = 2

    @property
    def params(self):
        return COUNTRIES.get(self.country.lower(), COUNTRIES[DEFAULT_COUNTRY])

    @property
    def bounds(self) -> Sequence[float]:
        return self.params[1]

    def metric_epsg(self, source: int | None) -> int | None:
        if source is None or self.source_units:
            return source
        return AREA_CRS.get(self.country.lower(), self.params[0])


def one_row(spark: SparkSession, **rows: DataFrame) -> DataFrame:
    """Several one-row frames side by side as structs, read as scalars."""
    return spark.range(1).select(*[df.select(F.struct("*")).scalar().alias(name) for name, df in rows.items()])


def crs_name(epsg: Column) -> Column:
    return F.coalesce(F.concat(F.lit("EPSG:"), epsg.cast("string")), F.lit("Unknown"))


def metric_row(stats: DataFrame, kind: Column, epsg: Column, rules: Rules, coverage: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Name and derive the report figures; a table without rows gives NULLs. ``keys`` are kept beside them."""
    d = rules.digits
    # tables of coordinates count located rows only; text shapes count all rows
    total = F.col("n_rows") if "n_rows" in stats.columns else F.col("n")
    some = F.col("n") > 0
    extent = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) / 1e6
    fill = metrics.fill_rate_bbox(extent, F.col("cminx"), F.col("cminy"), F.col("cmaxx"), F.col("cmaxy"))
    pct = lambda v: F.try_divide(v * 100.0, F.col("n"))
    cover_pct = coverage.select("coverage_pct").scalar() if coverage is not None else F.lit(None).cast("double")
    return stats.select(
        *keys,
        F.col("n").alias("n_objects"),
        F.when(some, crs_name(epsg)).alias("crs"),
        F.when(some, kind).alias("geometry_types"),
        F.when(some, F.round(F.col("n") * 100.0 / total, 1)).alias("present_pct"),
        F.when(some, F.round(F.col("n_valid") * 100.0 / total, 1)).alias("valid_pct"),
        F.when(some, F.round(extent, d)).alias("extent_km2"),
        F.when(some, F.round(metrics.density(F.col("n"), extent), d)).alias("density"),
        F.when(some, F.round(fill, d)).alias("fill_rate_pct"),
        F.when(some, F.round("complexity", 2)).alias("complexity"),
        F.round(pct(F.col("n") - F.col("n_distinct")), 2).alias("duplicate_pct"),
        F.when(some, F.round(cover_pct, 2)).alias("coverage_pct"),
    )


def _coverage(territory: Territory | None, stats: DataFrame, epsg: int | None) -> DataFrame | None:
    if territory is None:
        return None
    return cover.coverage_envelope(territory.moved(epsg), "ref", stats, territory.overlaps)


def profile_points(
    df: DataFrame, x: str, y: str, rules: Rules = Rules(), territory: Territory | None = None, epsg: int | None = None
) -> DataFrame:
    """Metric row of a table with coordinate columns.

    The CRS guess (one aggregate row) is read first, so that the bounds reach
    the scan as literals and the projection is fixed in the plan.
    """
    if epsg is None:
        epsg = locate.guess_crs(df, col(x), col(y)).first()["epsg"]
    rows = df.where(col(x).isNotNull() & col(y).isNotNull())
    if rules.always_filter or epsg == crs.GEOGRAPHIC:
        rows = rows.where(in_bounds(col(x), col(y), rules.bounds))
    metric = rules.metric_epsg(epsg)
    sx, sy = col(x).cast("double"), col(y).cast("double")
    mx, my = crs.transformer(epsg, metric)(sx, sy) if epsg else (sx, sy)
    rows = rows.select(sx.alias("sx"), sy.alias("sy"), mx.alias("mx"), my.alias("my"))
    finite = lambda c: ~(F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    box = [f(c).alias(n) for n, f, c in (("minx", F.min, "mx"), ("miny", F.min, "my"), ("maxx", F.max, "mx"), ("maxy", F.max, "my"))]
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(finite("sx") & finite("sy")).alias("n_valid"), F.countDistinct("sx", "sy").alias("n_distinct"), *box
    ).select("*", *[F.col(c).alias(f"c{c}") for c in ("minx", "miny", "maxx", "maxy")], F.lit(None).cast("double").alias("complexity"))
    return metric_row(stats, F.lit("Point"), F.lit(epsg).cast("int"), rules, _coverage(territory, stats, metric))


def profile_lines(
    df: DataFrame, columns: Sequence[str], rules: Rules = Rules(), territory: Territory | None = None, epsg: int | None = None
) -> DataFrame:
    """Metric row of a table with start and end coordinates, decimal commas accepted."""
    names = ("x1", "y1", "x2", "y2")
    rows = df.select(*[decimal_comma(col(c)).alias(n) for c, n in zip(columns, names)]).dropna()
    if epsg is None:
        epsg = locate.guess_crs(rows, F.col("x1"), F.col("y1")).first()["epsg"]
    if rules.always_filter or epsg == crs.GEOGRAPHIC:
        rows = rows.where(in_bounds(F.col("x1"), F.col("y1"), rules.bounds))
    metric = rules.metric_epsg(epsg)
    move = crs.transformer(epsg, metric) if epsg else (lambda a, b: (a, b))
    (ax, ay), (bx, by) = move(F.col("x1"), F.col("y1")), move(F.col("x2"), F.col("y2"))
    rows = rows.select(*names, ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    valid = (F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), F.countDistinct(*names).alias("n_distinct"),
        F.min(F.least("ax", "bx")).alias("minx"), F.min(F.least("ay", "by")).alias("miny"),
        F.max(F.greatest("ax", "bx")).alias("maxx"), F.max(F.greatest("ay", "by")).alias("maxy"),
        F.min(mid("ax", "bx")).alias("cminx"), F.min(mid("ay", "by")).alias("cminy"),
        F.max(mid("ax", "bx")).alias("cmaxx"), F.max(mid("ay", "by")).alias("cmaxy"),
    ).select("*", F.lit(2.0).alias("complexity"))
    return metric_row(stats, F.lit("LineString"), F.lit(epsg).cast("int"), rules, _coverage(territory, stats, metric))


def kinds_by_number() -> Column:
    """The kinds counted in the columns ``is_KIND``, the most frequent first, ties by name."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"is_{k}")).alias("n"), F.lit(label).alias("label")) for k, label in G.GEOJSON_KIND.items()]))
    return F.transform(F.filter(ranked, lambda r: r["n"] < 0), lambda r: r["label"])


def profile_geometry(
    df: DataFrame, geometry: str, rules: Rules = Rules(), territory: Territory | None = None, epsg: int | None = None, hulls: bool = False
) -> DataFrame:
    """Metric row of a table with a geometry column.

    Presence and validity are shares of all rows but those whose shape the bounds
    leave out: rows with no or an unreadable shape count as absent. Extent, density and
    coverage follow from the envelope, the fill rate from the box of centroids; with ``hulls``
    from the hull of all vertices, the fill rate being that of the commonest family of kinds.
    """
    absent = df.where(~F.coalesce(G.present(col(geometry)), F.lit(False))).agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.select(col(geometry).alias("g")).where(G.present(F.col("g")))
    if epsg is None:
        epsg = locate.guess_crs_geometry(rows, "g").first()["epsg"]
    rows = locate.filter_bounds_geometry(rows, "g", crs.GEOGRAPHIC if rules.always_filter else epsg, rules.bounds)
    metric = rules.metric_epsg(epsg)
    moved = locate.reproject_geometry(rows.select("g", F.col("g").alias("m")), "m", epsg, metric) if epsg else rows.select("g", F.col("g").alias("m"))
    m = F.col("m")
    kind = F.col("g.kind")
    flat = moved.select(
        kind.alias("kind"), metrics.geometry_key(F.col("g")).alias("key"), G.is_valid(F.col("g")).alias("valid"),
        G.vertex_count(m).alias("v"), G.bbox(m).alias("b"), G.centroid(m).alias("c"),
    )
    stats = flat.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.countDistinct("key").alias("n_distinct"),
        F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"),
        F.min("c.x").alias("cminx"), F.min("c.y").alias("cminy"), F.max("c.x").alias("cmaxx"), F.max("c.y").alias("cmaxy"),
        F.avg(F.when(F.col("kind") != "POINT", F.col("v"))).alias("complexity"),
        *[F.count_if(F.col("kind") == k).alias(f"is_{k}") for k in G.GEOJSON_KIND],
    )
    stats = stats.select("*", (F.col("n") + absent).alias("n_rows"), kinds_by_number().alias("kinds"))
    kinds = F.array_join("kinds", ", ")
    if not hulls:
        return metric_row(stats, kinds, F.lit(epsg).cast("int"), rules, _coverage(territory, stats, metric))
    shapes = materialize(moved.select("m"), "moved-shapes")
    ring = hull.convex_hull(hull.vertex_rows(shapes, m), F.col("x"), F.col("y"))
    family = _commonest_family(shapes, "m")
    fill, _ = _fill_and_cells(shapes.where(_family(m["kind"]) == family), "m", family, ring if family == "POINT" else None)
    covered = cover.coverage_hull(territory.moved(metric), "ref", ring, territory.overlaps) if territory else None
    row = metric_row(stats, kinds, F.lit(epsg).cast("int"), rules, covered)
    parts = one_row(df.sparkSession, row=row, hull=ring.select("area"), fill=fill.select("fill_rate"))
    extent, some = F.col("hull.area") / 1e6, F.col("row.n_objects") > 0
    instead = {
        "extent_km2": F.when(some, F.round(extent, rules.digits)),
        "density": F.when(some, F.round(metrics.density(F.col("row.n_objects"), extent), rules.digits)),
        "fill_rate_pct": F.when(some, F.round("fill.fill_rate", rules.digits)),
    }
    return parts.select(*[instead.get(c, F.col(f"row.{c}")).alias(c) for c in row.columns])


FAMILIES = ("POINT", "LINESTRING", "POLYGON")


def _family(kind: Column) -> Column:
    return F.regexp_replace(kind, "^MULTI", "")


def _commonest_family(shapes: DataFrame, geometry: str) -> str:
    """The family with most shapes; ties in the order of ``FAMILIES``."""
    counts = shapes.agg(*[F.count_if(_family(col(geometry)["kind"]) == k).alias(k) for k in FAMILIES]).first()
    return max(FAMILIES, key=lambda k: counts[k])


def _fill_and_cells(rows: DataFrame, geometry: str, family: str, ring: DataFrame | None) -> tuple[DataFrame, Callable[[Column], DataFrame] | None]:
    """The fill rate of shapes of one family, and the cells they cover in a frame (points cover none)."""
    if family == "POINT":
        # members of multi-points are points each
        pts = rows.select(F.explode(G.vertices(col(geometry))).alias("p")).select("p.x", "p.y")
        return metrics.fill_rate_points(pts, "x", "y", hull=ring), None
    if family == "LINESTRING":
        segs = cover.segments(rows, geometry)
        return cover.fill_rate_lines(segs).select("fill_rate"), lambda f: cover.buffered_cells(segs, f)
    return cover.fill_rate_polygons(rows, geometry), lambda f: cover.polygon_cells(rows, geometry, f)


METRIC_DDL = (
    "n_objects bigint, crs string, geometry_types string, present_pct double, valid_pct double, extent_km2 double, "
    "density double, fill_rate_pct double, complexity double, duplicate_pct double, coverage_pct double"
)


def default_geo_profile(spark: SparkSession) -> DataFrame:
    """The metric row of a table without geometry: typed NULLs."""
    columns = [c.split() for c in METRIC_DDL.split(", ")]
    return spark.range(1).select(*[F.lit(0 if n == "n_objects" else None).cast(t).alias(n) for n, t in columns])


def compute_all_metrics(
    df: DataFrame, key: str, geometry: str, territory: Territory | None = None, value: str | None = None, epsg: int = 2154,
    grid_size: float = metrics.GRID_SIZE, kind: str | None = None, permutations: int = neighbours.PERMUTATIONS,
) -> DataFrame:
    """Fill rate, complexity, duplicates, grid variation, coverage and Moran's I with its significance, as structs.

    ``df`` is in metric coordinates of ``epsg``. The most frequent family of
    kinds (points, lines, polygons; ties in this order) decides the method unless
    ``kind`` names it; ``kinds.other`` counts the rows of other families, which
    only complexity and duplicates take in.
    """
    spark = df.sparkSession
    g = col(geometry)
    every = df.where(G.present(g))
    kind = (kind or _commonest_family(every, geometry)).removeprefix("MULTI")
    rows = every.where(_family(g["kind"]) == kind)
    ref = territory.moved(epsg) if territory else None
    coverage = None
    if kind == "POINT":
        pts = rows.withColumns({"_x": G.vertices(g)[0]["x"], "_y": G.vertices(g)[0]["y"]})
        ring = hull.convex_hull(pts, F.col("_x"), F.col("_y"))
        fill = metrics.fill_rate_points(pts, "_x", "_y", hull=ring)
        variation = metrics.grid_variation_points(pts, "_x", "_y", grid_size)
        moran = neighbours.moran_significance(pts, key, "_x", "_y", value, permutations=permutations) if value else None
        coverage = cover.coverage_hull(ref, "ref", ring, territory.overlaps) if ref is not None else None
    else:
        f = cover.frame(cover.geometry_box(rows, geometry))
        variation = metrics.grid_variation_geometry(rows, geometry, grid_size)
        moran = neighbours.moran_queen_significance(rows, key, geometry, value, permutations=permutations) if value else None
        fill, cells = _fill_and_cells(rows, geometry, kind, None)
        coverage = cover.coverage_cells(ref, "ref", cells(f), f, territory.overlaps) if ref is not None else None
    parts = {
        "fill": fill,
        "complexity": metrics.complexity(every, geometry),
        "duplicates": metrics.duplicates(every, F.sha2(geometry_text(g), 256)),
        "variation": variation,
        "kinds": every.agg(F.count_if(_family(g["kind"]) != kind).alias("other")),
    }
    if coverage is not None:
        parts["coverage"] = coverage
    if moran is not None:
        parts["moran"] = moran
    # one after the other, as scalars of one plan would all run and hold their tables at once
    return one_row(spark, **{name: materialize(row, name) for name, row in parts.items()})


def geometry_text(g: Column) -> Column:
    return metrics.geometry_key(g)


# ------------------------------------------------------------------ full report

TYPE_TABLE = "CSV"
TYPE_WITH_GEOMETRY = "CSV with geometry"
TYPE_GEOSPATIAL = "Geospatial"
KEY_TABLE = "array<struct<`Reference area`:string,`Identified key`:string>>"
WITHOUT_GEOMETRY = ("none", "join_required", "geocoding_required")


def native_geometry(df: DataFrame, samples: dict[str, str | None]) -> tuple[DataFrame, int | None, str] | None:
    """A table's own geometry: the shapes as ``_geometry``, their code where it is written inside, and the type of file.

    A geometry column comes first, then a column with one of the usual names, that holds binary, or
    WKT, GeoJSON or binary in hexadecimal digits as its sample shows; None without one.
    """
    by_type = next((f.name for f in df.schema.fields if G.is_geometry(f.dataType)), None)
    if by_type:
        return df.select(col(by_type).alias("_geometry")), None, TYPE_GEOSPATIAL
    name = detect.native_geometry_column(df.columns)
    if name is None:
        return None
    c, sample = col(name), samples.get(name) or ""
    binary = isinstance(df.schema[name].dataType, T.BinaryType)
    if binary or re.fullmatch(r"0[01][0-9A-Fa-f]{16,}", sample):
        data = c if binary else F.unhex(c)
        code = df.select(wkb.code_of(data).alias("c")).where("c IS NOT NULL").agg(F.min("c")).first()[0]
        shapes = wkb.add_from_wkb(df.select(data.alias("_data")), F.col("_data"), "_geometry").select("_geometry")
        return shapes, code if code in crs.KNOWN else None, TYPE_GEOSPATIAL
    if re.match(r"\s*(MULTI)?(POINT|LINESTRING|POLYGON)\b", sample, re.IGNORECASE):
        return df.select(G.from_wkt(c).alias("_geometry")), None, TYPE_WITH_GEOMETRY
    return (df.select(G.from_geojson(c).alias("_geometry")), None, TYPE_WITH_GEOMETRY) if sample.lstrip().startswith("{") else None


def dataset_profile(
    df: DataFrame, dataset_id: str, rules: Rules = Rules(), key_order: Sequence[str] | None = None, territory: Territory | None = None
) -> DataFrame:
    """The full report row of one table.

    The column catalog (one row per column) and the detected encoding (one row)
    are read on the way, as they decide which plan measures the geometry.
    """
    spark = df.sparkSession
    scanned = profile.column_catalog(df, dataset_id)
    catalog = spark.createDataFrame(scanned.collect(), scanned.schema)
    native = native_geometry(df, {r["column"]: r["sample"] for r in catalog.collect()})
    found = detect.detect_geometry(catalog).first()
    if native:
        shapes, epsg, kind = native
        label = LABEL_GEOSPATIAL if kind == TYPE_GEOSPATIAL else LABEL_NATIVE
        geo = profile_geometry(shapes, "_geometry", rules, territory, epsg, hulls=kind == TYPE_WITH_GEOMETRY)
    else:
        label, method, columns = found["label"], found["method"], found["columns"]
        kind = TYPE_TABLE if method in WITHOUT_GEOMETRY else TYPE_WITH_GEOMETRY
        if method == "points_from_xy":
            xy = df.select(decimal_comma(col(columns[0])).alias("x"), decimal_comma(col(columns[1])).alias("y"))
            geo = profile_points(xy, "x", "y", rules, territory)
        elif method == "linestring_coords":
            geo = profile_lines(df, columns, rules, territory)
        elif method in ("geojson", "from_wkt", "geopoint"):
            geo = profile_geometry(locate.add_geometry(df, method, columns, "_geometry"), "_geometry", rules, territory, hulls=True)
        else:
            geo = default_geo_profile(spark)
    found_keys = keys.key_detect(df, key_order, rules.country)
    key_rows = sorted((r.asDict() for r in found_keys.collect()), key=lambda r: df.columns.index(r["column"]))
    names = [r["column"] for r in key_rows]
    key_table = F.array(*[F.struct(F.lit(r["label"]), F.lit(r["column"])) for r in key_rows]).cast(KEY_TABLE) if key_rows else F.array().cast(KEY_TABLE)
    table = profile.details_of_catalog(catalog).agg(column_table().alias("Colonnes"))
    totals = catalog.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_columns"))
    # completeness follows from the catalog's counts, without another scan
    whole = profile.dataset_completeness(catalog).select("mean_pct", "std_pct")
    of_keys = profile.dataset_completeness(catalog.where(F.col("column").isin(*names))).select("mean_pct", "std_pct") if names else profile.completeness(df, [])
    names_text = F.lit(", ".join(sorted(names)) or None)
    row = one_row(spark, totals=totals, table=table, whole=whole, of_keys=of_keys, geo=geo)
    return row.select(F.lit(dataset_id).alias("Nom du fichier"), *report_columns(F.lit(kind), F.lit(label), key_table, names_text))


def column_table() -> Column:
    """Aggregate: the details of all columns in schema order."""
    details = F.struct(
        F.col("position"), F.col("column").alias("Colonne"), F.col("example").alias("Exemple"), F.col("type").alias("Type"), F.col("missing").alias("Valeurs manquantes")
    )
    return F.sort_array(F.collect_list(details))


def report_columns(kind: Column, label: Column, key_table: Column, key_names: Column) -> list[Column]:
    """The report's columns behind the file's, from the structs totals, table, whole, of_keys and geo."""
    return [
        kind.alias("Type de fichier"),
        F.col("totals.n_rows").alias("Nb lignes"),
        F.col("totals.n_columns").alias("Nb colonnes"),
        F.col("table.Colonnes").alias("Colonnes"),
        _score("whole").alias("Score de complétude global"),
        key_table.alias("Clés géographiques"),
        label.alias("Géotransformation"),
        _score("of_keys").alias("Score de complétude des clés géographique"),
        F.struct(F.col("geo.present_pct").alias("Présentes (%)"), F.col("geo.valid_pct").alias("Valides (%)")).alias("Score de complétude géographique"),
        F.col("geo.crs").alias("CRS"),
        F.col("geo.geometry_types").alias("Types de géométrie"),
        F.col("geo.extent_km2").alias("Emprise estimée (km2)"),
        F.col("geo.density").alias("Densité (obj/km2)"),
        F.col("geo.fill_rate_pct").alias("Taux de remplissage géométrique (%)"),
        F.col("geo.complexity").alias("Complexité moyenne des géométries"),
        F.col("geo.duplicate_pct").alias("Part des geometries dupliquees (%)"),
        F.col("geo.coverage_pct").alias("Couverture territoriale hexagonale (%)"),
        keys.granularity(F.col("geo.geometry_types"), key_names).alias("Granularité"),
    ]


def _score(name: str) -> Column:
    return F.struct(
        F.col(f"{name}.mean_pct").alias("Score de complétude moyen (%)"), F.col(f"{name}.std_pct").alias("Score de complétude std (%)")
    )
