"""Geometry-encoding detection by a cascade of name and sample rules (group E).

The input is a column catalog of any number of datasets. Each dataset's
columns are gathered into one ordered array (its length is the width of the
schema) and every rule is an expression on that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraprofile.functions import tables as L

# Name rules.
LAT_NAME = r"\b(lat|latitude)\b"
LON_NAME = r"\b(lon|long|lng|longitude)\b"
X_NAME = r"(^x[^a-zA-Z0-9]?|[^a-zA-Z0-9]x$)"
Y_NAME = r"(^y[^a-zA-Z0-9]?|[^a-zA-Z0-9]y$)"
GEOM_NAME = r"\b(geometry|geom|shape|point|polygon)\b"
ADDRESS_NAME = r"adresse"
ADMIN_NAME = r"(dep|reg|insee|com)"
START_MARK = r"(d|debut|start)"
END_MARK = r"(f|fin|end)"

RESULT = "struct<type:string,method:string,columns:array<string>,label:string>"


def _result(kind: Column, method: str, columns: Column, label: str) -> Column:
    return F.struct(
        kind.alias("type"), F.lit(method).alias("method"), columns.alias("columns"), F.lit(label).alias("label")
    ).cast(RESULT)


def dataset_columns(catalog: DataFrame) -> DataFrame:
    """One row per dataset with its columns in schema order."""
    if "dataset_id" not in catalog.columns:
        catalog = catalog.withColumn("dataset_id", F.lit("table"))
    item = F.struct("position", "column", F.lower("column").alias("name"), "type", "sample")
    return catalog.groupBy("dataset_id").agg(F.sort_array(F.collect_list(item)).alias("cols"))


def _named(cols: Column, pattern: str) -> Column:
    return F.filter(cols, lambda c: c["name"].rlike(pattern))


def _geopoint(c: Column) -> Column:
    hit = c["name"].contains("point") & c["name"].contains("geo") & (c["type"] == "string") & c["sample"].contains(",")
    return F.when(hit, _result(F.lit("Point"), "geopoint", F.array(c["column"]), L.LABEL_NATIVE))


def _geojson(c: Column) -> Column:
    kind = F.get_json_object(c["sample"], "$.type")
    hit = kind.isNotNull() & F.get_json_object(c["sample"], "$.coordinates").isNotNull()
    return F.when(hit, _result(kind, "geojson", F.array(c["column"]), L.LABEL_NATIVE))


def _wkt(c: Column) -> Column:
    text = F.upper(c["sample"])
    kind = (
        F.when(text.contains("POINT"), "Point")
        .when(text.contains("LINESTRING"), "Linestring")
        .when(text.contains("POLYGON"), "Polygon")
    )
    hit = (c["type"] == "string") & kind.isNotNull()
    return F.when(hit, _result(kind, "from_wkt", F.array(c["column"]), L.LABEL_NATIVE))


def _first(results: Column) -> Column:
    return F.get(F.array_compact(results), F.lit(0))


def _by_column(rule):
    """First hit of a per-column rule among geometry-named columns with a value."""

    def on(cols: Column) -> Column:
        named = F.filter(cols, lambda c: c["name"].rlike(GEOM_NAME) & c["sample"].isNotNull())
        return _first(F.transform(named, rule))

    return on


def _encoded(c: Column) -> Column:
    return F.coalesce(_geopoint(c), _geojson(c), _wkt(c))


def _lonlat(cols: Column) -> Column:
    lat, lon = F.get(_named(cols, LAT_NAME), F.lit(0)), F.get(_named(cols, LON_NAME), F.lit(0))
    hit = lat.isNotNull() & lon.isNotNull()
    return F.when(
        hit, _result(F.lit("Point"), "points_from_xy", F.array(lon["column"], lat["column"]), L.LABEL_PAIR)
    )


def _first_xy(cols: Column) -> Column:
    """The first x column and its y column: names equal once the x and y are removed."""
    xs, ys = _named(cols, X_NAME), _named(cols, Y_NAME)
    pairs = F.flatten(
        F.transform(
            xs,
            lambda x: F.transform(
                F.filter(
                    ys, lambda y: F.replace(x["name"], F.lit("x"), F.lit("")) == F.replace(y["name"], F.lit("y"), F.lit(""))
                ),
                lambda y: F.struct(x.alias("x"), y.alias("y")),
            ),
        )
    )
    return F.get(pairs, F.lit(0))


def _endpoints(cols: Column) -> Column:
    start = _first_xy(cols)

    def other(pattern: str, taken: Column) -> Column:
        ends = F.filter(_named(cols, pattern), lambda c: (c["column"] != taken) & c["name"].rlike(END_MARK))
        return F.get(ends, F.lit(0))["column"]

    sx, sy = start["x"]["column"], start["y"]["column"]
    ex, ey = other(X_NAME, sx), other(Y_NAME, sy)
    hit = start["x"]["name"].rlike(START_MARK) & ex.isNotNull() & ey.isNotNull()
    return F.when(hit, _result(F.lit("LineString"), "linestring_coords", F.array(sx, sy, ex, ey), L.LABEL_ENDPOINTS))


def _xy_pair(cols: Column) -> Column:
    p = _first_xy(cols)
    columns = F.array(p["x"]["column"], p["y"]["column"])
    return F.when(p.isNotNull(), _result(F.lit("Point"), "points_from_xy", columns, L.LABEL_PAIR))


def _address(cols: Column) -> Column:
    hit = F.get(_named(cols, ADDRESS_NAME), F.lit(0))["column"]
    return F.when(hit.isNotNull(), _result(F.lit("Address"), "geocoding_required", F.array(hit), L.LABEL_ADDRESS))


def _admin(cols: Column) -> Column:
    names = F.transform(_named(cols, ADMIN_NAME), lambda c: c["column"])
    return F.when(F.size(names) > 0, _result(F.lit("Administrative"), "join_required", names, L.LABEL_KEYS))


def _none() -> Column:
    empty = F.array().cast("array<string>")
    return _result(F.lit(None).cast("string"), "none", empty, L.LABEL_NONE)


RULES = {
    "geopoint": _by_column(_geopoint),
    "geojson": _by_column(_geojson),
    "wkt": _by_column(_wkt),
    "lonlat": _lonlat,
    "xy": _xy_pair,
    "linestring_pairs": _endpoints,
    "address": _address,
    "admin_keys": _admin,
}


def _unpacked(rows: DataFrame, result: Column) -> DataFrame:
    return rows.select("dataset_id", result.alias("r")).select(
        "dataset_id", "r.type", "r.method", "r.columns", "r.label"
    )


def detect_rule(catalog: DataFrame, rule: str) -> DataFrame:
    """Apply one rule alone; datasets it does not fit are absent."""
    return _unpacked(dataset_columns(catalog), RULES[rule](F.col("cols"))).where(F.col("method").isNotNull())


def detect_geometry(catalog: DataFrame) -> DataFrame:
    """The full cascade: the first rule that fits decides."""
    cols = F.col("cols")
    found = F.coalesce(
        _by_column(_encoded)(cols), _lonlat(cols), _endpoints(cols), _xy_pair(cols), _address(cols), _admin(cols), _none()
    )
    return _unpacked(dataset_columns(catalog), found)


def native_geometry_column(names: list[str]) -> str | None:
    """The geometry column of a native file, by preferred name whatever its case."""
    by_lower = {n.lower(): n for n in names}
    return next((by_lower[g] for g in L.GEOMETRY_NAMES if g in by_lower), None)
