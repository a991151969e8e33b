"""The full report row of every file of a batch, whatever the files' schemas.

All delimited files are one grouped job and all feature collections another: records are
found across blocks, cells are counted per file and column, the encodings found decide which
cells hold the geometry, and one aggregate per file measures it. No file is a job of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraprofile.functions import crs
from terraprofile.functions import geometry as G
from terraprofile.functions.tables import LABEL_GEOSPATIAL, SUPPORTED_EXTENSIONS
from terraprofile.operators import detect, keys, locate, metrics, profile
from terraprofile.operators.clean import decimal_comma, in_bounds
from terraprofile.plans.dataset_profile import (
    KEY_TABLE,
    METRIC_DDL,
    TYPE_GEOSPATIAL,
    TYPE_TABLE,
    TYPE_WITH_GEOMETRY,
    WITHOUT_GEOMETRY,
    Rules,
    column_table,
    kinds_by_number,
    metric_row,
    report_columns,
)
from terraprofile.sources import files, records
from terraprofile.session import materialize

CATALOG = ("dataset_id", "position", "column", "type", "non_null", "n", "sample", "n_bad")
NATIVE = "native"
READABLE = (".csv", ".txt", ".geojson", ".json")


def delimited_cells(spark: SparkSession, directory: str, glob: str = "*.{csv,txt}") -> tuple[DataFrame, DataFrame]:
    """Headers (dataset_id, names) and rows (dataset_id, cells, fits) of delimited files.

    The first record of a file names its columns. ``fits`` is false for records with another
    number of cells and for one whose quoted cell never ends; they are counted, not measured.
    """
    heads, found = records.records(spark, directory, glob)
    known = heads.select("path", files.path_key(F.col("path")).alias("dataset_id"), files.header_delimiter(F.col("head")).alias("delimiter"))
    rows = found.join(known, "path").select("dataset_id", "first", "broken", records.cells(F.col("value"), F.col("delimiter")).alias("cells"))
    headers = materialize(rows.where("first").select("dataset_id", F.col("cells").alias("names")), "headers")
    body = rows.where("NOT first").join(headers.select("dataset_id", F.size("names").alias("width")), "dataset_id")
    cut = body.select("dataset_id", "cells", (~F.col("broken") & (F.size("cells") == F.col("width"))).alias("fits"))
    # catalog, CRS guess and metrics each read the cells
    return headers, materialize(cut, "cells")


def _typed(rows: DataFrame, by: Sequence[str], value: Column, rules: Rules, *more: Column) -> DataFrame:
    """Counts per column of text values: present, whole and decimal numbers, and values that fit each key format."""
    whole, number = value.try_cast("bigint").isNotNull(), value.try_cast("double").isNotNull()
    name = F.lower(F.col("column"))
    fitting = [
        F.count_if(reduce(lambda a, b: a | b, [name.contains(p) for p in patterns]) & keys.matches_format(value, fmt)).alias(f"fits_{no}")
        for no, _, patterns, fmt in keys.definitions(rules.country) if fmt
    ]
    found = rows.groupBy(*by).agg(
        F.count(value).alias("non_null"), F.min(value).alias("sample"), F.count_if(whole).alias("n_int"), F.count_if(number).alias("n_num"), *fitting, *more
    )
    return found


def _with_type(found: DataFrame) -> DataFrame:
    kind = F.when((F.col("n_num") < F.col("non_null")) | (F.col("non_null") == 0), "string").when(F.col("n_int") < F.col("non_null"), "double").otherwise("bigint")
    return found.withColumn("type", kind).withColumn("position", F.col("position").cast("bigint")).drop("n_int", "n_num")


def delimited_catalog(headers: DataFrame, rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Column catalog of delimited files, with the number of values that fit each key format.

    Counts are partially aggregated per file and column, so a file with most rows does not skew the shuffle.
    """
    named = rows.join(headers, "dataset_id")
    long = named.select("dataset_id", "fits", "cells", F.posexplode("names").alias("position", "column")).select(
        "dataset_id", "position", "column", "fits", F.when(F.col("fits"), F.get("cells", F.col("position"))).alias("v")
    )
    value = F.when(F.col("v") != "", F.col("v"))
    found = _typed(long, ["dataset_id", "position", "column"], value, rules, F.count_if("fits").alias("n"), F.count_if(~F.col("fits")).alias("n_bad"))
    # a file with a header only still has columns
    listed = headers.select("dataset_id", F.posexplode("names").alias("position", "column"))
    counts = [c for c in found.columns if c not in ("dataset_id", "position", "column", "sample")]
    return _with_type(listed.join(found, ["dataset_id", "position", "column"], "left").fillna(0, counts))


def collection_catalog(features: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Column catalog of feature collections: their properties, and the geometry as the last column."""
    totals = features.groupBy("dataset_id").agg(
        F.count_if("readable").alias("n"), F.count_if(~F.col("readable")).alias("n_bad"), F.count("geometry").alias("located"), F.min(G.as_wkt(F.col("geometry"))).alias("wkt")
    )
    long = features.where("readable").select("dataset_id", F.posexplode(F.map_entries("properties")).alias("position", "e")).select(
        "dataset_id", "position", F.col("e.key").alias("column"), F.col("e.value").alias("v")
    )
    found = _typed(long, ["dataset_id", "column"], F.col("v"), rules, F.min("position").alias("position"))
    properties = _with_type(found.join(totals.select("dataset_id", "n", "n_bad"), "dataset_id"))
    shapes = totals.select(
        "dataset_id", F.lit(1 << 20).cast("bigint").alias("position"), F.lit("geometry").alias("column"), F.lit("string").alias("type"),
        F.col("located").alias("non_null"), "n", F.col("wkt").alias("sample"), "n_bad",
    )
    return properties.unionByName(shapes, allowMissingColumns=True)


def batch_keys(catalog: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Join keys of every file: dataset_id, position, column, label; the first definition whose values pass."""
    options = []
    name = F.lower(F.col("column"))
    for no, label, patterns, fmt in keys.definitions(rules.country):
        named = reduce(lambda a, b: a | b, [name.contains(p) for p in patterns])
        passes = F.col(f"fits_{no}") / F.col("non_null") >= keys.MIN_MATCH_RATE if fmt else F.lit(True)
        options.append(F.when(named & passes, F.lit(label)))
    found = F.coalesce(*options) if options else F.lit(None).cast("string")
    return catalog.where("non_null > 0").select("dataset_id", "position", "column", found.alias("label")).where("label IS NOT NULL")


def _shapes(rows: DataFrame, features: DataFrame, headers: DataFrame, encodings: DataFrame) -> DataFrame:
    """(dataset_id, method, g) of all rows of files with an encoding that can be measured."""
    found = encodings.where(~F.col("method").isin(*WITHOUT_GEOMETRY)).join(headers, "dataset_id")
    places = F.transform("columns", lambda c: (F.array_position("names", c) - 1).cast("int"))
    where = found.select("dataset_id", "method", places.alias("at"))
    c = [F.get("cells", F.get("at", F.lit(k))) for k in range(4)]
    number = [decimal_comma(v) for v in c]
    text = lambda method, g: F.when(F.col("method") == method, g)
    g = F.coalesce(
        text("points_from_xy", G.point(number[0], number[1])),
        text("linestring_coords", G.line(*number)),
        text("geopoint", G.from_latlon_text(c[0])),
        text("geojson", G.from_geojson(c[0])),
        text("from_wkt", G.from_wkt(c[0])),
    )
    own = rows.where("fits").join(where, "dataset_id").select("dataset_id", "method", g.alias("g"))
    return own.unionByName(features.where("readable").select("dataset_id", F.lit(NATIVE).alias("method"), F.col("geometry").alias("g")))


def batch_metrics(shapes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The metric row of every file (dataset_id and the figures of a single file's row).

    Files of coordinate columns count located rows only, the others all rows but those the bounds
    leave out, as for a single table. The CRS guess is one row per file.
    """
    # lines by end points are placed by their start, shapes by their centroid
    start = G.vertices(F.col("g"))[0]
    anchor = F.when(F.col("method") == "linestring_coords", start).otherwise(G.centroid(F.col("g")))
    located = shapes.withColumn("present", F.coalesce(G.present(F.col("g")), F.lit(False)))
    guesses = materialize(locate.guess_crs(located.where("present").select("dataset_id", anchor.alias("a")), F.col("a.x"), F.col("a.y"), F.col("dataset_id")), "crs-guesses")
    placed = located.join(guesses.select("dataset_id", "epsg"), "dataset_id", "left")
    bounded = F.lit(True) if rules.always_filter else F.coalesce(F.col("epsg") == crs.GEOGRAPHIC, F.lit(False))
    kept = F.col("present") & (~bounded | G.let(anchor, lambda a: in_bounds(a["x"], a["y"], rules.bounds)))
    moved = F.col("g")
    for code, *_ in locate.CRS_WINDOWS:
        if rules.metric_epsg(code) != code:
            moved = F.when(F.col("epsg") == code, G.map_coordinates(F.col("g"), crs.move_struct(code, rules.metric_epsg(code)))).otherwise(moved)
    rows = placed.select("dataset_id", "method", "epsg", "g", "present", kept.alias("kept")).withColumn("m", F.when(F.col("kept"), moved))
    g, m = F.col("g"), F.col("m")
    valid = F.when(F.col("kept"), G.is_valid(g))
    flat = rows.select(
        "dataset_id", "method", "epsg", "present", "kept", g["kind"].alias("kind"), F.when(F.col("kept"), metrics.geometry_key(g)).alias("key"), valid.alias("valid"),
        G.vertex_count(m).alias("v"), G.bbox(m).alias("b"), G.centroid(m).alias("c"),
    )
    of_columns = F.col("method").isin("points_from_xy", "linestring_coords")
    stats = flat.groupBy("dataset_id").agg(
        F.first("epsg").alias("epsg"), F.count_if("kept").alias("n"), F.count_if("valid").alias("n_valid"), F.countDistinct("key").alias("n_distinct"),
        F.count_if(F.col("kept") | (~F.col("present") & ~of_columns)).alias("n_rows"),
        F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"),
        F.min("c.x").alias("cminx"), F.min("c.y").alias("cminy"), F.max("c.x").alias("cmaxx"), F.max("c.y").alias("cmaxy"),
        F.avg(F.when(F.col("kept") & (F.col("kind") != "POINT"), F.col("v"))).alias("complexity"),
        *[F.count_if(F.col("kept") & (F.col("kind") == k)).alias(f"is_{k}") for k in G.GEOJSON_KIND],
    ).withColumn("kinds", kinds_by_number())
    return metric_row(stats, F.array_join("kinds", ", "), F.col("epsg"), rules, keys=["dataset_id"])


def batch_report(spark: SparkSession, directory: str, rules: Rules = Rules()) -> DataFrame:
    """One row per readable file of a folder: dataset_id, n_bad (records left out) and the report's columns.

    A file's columns, keys, encoding, CRS and metrics are those a single table would give; coverage
    needs a territory and is NULL here. A file without columns has no row.
    """
    headers, rows = delimited_cells(spark, directory)
    features = materialize(files.geojson_features(spark, directory), "features")
    catalog = materialize(
        delimited_catalog(headers, rows, rules).unionByName(collection_catalog(features, rules), allowMissingColumns=True), "catalog"
    )
    collections = features.select("dataset_id").distinct().withColumn("is_native", F.lit(True))
    encodings = materialize(detect.detect_geometry(catalog).join(collections, "dataset_id", "left"), "encodings")
    geo = batch_metrics(_shapes(rows, features, headers, encodings.where("is_native IS NULL")), rules)
    found_keys = materialize(batch_keys(catalog, rules), "batch-keys")
    key_row = F.array_sort(F.collect_list(F.struct("position", "label", "column")))
    per_file = found_keys.groupBy("dataset_id").agg(
        F.transform(key_row, lambda k: F.struct(k["label"], k["column"])).cast(KEY_TABLE).alias("key_table"), F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("key_names")
    )
    struct = lambda df, name: df.select("dataset_id", F.struct(*[c for c in df.columns if c != "dataset_id"]).alias(name))
    totals = catalog.groupBy("dataset_id").agg(F.max("n").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"), F.max("n_bad").alias("n_bad"))
    table = profile.details_of_catalog(catalog).groupBy("dataset_id").agg(column_table().alias("Colonnes"))
    score = lambda df: profile.dataset_completeness(df).select("dataset_id", "mean_pct", "std_pct")
    of_keys = score(catalog.join(found_keys, ["dataset_id", "position"], "left_semi"))
    joined = reduce(
        lambda a, b: a.join(b, "dataset_id", "left"),
        [struct(totals, "totals"), struct(table, "table"), struct(score(catalog), "whole"), struct(of_keys, "of_keys"), struct(geo, "geo"), per_file, encodings.select("dataset_id", "label", "method", "is_native")],
    )
    # a file without keys has a score of 0, one without geometry the empty metric row
    none = F.named_struct(F.lit("mean_pct"), F.lit(0.0), F.lit("std_pct"), F.lit(0.0))
    fields = [c.split() for c in METRIC_DDL.split(", ")]
    empty = F.struct(*[F.lit(0 if n == "n_objects" else None).cast(t).alias(n) for n, t in fields])
    filled = joined.withColumns({"of_keys": F.coalesce("of_keys", none), "geo": F.coalesce("geo", empty), "key_table": F.coalesce("key_table", F.array().cast(KEY_TABLE))})
    native = F.col("is_native").isNotNull()
    kind = F.when(native, TYPE_GEOSPATIAL).when(F.col("method").isin(*WITHOUT_GEOMETRY), TYPE_TABLE).otherwise(TYPE_WITH_GEOMETRY)
    label = F.when(native, LABEL_GEOSPATIAL).otherwise(F.col("label"))
    return filled.select("dataset_id", F.col("totals.n_bad").alias("n_bad"), *report_columns(kind, label, F.col("key_table"), F.col("key_names")))


def batch_profile(
    spark: SparkSession, requested: DataFrame, directory: str, rules: Rules = Rules(), stop_on_error: bool = False, extensions: Sequence[str] = tuple(SUPPORTED_EXTENSIONS)
) -> DataFrame:
    """One row per requested path: file facts and the full report, or a typed error.

    ``requested`` has a ``path`` column and, for an order of its own, a ``position``; a path asked for
    twice has two rows. A path that is missing, of another type, or without columns becomes an error
    row. File scans list no file of zero bytes, so such a file counts as missing. ``stop_on_error``
    leaves out what comes behind the first error in the order of ``position`` (of ``path`` without).
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    facts = listing.select(
        files.path_key(F.col("path")).alias("path"), F.round(F.col("length") / 1024, 2).alias("Taille (Ko)"),
        F.date_format("modificationTime", "yyyy-MM-dd").alias("Date de création du fichier (Y-M-D)"),
    )
    order = F.col("position") if "position" in requested.columns else F.lit(None).cast("bigint")
    asked = requested.select(files.path_key(F.col("path")).alias("path"), order.alias("position")).join(facts, "path", "left").withColumn("ext", files.extension(F.col("path")))
    report = batch_report(spark, directory, rules).withColumnRenamed("dataset_id", "path")
    joined = asked.join(report, "path", "left")
    error = (
        F.when(F.col("Taille (Ko)").isNull(), F.concat(F.lit("File not found: "), F.col("path")))
        .when(~F.col("ext").isin(*extensions), F.concat(F.lit("Unsupported file extension: "), F.col("ext")))
        .when(~F.col("ext").isin(*READABLE), F.concat(F.lit("NotImplementedError: no reader for "), F.col("ext")))
        .when(F.col("`Nb lignes`").isNull(), F.lit("No metadata extracted"))
    )
    done = joined.withColumn("error", error)
    if stop_on_error:
        done = materialize(done, "batch")
        place = F.struct("position", "path")
        first = done.where("error IS NOT NULL").agg(F.min(place).alias("p")).select("p").scalar()
        done = done.where(first.isNull() | (place <= first))
    return done.select(
        "position", F.element_at(F.split("path", "/"), -1).alias("Nom du fichier"), F.col("error").isNull().alias("success"), "error",
        *[c for c in done.columns if c not in ("path", "position", "ext", "error")],
    )
