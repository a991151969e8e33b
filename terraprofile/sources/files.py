"""Readers, writers and inventories of files (group A)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.functions import crs
from terraprofile.functions import geometry as G
from terraprofile.functions.tables import SUPPORTED_EXTENSIONS
from terraprofile.operators.clean import col
from terraprofile.sources import collections

DELIMITERS = [",", ";", "\t", "|"]


# ----------------------------------------------------------------------- reading

def scan_delimited(
    spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", sampling_ratio: float = 1.0, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV or TXT with a header; types are inferred, malformed rows dropped.

    Inference is a pass over the files; give ``schema`` or a lower
    ``sampling_ratio`` for large inputs.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("mode", "DROPMALFORMED")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling_ratio).csv(path)


def scan_delimited_text(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",") -> DataFrame:
    """The same files with every column kept as text."""
    return (
        spark.read.option("header", True).option("sep", delimiter).option("mode", "DROPMALFORMED")
        .option("inferSchema", False).csv(path)
    )


HEAD_BYTES = 1 << 16
FILES_PER_TASK = 256


def file_heads(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Per file its first line and the bytes read for it: file_path, head, n_read.

    The listing is dealt in groups of files, and a task reads a file's first block, and further ones
    only while it has no line end. Stores that only Spark reaches are scanned as text instead.
    """
    listing = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "length")
    counted = listing.agg(F.count(F.lit(1)), F.min("path")).first()
    if not _opens(counted[1]):
        lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
        return lines.mapInArrow(_first_lines, "file_path string, head string, n_read long")
    groups = max(1, -(-counted[0] // FILES_PER_TASK))
    return listing.repartition(groups, "path").mapInArrow(_read_heads, "file_path string, head string, n_read long")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a listed path, and the path in it as it is."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    scheme, _, rest = uri.partition("://")
    authority, _, name = rest.partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{root.rstrip('/')}/{name}"


def _opens(uri: str | None) -> bool:
    """Whether files there can be opened without Spark."""
    try:
        return uri is None or _store(uri)[0] is not None
    except (pa.ArrowException, OSError, ValueError):
        return False


def _read_heads(batches):
    for batch in batches:
        heads, sizes = [], []
        for uri in batch.column(0).to_pylist():
            store, name = _store(uri)
            with store.open_input_file(name) as f:
                text = b""
                while b"\n" not in text and (more := f.read(HEAD_BYTES)):
                    text += more
            heads.append(text.split(b"\n", 1)[0].decode("utf-8", "replace").removesuffix("\r").removeprefix("\ufeff"))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string()), pa.array(sizes, pa.int64())], names=["file_path", "head", "n_read"])


def _first_lines(batches):
    at = None
    for batch in batches:
        rows = []
        for path, block, value in zip(*(c.to_pylist() for c in batch.columns)):
            if block == 0 and path != at:
                rows.append((path, value.removesuffix("\r").removeprefix("\ufeff"), len(value)))
            at = path
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["file_path", "head", "n_read"])


def detect_delimiter(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Per file the first of ``, ; TAB |`` that splits its header; ``,`` if none does.

    Only the heads of the files are read.
    """
    return file_heads(spark, path).select("file_path", header_delimiter(F.col("head")).alias("delimiter"))


def header_delimiter(header: Column) -> Column:
    chosen = F.lit(",")
    for d in reversed(DELIMITERS):
        chosen = F.when(F.contains(header, F.lit(d)), F.lit(d)).otherwise(chosen)
    return chosen


FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "geometry",
            T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
        ),
    ]
)


def _with_properties(properties: T.StructType | None) -> T.StructType:
    kind = properties if properties is not None else T.MapType(T.StringType(), T.StringType())
    return T.StructType([*FEATURE.fields, T.StructField("properties", kind)])


def _feature_columns(f: Column, properties: T.StructType | None) -> list[Column]:
    geometry = G.from_geojson_value(f["geometry"]["type"], f["geometry"]["coordinates"]).alias("geometry")
    if properties is None:
        return [f["properties"].alias("properties"), geometry]
    return [*[f["properties"][n].alias(n) for n in properties.fieldNames()], geometry]


def _parsed(texts: DataFrame, properties: T.StructType | None) -> DataFrame:
    """Feature structs of feature texts; one that can't be read is NULL."""
    f = F.from_json("value", _with_properties(properties))
    readable = ~F.col("broken") & F.get_json_object("value", "$").isNotNull()
    return texts.select("path", F.when(readable, f).alias("f"))


def scan_geojson(spark: SparkSession, path: str, properties: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """Features of GeoJSON files as property columns and a geometry.

    ``lines=True`` reads one feature per line. Collections are cut by bytes, so one large file is
    the work of many tasks; features that can't be read are left out (:func:`feature_counts`).
    """
    if lines:
        feature = _with_properties(properties)
        rows = spark.read.schema(feature).json(path).select(F.struct(*feature.fieldNames()).alias("f"))
        rows = rows.where(F.col("f.type") == "Feature")
    else:
        rows = _parsed(collections.feature_texts(spark, path), properties).where("f IS NOT NULL")
    return rows.select(*_feature_columns(F.col("f"), properties))


def feature_counts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Per collection: file_path, n_features, and n_bad of them that can't be read."""
    rows = _parsed(collections.feature_texts(spark, path, glob), None)
    return rows.groupBy(F.col("path").alias("file_path")).agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("f").isNull()).alias("n_bad"))


def geojson_features(spark: SparkSession, directory: str, glob: str = "*.{geojson,json}") -> DataFrame:
    """Features of all collections of a directory with the file they come from; ``readable`` is false for bad ones."""
    rows = _parsed(collections.feature_texts(spark, directory, glob), None)
    return rows.select(path_key(F.col("path")).alias("dataset_id"), F.col("f").isNotNull().alias("readable"), *_feature_columns(F.col("f"), None))


# --------------------------------------------------------------------- inventory

def path_key(path: Column) -> Column:
    """One spelling of a file's path: scans encode it and differ in slashes."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^([a-z0-9]+):/+", "$1:/")


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def dataset_inventory(
    spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = True, extensions: Sequence[str] | None = None
) -> DataFrame:
    """Files of a directory: path, name, extension, KiB and modification day.

    The listing is a ``binaryFile`` scan without the content column, so no file
    is opened.
    """
    wanted = list(extensions or SUPPORTED_EXTENSIONS)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(directory)
        .select("path", "length", "modificationTime")
    )
    ext = extension(F.col("path"))
    return (
        files.where(ext.isin(*wanted))
        .select(
            "path",
            F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file_name"),
            ext.alias("extension"),
            F.round(F.col("length") / 1024, 2).alias("size_kb"),
            F.date_format("modificationTime", "yyyy-MM-dd").alias("modified"),
        )
        .orderBy("path")
    )


# ----------------------------------------------------------------------- writing

def feature_text(df: DataFrame, geometry: str, epsg: int | None) -> DataFrame:
    """One GeoJSON feature per row, in WGS84; rows without geometry are dropped."""
    g = col(geometry)
    source = epsg or crs.GEOGRAPHIC
    moved = g if source == crs.GEOGRAPHIC else G.map_coordinates(g, crs.move_struct(source, crs.GEOGRAPHIC))
    names = [c for c in df.columns if c != geometry]
    props = F.to_json(F.struct(*[col(c) for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return df.where(G.present(g)).select(
        F.concat(
            F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), G.as_geojson(moved), F.lit("}")
        ).alias("value")
    )


def write_geojson(df: DataFrame, geometry: str, path: str, epsg: int | None = None) -> None:
    """Line-delimited GeoJSON features, written in parallel."""
    feature_text(df, geometry, epsg).write.text(path)


def wkt_table(df: DataFrame, geometry: str, epsg: int | None) -> DataFrame:
    """The table with its geometry as a WGS84 ``geometry_wkt`` text column."""
    g = col(geometry)
    source = epsg or crs.GEOGRAPHIC
    moved = g if source == crs.GEOGRAPHIC else G.map_coordinates(g, crs.move_struct(source, crs.GEOGRAPHIC))
    return df.where(G.present(g)).select(
        *[col(c) for c in df.columns if c != geometry], G.as_wkt(moved).alias("geometry_wkt")
    )


def write_wkt_csv(df: DataFrame, geometry: str, path: str, epsg: int | None = None) -> None:
    wkt_table(df, geometry, epsg).write.option("header", True).csv(path)


def flat_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, others unchanged."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
            for f in df.schema.fields
        ]
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv", flatten: bool = True) -> None:
    """A report table as CSV (nested values as JSON text) or JSON lines."""
    if fmt == "csv":
        flat_text(df).write.option("header", True).csv(path)
    elif fmt == "json":
        (flat_text(df) if flatten else df).write.json(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")


