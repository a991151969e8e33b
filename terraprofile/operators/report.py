"""Report and batch operators (group R)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.functions.tables import ENGLISH, LABEL_NONE, REPORT_COLUMNS
from terraprofile.operators.clean import col

SEPARATOR = " - "
COLUMN_TABLE = "Colonnes"
LARGE_MB = 50
LARGE_SHEET_MB = 10


def flatten_profile(df: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """Nested structs as flat columns; the column table as JSON text and its length."""
    out: list[Column] = []

    def walk(c: Column, dtype: T.DataType, name: str, leaf: str) -> None:
        if leaf == COLUMN_TABLE and isinstance(dtype, T.ArrayType):
            out.append(F.to_json(c).alias("Colonnes (détails)"))
            out.append(F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias("Nb colonnes détaillées"))
        elif isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(c[f.name], f.dataType, f"{name}{sep}{f.name}", f.name)
        else:
            out.append(c.alias(name))

    for f in df.schema.fields:
        walk(col(f.name), f.dataType, f.name, f.name)
    return df.select(*out)


def report_table(df: DataFrame, include_errors: bool = True, success: str = "success", priority: Sequence[str] = REPORT_COLUMNS) -> DataFrame:
    """Result rows with the priority columns first."""
    rows = df if include_errors else df.where(col(success))
    first = [p for p in priority if p in df.columns]
    rest = [c for c in df.columns if c not in first]
    return rows.select(*[col(c) for c in first + rest])


def batch_summary(df: DataFrame) -> DataFrame:
    """Totals of a batch: files, outcomes, time, rows and MB."""
    ok = F.col("success")
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total_files"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.round(F.coalesce(F.try_divide(F.count_if(ok), n) * 100, F.lit(0.0)), 4).alias("success_rate"),
        F.round(F.coalesce(F.sum("elapsed_s"), F.lit(0.0)), 2).alias("total_time"),
        F.round(F.coalesce(F.avg("elapsed_s"), F.lit(0.0)), 4).alias("avg_time_per_file"),
        F.coalesce(F.sum(F.when(ok, F.col("n_rows"))), F.lit(0)).alias("total_rows"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("size_kb"))), F.lit(0.0)) / 1024, 2).alias("total_size_mb"),
    )


def file_type_counts(df: DataFrame) -> DataFrame:
    kind = F.coalesce(F.col("file_type"), F.lit("Unknown"))
    return df.where("success").groupBy(kind.alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


def error_type_counts(df: DataFrame) -> DataFrame:
    """Failures by the text before the first colon."""
    kind = F.coalesce(F.get(F.split("error", ":"), F.lit(0)), F.lit("Unknown"))
    return df.where("not success").groupBy(kind.alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def translate(text: Column, dictionary: dict[str, str] = ENGLISH) -> Column:
    """A text by the dictionary, or itself; the dictionary is a literal of fixed size."""
    table = F.create_map(*[F.lit(v) for pair in dictionary.items() for v in pair])
    return F.coalesce(F.try_element_at(table, text), text)


def translate_rows(df: DataFrame, columns: Sequence[str], dictionary: dict[str, str] = ENGLISH) -> DataFrame:
    """Translate keys and plain text values of long-form report rows."""
    return df.select(*[translate(col(c), dictionary).alias(c) if c in columns else col(c) for c in df.columns])


def translate_headers(df: DataFrame, dictionary: dict[str, str] = ENGLISH) -> DataFrame:
    """Rename columns, and the fields of nested tables, by the dictionary."""

    def renamed(dtype: T.DataType) -> T.DataType:
        if isinstance(dtype, T.StructType):
            return T.StructType([T.StructField(dictionary.get(f.name, f.name), renamed(f.dataType), f.nullable) for f in dtype.fields])
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(renamed(dtype.elementType), dtype.containsNull)
        return dtype

    return df.select(*[col(f.name).cast(renamed(f.dataType)).alias(dictionary.get(f.name, f.name)) for f in df.schema.fields])


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL, dates and times to ISO text, at any depth."""

    def safe(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
        if isinstance(dtype, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            fraction = F.date_format(c, ".SSSSSS")
            return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))
        if isinstance(dtype, T.ArrayType):
            return F.transform(c, lambda e: safe(e, dtype.elementType))
        if isinstance(dtype, T.MapType):
            return F.transform_values(c, lambda _k, v: safe(v, dtype.valueType))
        if isinstance(dtype, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
        return c

    return df.select(*[safe(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def filter_with_geometry(df: DataFrame, label: str) -> DataFrame:
    """Rows whose geometry label says there is one."""
    return df.where(col(label) != LABEL_NONE)


def top_k(df: DataFrame, by: str, tie: str, k: int = 5) -> DataFrame:
    return df.orderBy(col(by).desc_nulls_last(), col(tie)).limit(k)


def group_totals(df: DataFrame, by: str, rows: str) -> DataFrame:
    return df.groupBy(col(by).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.sum(col(rows)).alias("total_rows"))


def totals(df: DataFrame, rows: str, score: str) -> DataFrame:
    return df.agg(
        F.sum(col(rows)).alias("total_rows"), F.round(F.avg(col(rows)), 4).alias("mean_rows"), F.round(F.avg(col(score)), 4).alias("mean_score")
    )


def large_file_flag(size_bytes: Column, ext: Column) -> Column:
    mb = size_bytes / (1024 * 1024)
    return ((F.lower(ext) == ".xlsx") & (mb > LARGE_SHEET_MB)) | (mb > LARGE_MB)
