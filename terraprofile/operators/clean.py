"""Row filters, casts and column repairs (group B)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRANCE_BOUNDS = (-5.5, 41.0, 10.0, 51.5)


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_bounds(x: Column, y: Column, bounds: Sequence[float]) -> Column:
    minx, miny, maxx, maxy = bounds
    return x.between(F.lit(float(minx)), F.lit(float(maxx))) & y.between(
        F.lit(float(miny)), F.lit(float(maxy))
    )


def with_coordinates(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both coordinates are present."""
    return df.where(col(x).isNotNull() & col(y).isNotNull())


def filter_bounds(df: DataFrame, x: str, y: str, bounds=FRANCE_BOUNDS) -> DataFrame:
    """Rows whose raw coordinates lie in the bounds, edges included.

    The test is on plain columns, so it reaches the Parquet scan.
    """
    return df.where(in_bounds(col(x), col(y), bounds))


def count_outside_bounds(df: DataFrame, x: str, y: str, bounds=FRANCE_BOUNDS) -> DataFrame:
    """Counts of located, kept and excluded rows in one aggregate."""
    both = col(x).isNotNull() & col(y).isNotNull()
    kept = both & in_bounds(col(x), col(y), bounds)
    return df.agg(
        F.count_if(both).alias("n_located"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(both & ~kept).alias("n_excluded"),
    )


def decimal_comma(value: Column) -> Column:
    """Text or number to double, accepting a decimal comma; bad text is NULL.

    Java-style suffixes such as ``1d``, which Spark's cast would accept, are spoilt first.
    """
    text = F.replace(value.cast("string"), F.lit(","), F.lit("."))
    return F.regexp_replace(text, r"(?<=[0-9.])[dDfF](?=\s*$)", "x").try_cast("double")


def cast_decimal_comma(df: DataFrame, columns: Sequence[str], aliases: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Cast ``columns`` with :func:`decimal_comma` and drop rows with any NULL."""
    cast = df.select(*[col(k) for k in keep], *[decimal_comma(col(c)).alias(a) for c, a in zip(columns, aliases)])
    return cast.dropna(how="any", subset=list(aliases))


def clean_names(names: Sequence[str]) -> list[str]:
    """Header texts with line breaks turned into one space and ends trimmed."""
    return [re.sub(r"\r\n|\n", " ", str(n)).strip() for n in names]


def clean_name_column(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "\\r\\n|\\n", " "), r"^\s+|\s+$", "")


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def exclude_and_add(df: DataFrame, exclude: Sequence[str], **added: Column) -> DataFrame:
    """All columns but ``exclude``, plus computed ones."""
    return df.select(*[col(c) for c in df.columns if c not in set(exclude)], *[e.alias(n) for n, e in added.items()])


# The name rule and the bands of the code repair.
CODE_NAME = r"(dep|reg|insee|com|code)"
REPAIR_BANDS = (
    (3.5, 4.5, 5, "code_insee_commune"),
    (1.0, 1.5, 2, "code_departement"),
)


def _repair_candidates(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and re.search(CODE_NAME, f.name.lower())
    ]


def _code_text(c: str) -> Column:
    return col(c).try_cast("bigint").cast("string")


def code_repair_report(df: DataFrame) -> DataFrame:
    """Columns whose mean digit count shows lost leading zeros: (col, width, label)."""
    names = _repair_candidates(df)
    rows = F.array(
        *[F.struct(F.lit(n).alias("col"), F.avg(F.length(_code_text(n))).alias("mean_length")) for n in names]
    )
    if not names:
        rows = F.array().cast("array<struct<col:string,mean_length:double>>")
    found = df.agg(rows.alias("r")).select(F.inline("r"))
    width = F.lit(None).cast("int")
    label = F.lit(None).cast("string")
    for lo, hi, w, text in REPAIR_BANDS:
        band = (F.col("mean_length") >= lo) & (F.col("mean_length") < hi)
        width = F.when(band, F.lit(w)).otherwise(width)
        label = F.when(band, F.lit(text)).otherwise(label)
    return found.select("col", width.alias("width"), label.alias("label")).where(F.col("width").isNotNull())


def repair_code_columns(df: DataFrame) -> DataFrame:
    """Zero-pad the columns named by :func:`code_repair_report`.

    The result's schema depends on the data, so the report (at most one row
    per candidate column) is read before the projection is built.
    """
    widths = {r["col"]: r["width"] for r in code_repair_report(df).collect()}

    def pad(c: str, width: int) -> Column:
        text = _code_text(c)
        # lpad would cut longer codes
        return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)

    return df.select(*[pad(c, widths[c]).alias(c) if c in widths else col(c) for c in df.columns])
