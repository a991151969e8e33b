"""Table profile aggregates (group C).

Everything a table profile needs comes from one wide aggregate per table; the
per-column figures are then unpacked from the single result row with ``inline``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.functions import geometry as G
from terraprofile.operators.clean import col

EXAMPLE_LENGTH = 100


def row_column_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def example(df: DataFrame, name: str) -> Column:
    """Aggregate: the smallest value as text, so that an example is the same on every run."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.MapType):
        return F.min(F.to_json(col(name)))
    return as_text(F.min(col(name)), dtype)


def as_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text; geometry structs as WKT, nested values as JSON."""
    if G.is_geometry(dtype):
        return G.as_wkt(c)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def null_ratio_per_column(df: DataFrame) -> DataFrame:
    """(position, column, null_ratio) for every column, from one scan."""
    if len(df.columns) > COMPILED_COLUMNS:
        ratio = F.try_divide(F.col("n") - F.col("non_null"), F.col("n"))
        return _folded(df, with_samples=False).select("position", "column", ratio.alias("null_ratio"))
    return _unpack(
        df,
        [
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(n).alias("column"),
                F.avg(col(n).isNull().cast("double")).alias("null_ratio"),
            )
            for i, n in enumerate(df.columns)
        ],
        "position bigint, column string, null_ratio double",
    )


# a wider aggregate would leave whole-stage code generation, and is folded in Arrow batches instead
COMPILED_COLUMNS = 30
_FOLDABLE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _unpack(df: DataFrame, structs: Sequence[Column], ddl: str) -> DataFrame:
    """One row per struct of aggregates."""
    if not structs:
        return df.sparkSession.createDataFrame([], ddl)
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def _least(values: pa.Array) -> pa.Scalar | None:
    """The smallest value as Spark orders values: NaN behind all numbers."""
    values = values.drop_null()
    if pa.types.is_floating(values.type):
        numbers = values.filter(pc.invert(pc.is_nan(values)))
        values = numbers if len(numbers) else values[:1]
    return pc.min(values) if len(values) else None


def _folded(df: DataFrame, with_samples: bool = True) -> DataFrame:
    """(position, column, type, non_null, n, sample) of a table of any width, from one scan.

    Every task folds its rows into one state per column, its present values and the smallest, and
    emits one row; only these rows are aggregated. Nested values can't be ordered in a batch and
    take one more aggregate over their columns alone.
    """
    fields = list(df.schema.fields)
    foldable = [isinstance(f.dataType, _FOLDABLE) for f in fields]
    # nested columns are only counted here
    source = df.select(*[col(f.name).alias(f"c{i}") if foldable[i] else F.when(col(f.name).isNotNull(), True).alias(f"c{i}") for i, f in enumerate(fields)])
    sampled = [i for i in range(len(fields)) if foldable[i] and with_samples]

    def run(batches):
        n, counts, least = 0, [0] * len(fields), {}
        for batch in batches:
            n += batch.num_rows
            for i, values in enumerate(batch.columns):
                counts[i] += len(values) - values.null_count
            for i in sampled:
                found = _least(batch.column(i))
                if found is not None:
                    held = least.get(i)
                    least[i] = found if held is None else _least(pa.array([held.as_py(), found.as_py()], found.type))
        columns = [pa.array([n], pa.int64()), *(pa.array([c], pa.int64()) for c in counts)]
        if n:
            columns += [pa.array([least[i].as_py() if i in least else None], batch.column(i).type) for i in sampled]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    schema = T.StructType(
        [T.StructField("n", T.LongType()), *(T.StructField(f"n{i}", T.LongType()) for i in range(len(fields))), *(T.StructField(f"m{i}", fields[i].dataType) for i in sampled)]
    )
    states = source.mapInArrow(run, schema)
    total = F.coalesce(F.sum("n"), F.lit(0))
    nested = [i for i in range(len(fields)) if not foldable[i]] if with_samples else []
    examples = df.agg(*[example(df, fields[i].name).alias(f"s{i}") for i in nested]).select(F.struct("*")).scalar() if nested else None

    def sample(i: int) -> Column:
        if i in sampled:
            return as_text(F.min(f"m{i}"), fields[i].dataType)
        return F.max(examples[f"s{i}"]) if i in nested else F.lit(None).cast("string")

    structs = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("non_null"), total.alias("n"), sample(i).alias("sample"),
        )
        for i, f in enumerate(fields)
    ]
    return states.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean and spread of completeness over columns, in percent.

    No column gives 0 and 0; a table without rows gives 100 and 0.
    """
    names = df.columns if columns is None else list(columns)
    if not names:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("mean_pct"), F.lit(0.0).alias("std_pct"))
    ratios = null_ratio_per_column(df.select(*[col(n) for n in names]))
    return ratios.agg(
        F.round((1 - F.coalesce(F.avg("null_ratio"), F.lit(0.0))) * 100, 1).alias("mean_pct"),
        F.round(F.coalesce(F.stddev_pop("null_ratio"), F.lit(0.0)) * 100, 1).alias("std_pct"),
    )


def column_catalog(df: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """One row per column: type, counts and a deterministic example.

    This is the input of the encoding and key detectors, so that they run as
    one job over any number of datasets.
    """
    if len(df.columns) > COMPILED_COLUMNS:
        rows = _folded(df)
    else:
        structs = [
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(n).alias("column"),
                F.lit(df.schema[n].dataType.simpleString()).alias("type"),
                F.count(col(n)).alias("non_null"),
                F.count(F.lit(1)).alias("n"),
                example(df, n).alias("sample"),
            )
            for i, n in enumerate(df.columns)
        ]
        rows = _unpack(df, structs, "position bigint, column string, type string, non_null bigint, n bigint, sample string")
    return rows if dataset_id is None else rows.select(F.lit(dataset_id).alias("dataset_id"), "*")


def column_details(df: DataFrame) -> DataFrame:
    """Name, type, example of at most 100 characters, missing count."""
    return details_of_catalog(column_catalog(df))


def details_of_catalog(catalog: DataFrame) -> DataFrame:
    keys = [c for c in catalog.columns if c == "dataset_id"]
    return catalog.select(
        *keys,
        "position",
        "column",
        F.coalesce(F.substring("sample", 1, EXAMPLE_LENGTH), F.lit("N/A")).alias("example"),
        "type",
        (F.col("n") - F.col("non_null")).alias("missing"),
    )


def profile_grouped(df: DataFrame, dataset: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Profile every dataset of a same-schema collection in one grouped job.

    ``dataset`` is usually ``_metadata.file_path``. All figures are partially
    aggregated before the shuffle, so one dominant dataset does not skew it.
    """
    names = [c for c in df.columns] if columns is None else list(columns)
    structs = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(n).alias("column"),
            F.lit(df.schema[n].dataType.simpleString()).alias("type"),
            F.count(col(n)).alias("non_null"),
            F.count(F.lit(1)).alias("n"),
            example(df, n).alias("sample"),
        )
        for i, n in enumerate(names)
    ]
    return (
        df.groupBy(dataset.alias("dataset_id"))
        .agg(F.array(*structs).alias("r"))
        .select("dataset_id", F.inline("r"))
    )


def profile_many(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Profile datasets of different schemas: the union of their catalogs."""
    return reduce(DataFrame.unionByName, [column_catalog(df, name) for name, df in datasets.items()])


def dataset_completeness(catalog: DataFrame) -> DataFrame:
    """Rows, columns and completeness per dataset of a catalog."""
    ratio = F.when(F.col("n") > 0, 1 - F.col("non_null") / F.col("n"))
    return catalog.groupBy("dataset_id").agg(
        F.max("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_columns"),
        F.round((1 - F.coalesce(F.avg(ratio), F.lit(0.0))) * 100, 1).alias("mean_pct"),
        F.round(F.coalesce(F.stddev_pop(ratio), F.lit(0.0)) * 100, 1).alias("std_pct"),
    )
