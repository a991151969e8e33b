"""Temporal profile (group T): date columns, coverage, histogram, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.operators.clean import col

MIN_DATE_RATE = 0.5
DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def date_columns(df: DataFrame) -> DataFrame:
    """Columns that hold dates, by type or because at least half their texts parse."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            rate = F.lit(1.0)
        elif isinstance(f.dataType, T.StringType):
            # plain digits would parse as a year
            parsed = c.rlike(DATE_TEXT) & F.try_to_timestamp(c).isNotNull()
            rate = F.avg(F.when(c.isNotNull(), parsed.cast("double")))
        else:
            continue
        rows.append(
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(f.name).alias("column"),
                F.round(rate, 4).alias("date_rate"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame([], "position bigint, column string, date_rate double")
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).where(F.col("date_rate") >= MIN_DATE_RATE)


def date_coverage(df: DataFrame, column: str) -> DataFrame:
    """First and last day, span, distinct days and the share of days present."""
    day = F.to_date(col(column))
    # at most one row per calendar day reaches the final aggregate
    days = df.where(col(column).isNotNull()).groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    span = F.datediff(F.max("d"), F.min("d")) + 1
    return days.agg(
        F.min("d").alias("first_day"),
        F.max("d").alias("last_day"),
        span.cast("bigint").alias("span_days"),
        F.count(F.lit(1)).alias("present_days"),
        F.round(F.count(F.lit(1)) / span * 100, 2).alias("coverage_pct"),
        F.sum("n").alias("n_rows"),
    )


def date_histogram(df: DataFrame, column: str, unit: str = "month") -> DataFrame:
    """Row count per day or month."""
    bucket = F.to_date(F.date_trunc(unit, col(column)))
    return df.where(col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


def interval_median_duration(df: DataFrame, start: str, end: str) -> DataFrame:
    """Exact median length of intervals in days.

    The aggregate holds a count per distinct number of days, and dates of the
    calendar allow fewer than four million of those.
    """
    days = F.datediff(col(end), col(start))
    return df.agg(F.count(days).alias("n_intervals"), F.median(days).cast("double").alias("median_days"))


def occupancy_curve(df: DataFrame, start: str, end: str) -> DataFrame:
    """Number of intervals active on each day on which that number changes.

    Intervals become a +1 on their first day and a -1 after their last one and
    are summed per day first, so the running total walks calendar days (fewer
    than four million), not intervals.
    """
    changes = (
        df.where(col(start).isNotNull() & col(end).isNotNull())
        .select(
            F.explode(
                F.array(
                    F.struct(F.to_date(col(start)).alias("day"), F.lit(1).cast("bigint").alias("delta")),
                    F.struct(F.date_add(F.to_date(col(end)), 1).alias("day"), F.lit(-1).cast("bigint").alias("delta")),
                )
            ).alias("e")
        )
        .groupBy(F.col("e.day").alias("day"))
        .agg(F.sum("e.delta").alias("delta"))
    )
    # two steps: totals of years (fewer than ten thousand rows), then days within a year
    yearly = changes.groupBy(F.year("day").alias("y")).agg(F.sum("delta").alias("t"))
    before = yearly.select(
        "y", F.coalesce(F.sum("t").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("y").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        changes.withColumn("y", F.year("day"))
        .withColumn("running", F.sum("delta").over(within))
        .join(before, "y")
        .select("day", (F.col("running") + F.col("before")).alias("active"))
    )
