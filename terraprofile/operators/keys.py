"""Geographic join-key detection and granularity (group D).

Name rules are applied to the schema or to a column catalog; the definitions
are fixed literals inside the plan, so no join is needed to match them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.functions.tables import COUNTRIES, DEFAULT_COUNTRY, KEY_DEFINITIONS
from terraprofile.operators.clean import col

MIN_MATCH_RATE = 0.5
KEY_COLUMNS = "column string, def_no bigint, label string"


def definitions(country: str | None) -> list[tuple[int, str, list[str], str | None]]:
    """Key definitions of a country with their order; ``custom`` has none."""
    name = (country or DEFAULT_COUNTRY).lower()
    if name == "custom":
        return []
    found = KEY_DEFINITIONS.get(name, KEY_DEFINITIONS[DEFAULT_COUNTRY])
    return [(i, label, patterns, fmt) for i, (label, patterns, fmt) in enumerate(found)]


def key_name_candidates(catalog: DataFrame, country: str | None = DEFAULT_COUNTRY) -> DataFrame:
    """Catalog columns whose lower-cased name contains a definition's substring."""
    name = F.lower(F.col("column"))
    hits = []
    for no, label, patterns, fmt in definitions(country):
        named = reduce(lambda a, b: a | b, [name.contains(p) for p in patterns])
        hits.append(
            F.when(
                named,
                F.struct(
                    F.lit(no).cast("bigint").alias("def_no"),
                    F.lit(label).alias("label"),
                    F.lit(fmt).cast("string").alias("value_format"),
                ),
            )
        )
    listed = F.array_compact(F.array(*hits)) if hits else F.array().cast(
        "array<struct<def_no:bigint,label:string,value_format:string>>"
    )
    keep = [c for c in ("dataset_id", "position", "column", "non_null", "n") if c in catalog.columns]
    return catalog.select(*keep, F.inline(listed))


def skip_all_null(candidates: DataFrame) -> DataFrame:
    """Drop candidates of columns without any value."""
    return candidates.where(F.col("non_null") > 0)


def _named_definitions(df: DataFrame, country: str | None):
    return [
        (c, no, label, fmt)
        for c in df.columns
        for no, label, patterns, fmt in definitions(country)
        if any(p in c.lower() for p in patterns)
    ]


def matches_format(value: Column, fmt: str) -> Column:
    """Whether the stripped value matches from its start."""
    return F.regexp_replace(value, r"^\s+|\s+$", "").rlike(f"^(?:{fmt})")


def key_value_match_rate(
    df: DataFrame, order_by: list[str] | None = None, country: str | None = DEFAULT_COUNTRY, sample: int | None = None
) -> DataFrame:
    """Share of values that fit each candidate definition's format.

    All values are tested, in a single wide aggregate. With ``sample`` only the
    first values by ``order_by`` are, one ordered limit per column, which keeps
    only ``sample`` rows per task. A definition
    without a format has a NULL rate.
    """
    found = _named_definitions(df, country)
    ddl = "column string, def_no bigint, label string, n_tested bigint, match_rate double"
    if not found:
        return df.sparkSession.createDataFrame([], ddl)

    def row(name: str, no: int, label: str, fmt: str | None, value: Column) -> Column:
        rate = F.avg(matches_format(value, fmt).cast("double")) if fmt else F.lit(None).cast("double")
        return F.struct(
            F.lit(name).alias("column"),
            F.lit(no).cast("bigint").alias("def_no"),
            F.lit(label).alias("label"),
            F.count(value).alias("n_tested"),
            rate.alias("match_rate"),
        )

    if sample is None:
        rows = [row(c, no, label, fmt, col(c).cast("string")) for c, no, label, fmt in found]
        return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))

    parts = []
    for c in dict.fromkeys(name for name, *_ in found):
        order = [col(o) for o in (order_by or [c])]
        values = df.where(col(c).isNotNull()).orderBy(*order).limit(sample).select(col(c).cast("string").alias("v"))
        rows = [row(n, no, label, fmt, F.col("v")) for n, no, label, fmt in found if n == c]
        parts.append(values.agg(F.array(*rows).alias("r")).select(F.inline("r")))
    return reduce(DataFrame.unionByName, parts)


def first_passing(rates: DataFrame) -> DataFrame:
    """Per column the first definition whose values pass."""
    passing = rates.where(
        (F.col("n_tested") > 0) & (F.col("match_rate").isNull() | (F.col("match_rate") >= MIN_MATCH_RATE))
    )
    return (
        passing.groupBy("column")
        .agg(F.min(F.struct("def_no", "label")).alias("k"))
        .select("column", F.col("k.def_no").alias("def_no"), F.col("k.label").alias("label"))
    )


def key_detect(
    df: DataFrame, order_by: list[str] | None = None, country: str | None = DEFAULT_COUNTRY, sample: int | None = None
) -> DataFrame:
    """Join keys of a table: (column, def_no, label)."""
    if not definitions(country):
        return key_detect_by_length(df).select("column", F.lit(0).cast("bigint").alias("def_no"), "label")
    return first_passing(key_value_match_rate(df, order_by, country, sample))


# The name rule and the labels of the length heuristics.
LENGTH_NAME = r"(dep|reg|insee|com|code|postal|commune|departement|département)"
LABEL_INSEE = "Code INSEE ou commune"
LABEL_ZEROS_LOST = "Code INSEE ou commune (zéros perdus)"
LABEL_REGION = "Code region"
LABEL_DEPARTMENT = "Code departement (extrait)"
LABEL_COMMUNE_PART = "Code INSEE ou commune (extrait)"
LABEL_EITHER = "Code region ou departement"


def _short_label(word: str) -> str:
    for mark, label in (("reg", LABEL_REGION), ("dep", LABEL_DEPARTMENT), ("dép", LABEL_DEPARTMENT), ("com", LABEL_COMMUNE_PART)):
        if mark in word:
            return label
    return LABEL_EITHER


def key_length_stats(df: DataFrame) -> DataFrame:
    """(column, is_numeric, word, mean_length) of name-matched columns, from one scan."""
    rows = []
    for f in df.schema.fields:
        hit = re.search(LENGTH_NAME, f.name.lower())
        if not hit:
            continue
        c = col(f.name)
        numeric = isinstance(f.dataType, T.NumericType)
        text = c.cast("string")
        digits = F.round(c).try_cast("bigint").cast("string") if numeric else text
        inner = F.nullif(F.regexp_extract(text, r"\(([^)]+)\)", 1), F.lit(""))
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(numeric).alias("is_numeric"),
                F.lit(hit.group(0)).alias("word"),
                F.lit(_short_label(hit.group(0))).alias("short_label"),
                F.count(c).alias("non_null"),
                F.coalesce(F.avg(F.length(inner)), F.avg(F.length(digits))).alias("mean_length"),
            )
        )
    ddl = "column string, is_numeric boolean, word string, short_label string, non_null bigint, mean_length double"
    if not rows:
        return df.sparkSession.createDataFrame([], ddl)
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def key_detect_by_length(df: DataFrame) -> DataFrame:
    """Join keys from names and mean code lengths, where no definitions apply."""
    stats = key_length_stats(df).where(F.col("non_null") > 0)
    n = F.col("mean_length")
    label = (
        F.when(n.between(4.5, 5.5), F.when(F.col("is_numeric"), LABEL_ZEROS_LOST).otherwise(LABEL_INSEE))
        .when(n.between(3.5, 4.5), F.lit(LABEL_ZEROS_LOST))
        .when(n.between(1.5, 3.5), F.col("short_label"))
    )
    return stats.select("column", label.alias("label"), F.round("mean_length", 4).alias("mean_length")).where(
        F.col("label").isNotNull()
    )


def key_report(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("label").alias("Reference area"), F.col("column").alias("Identified key"))


# Words that mark a level, from finest to coarsest.
LEVELS = [
    ("Commune / INSEE", ["insee", "code_insee", "commune", "postal"]),
    ("Département", ["departement", "département", "code_departement"]),
    ("Région", ["region", "région", "code_region"]),
]


def granularity(geometry_types: Column, key_names: Column) -> Column:
    """Spatial level from geometry kinds and key column names, as one text."""
    kinds = F.lower(F.coalesce(geometry_types, F.lit("")))
    shape = (
        F.when(kinds.contains("point"), F.lit("Ponctuelle (géométrie)"))
        .when(kinds.contains("line"), F.lit("Linéaire (géométrie)"))
        .when(kinds.contains("polygon"), F.lit("Surfacique (géométrie)"))
    )
    names = F.lower(F.coalesce(key_names, F.lit("")))
    level = F.lit(None).cast("string")
    for label, words in reversed(LEVELS):
        level = F.when(reduce(lambda a, b: a | b, [names.contains(w) for w in words]), F.lit(label)).otherwise(level)
    text = F.concat_ws(" + ", shape, level)
    return F.when(text == "", F.lit("Inconnue")).otherwise(text)


def country_parameters(country: Column) -> Column:
    """``struct<epsg, minx, miny, maxx, maxy>`` of a country; unknown names mean France."""

    def params(name: str) -> Column:
        epsg, bounds = COUNTRIES[name]
        return F.struct(
            F.lit(epsg).alias("epsg"),
            *[F.lit(float(b)).alias(k) for k, b in zip(("minx", "miny", "maxx", "maxy"), bounds)],
        )

    known = F.create_map(*[v for name in COUNTRIES for v in (F.lit(name), params(name))])
    return F.coalesce(F.try_element_at(known, F.lower(country)), params(DEFAULT_COUNTRY))


def country_lookup(df: DataFrame, country: str) -> DataFrame:
    """Add the metric code and bounds of each row's country."""
    return df.select("*", country_parameters(col(country)).alias("p")).select(
        "*", *[F.col(f"p.{k}").alias(k) for k in ("epsg", "minx", "miny", "maxx", "maxy")]
    ).drop("p")
