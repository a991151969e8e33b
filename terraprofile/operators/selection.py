"""Choosing header rows, tables, files and row samples (rest of group A)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraprofile.functions import crs
from terraprofile.functions import geometry as G
from terraprofile.functions.tables import DATA_WORDS, GEO_EXTENSIONS, NOTE_WORDS, TABLE_EXTENSIONS
from terraprofile.operators.clean import col, in_bounds

HEADER_ROWS = 30


def detect_header_row(df: DataFrame, file: str, row_no: str, cells: Sequence[str], rows: int = HEADER_ROWS) -> DataFrame:
    """Per file the likeliest header among its first ``rows`` raw rows, numbered from 0.

    Only those rows enter the window, so a file contributes at most ``rows`` of them.
    """
    filled = lambda c: (c.isNotNull() & (F.trim(c) != "")).cast("int")
    wordy = lambda c: (c.isNotNull() & ~F.translate(c, ".-,", "").rlike(r"^[0-9]+$")).cast("int")
    total = lambda f: sum((f(col(c)) for c in cells), F.lit(0))
    head = df.where(col(row_no) < rows).select(
        col(file).alias("file"), col(row_no).alias("row_no"), total(filled).alias("filled"), total(wordy).alias("wordy")
    )
    w = Window.partitionBy("file").orderBy("row_no")
    nxt = F.lead("filled").over(w)
    scored = head.select("file", "row_no", "filled", "wordy", nxt.alias("next_filled")).where(
        F.col("next_filled").isNotNull() & (F.col("filled") >= 2)
    )
    bonus = (F.col("filled") >= 3) & (F.col("next_filled") >= F.col("filled") * 0.5)
    score = F.round(
        F.col("filled") + F.col("wordy") * 0.5 + F.col("next_filled") * 0.3 + F.when(bonus, 5.0).otherwise(0.0), 6
    )
    best = scored.groupBy("file").agg(F.max_by("row_no", F.struct(score.alias("s"), (-F.col("row_no")).alias("r"))).alias("b"))
    # a file without a candidate starts with its header
    return (
        head.select("file").distinct().join(best, "file", "left").select("file", F.coalesce("b", F.lit(0)).cast("bigint").alias("header_row"))
    )


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def table_score(name: Column, n_rows: Column, n_cols: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(_any_word(lower, NOTE_WORDS), -10.0).otherwise(0.0)
        + F.when(_any_word(lower, DATA_WORDS), 10.0).otherwise(0.0)
        + F.least(F.coalesce(n_rows, F.lit(0)) / 100, F.lit(50.0))
        + F.least(F.coalesce(n_cols, F.lit(0)), F.lit(20))
    )


def pick_data_table(df: DataFrame, group: str, position: str, name: str, n_rows: str, n_cols: str) -> DataFrame:
    """Per group the likeliest data table: best score above -1, earliest on ties, else the first."""
    score = F.round(table_score(col(name), col(n_rows), col(n_cols)), 6)
    row = df.select(col(group).alias("group_id"), col(position).alias("pos"), col(name).alias("name"), score.alias("score"))
    good = F.col("score") > -1
    return row.groupBy("group_id").agg(
        F.coalesce(
            F.max_by(F.when(good, F.col("name")), F.when(good, F.struct("score", (-F.col("pos")).alias("p")))),
            F.min_by("name", "pos"),
        ).alias("table_name")
    )


def archive_primary_file(df: DataFrame, archive: str, name: str, ext: str) -> DataFrame:
    """Per archive: its one data file, its one geospatial file, a batch, or nothing."""
    usable = ~col(name).startswith("._") & F.lower(col(ext)).isin(*GEO_EXTENSIONS, *TABLE_EXTENSIONS)
    geo = usable & F.lower(col(ext)).isin(*GEO_EXTENSIONS)
    shp = usable & (F.lower(col(ext)) == ".shp")
    picked = lambda cond: F.min(F.when(cond, col(name)))
    stats = df.groupBy(col(archive).alias("archive_id")).agg(
        F.count_if(usable).alias("n"), F.count_if(geo).alias("n_geo"), F.count_if(shp).alias("n_shp"),
        picked(usable).alias("only"), picked(geo).alias("geo"), picked(shp).alias("shp"),
    )
    mode = (
        F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").when(F.col("n_geo") == 1, "geo")
        .when(F.col("n_shp") == 1, "shp").otherwise("batch")
    )
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_geo") == 1, F.col("geo")).when(F.col("n_shp") == 1, F.col("shp"))
    return stats.select("archive_id", mode.alias("mode"), chosen.alias("primary_file"))


def preview_rows(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows by key, without geometry columns."""
    keep = [f.name for f in df.schema.fields if not G.is_geometry(f.dataType) and f.name.lower() != "geometry"]
    return df.orderBy(*[col(o) for o in order_by]).limit(n).select(*[col(k) for k in keep])


def shuffled_order(key: str) -> Column:
    """A fixed pseudo-random order of rows by their key, equal on every run."""
    return F.md5(col(key).cast("string"))


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in :func:`shuffled_order`; each task keeps at most ``n``."""
    return df.orderBy(shuffled_order(key), col(key)).limit(n)


def map_sample(df: DataFrame, key: str, x: str, y: str, bounds: Sequence[float], epsg: int, n: int = 1000) -> DataFrame:
    """At most ``n`` in-bounds points in WGS84."""
    rows = df.select(col(key).alias("key"), col(x).alias("x"), col(y).alias("y")).where(in_bounds(F.col("x"), F.col("y"), bounds))
    lon, lat = crs.transformer(epsg, crs.GEOGRAPHIC)(F.col("x"), F.col("y"))
    return sample_rows(rows, "key", n).select("key", lon.alias("lon"), lat.alias("lat"))


def map_view(sample: DataFrame) -> DataFrame:
    """Bounds ``[[s, w], [n, e]]`` and centre ``[lat, lon]`` of a map sample, with its features."""
    w, s, e, n = (f(c) for f, c in ((F.min, "lon"), (F.min, "lat"), (F.max, "lon"), (F.max, "lat")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), G.as_geojson(G.point(F.col("lon"), F.col("lat"))), F.lit("}"))
    features = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", feature.alias("f")))), lambda r: r["f"]), ",")
    return sample.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(F.array(s, w), F.array(n, e)).alias("bounds"),
        F.array((s + n) / 2, (w + e) / 2).alias("center"),
        F.concat(F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}")).alias("geojson"),
    )
