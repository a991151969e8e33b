"""Decisions on the reference's unclear or broken behaviours, one test each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraprofile.functions import tables
from terraprofile.operators import clean, detect, keys, locate, metrics, profile, report, selection, temporal
from terraprofile.plans.dataset_profile import METRIC_DDL, Rules, dataset_profile, profile_geometry, profile_points
from terraprofile.functions import geometry as G
from terraprofile.session import scratch_path
from terraprofile.sources import files


def lonlat(spark, n=400):
    rng = np.random.default_rng(7)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "lon": rng.uniform(-4, 8, n), "lat": rng.uniform(42, 51, n)}))


def test_areas_are_metric_unless_source_units_are_asked_for(spark):
    df = lonlat(spark)
    metric = profile_points(df, "lon", "lat").first()
    source = profile_points(df, "lon", "lat", Rules(source_units=True, digits=12)).first()
    assert 500_000 < metric["extent_km2"] < 1_200_000
    assert 0 < source["extent_km2"] < 0.001
    assert metric["fill_rate_pct"] == 100.0 and metric["crs"] == "EPSG:4326"


def test_bounds_apply_to_geographic_data_only(spark):
    df = spark.createDataFrame([(700000.0 + i, 6600000.0 + 2 * i) for i in range(50)], "x double, y double")
    kept = profile_points(df, "x", "y").first()
    assert kept["n_objects"] == 50 and kept["crs"] == "EPSG:2154"
    none = profile_points(df, "x", "y", Rules(always_filter=True)).first()
    assert none["n_objects"] == 0 and none["crs"] is None and none["extent_km2"] is None
    assert set(none.asDict()) == {c.split()[0] for c in METRIC_DDL.split(", ")}


def test_unknown_crs_keeps_other_figures(spark):
    df = spark.createDataFrame([(1e8 + i, 2e8 + i % 7) for i in range(30)], "x double, y double")
    r = profile_points(df, "x", "y").first()
    assert r["crs"] == "Unknown" and r["n_objects"] == 30 and r["coverage_pct"] is None


def test_polygon_extent_is_the_envelope(spark):
    w = ["POLYGON ((700000 6600000, 701000 6600000, 701000 6601000, 700000 6601000, 700000 6600000))", "POLYGON ((709000 6609000, 710000 6609000, 710000 6610000, 709000 6610000, 709000 6609000))"]
    df = spark.createDataFrame([(t,) for t in w], "w string").select(G.from_wkt(F.col("w")).alias("g"))
    r = profile_geometry(df, "g").first()
    assert r["extent_km2"] == 100.0 and r["complexity"] == 5.0 and r["geometry_types"] == "Polygon"


def test_key_completeness_survives_without_geometry(spark):
    df = spark.createDataFrame([(f"{i:05d}" if i % 2 else None, i) for i in range(1000, 1100)], "code_insee string, v int")
    row = report.flatten_profile(dataset_profile(df, "t", key_order=["v"])).first().asDict()
    assert row["Score de complétude des clés géographique - Score de complétude moyen (%)"] == 50.0
    assert row["CRS"] is None and row["Granularité"] == "Commune / INSEE"
    assert row["Géotransformation"] == tables.LABEL_KEYS and row["Nb lignes"] == 100


def test_repair_measures_digits_not_text(spark):
    df = spark.createDataFrame([(1234.0,), (None,), (5678.0,)], "code_com double")
    assert [r["code_com"] for r in clean.repair_code_columns(df).collect()] == ["01234", None, "05678"]
    short = spark.createDataFrame([(1,), (7,), (12,)], "dep int")
    assert clean.code_repair_report(short).first()["width"] == 2
    assert [r["dep"] for r in clean.repair_code_columns(short).collect()] == ["01", "07", "12"]
    assert clean.repair_code_columns(spark.createDataFrame([(1, "a")], "n int, dep string")).first() == (1, "a")


def test_all_values_decide_unless_a_sample_is_asked_for(spark):
    # the first hundred by key fit, the rest do not
    df = spark.range(1000).select("id", F.when(F.col("id") < 100, F.lpad(F.col("id").cast("string"), 5, "0")).otherwise(F.lit("x")).alias("insee"))
    assert keys.key_detect(df.repartition(7), ["id"], sample=100).first()["label"] == "Code INSEE commune"
    assert keys.key_detect(df, ["id"]).count() == 0


def test_first_definition_labels_the_column(spark):
    df = spark.createDataFrame([(i, f"{i:05d}") for i in range(50)], "id int, commune_postal string")
    assert keys.key_detect(df, ["id"]).first()["label"] == "Code INSEE commune"


def test_spanish_patterns_are_two():
    assert {"postal", "cp"} <= set(tables.KEY_DEFINITIONS["spain"][0][1])


def test_custom_country_uses_lengths(spark):
    df = spark.createDataFrame([("75", "Zone (12)", 1234)] * 3, "code_dep string, region string, code_commune int")
    got = {r["column"]: r["label"] for r in keys.key_detect(df, country="custom").collect()}
    assert got == {"code_dep": keys.LABEL_EITHER, "region": keys.LABEL_REGION, "code_commune": keys.LABEL_ZEROS_LOST}


def test_labels_of_xy_and_none(spark):
    xy = detect.detect_geometry(profile.column_catalog(spark.createDataFrame([(1.0, 2.0)], "x double, y double"))).first()
    assert (xy["method"], xy["columns"], xy["label"]) == ("points_from_xy", ["x", "y"], tables.LABEL_PAIR)
    none = detect.detect_geometry(profile.column_catalog(spark.createDataFrame([(1,)], "v int"))).first()
    assert none["label"] == tables.LABEL_NONE and none["columns"] == []


@pytest.mark.parametrize(
    "names, expected",
    [
        (["geo_point"], "none"),  # an underscore is a word character
        (["geo-point"], "geopoint"),
        (["lat", "lng"], "points_from_xy"),
        (["latitude", "long"], "points_from_xy"),
        (["x_debut", "y_debut", "x_fin", "y_fin"], "linestring_coords"),
        (["x_1", "y_1"], "points_from_xy"),
        (["x_1", "y_2"], "none"),
        (["adresse postale"], "geocoding_required"),
        (["Region"], "join_required"),
    ],
)
def test_encoding_names(spark, names, expected):
    df = spark.createDataFrame([tuple("45.1, 3.2" for _ in names)], ", ".join(f"`{n}` string" for n in names))
    assert detect.detect_geometry(profile.column_catalog(df)).first()["method"] == expected


def test_empty_table_is_complete(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert tuple(profile.completeness(empty).first()) == (100.0, 0.0)
    assert tuple(profile.completeness(empty, ["a"]).first()) == (100.0, 0.0)
    assert tuple(profile.completeness(empty, []).first()) == (0.0, 0.0)


def test_null_counts_add_up(spark):
    a = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    b = spark.createDataFrame([(None, None)], "a int, b string")
    missing = lambda df: {r["column"]: r["missing"] for r in profile.column_details(df).collect()}
    both = missing(a.unionByName(b))
    assert both == {k: missing(a)[k] + missing(b)[k] for k in both}


def test_duplicates_count_null_as_a_value_and_ignore_order(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "k int, v string")
    r = metrics.duplicates(df.repartition(5), F.col("v")).first()
    assert (r["n_total"], r["n_unique"], r["n_duplicates"], r["duplicate_pct"]) == (5, 3, 2, 40.0)
    assert metrics.duplicates(df.limit(0), F.col("v")).first()["duplicate_pct"] == 0.0


def test_report_columns_first_whatever_the_last_row(spark):
    df = spark.createDataFrame([(1, "CSV", True, "a"), (2, "CSV", False, "b")], "`Nb lignes` int, `Type de fichier` string, success boolean, filepath string")
    assert report.report_table(df).columns == ["filepath", "success", "Type de fichier", "Nb lignes"]


def test_glob_is_the_whole_pattern(spark):
    root = scratch_path(spark, "glob")
    df = spark.range(10).selectExpr("id", "id * 2 AS v")
    df.write.option("header", True).csv(f"{root}/a")
    df.write.json(f"{root}/b")
    assert {r["extension"] for r in files.dataset_inventory(spark, root).collect()} == {".csv", ".json"}
    assert {r["extension"] for r in files.dataset_inventory(spark, root, pattern="*.csv").collect()} == {".csv"}


def test_archive_rules(spark):
    rows = [(1, "._a.csv", ".csv"), (1, "b.pdf", ".pdf"), (2, "a.csv", ".csv"), (3, "a.csv", ".csv"), (3, "b.gpkg", ".gpkg"), (4, "a.csv", ".csv"), (4, "b.csv", ".csv"), (5, "a.shp", ".shp"), (5, "b.json", ".json")]
    got = {r["archive_id"]: (r["mode"], r["primary_file"]) for r in selection.archive_primary_file(spark.createDataFrame(rows, "a int, n string, e string"), "a", "n", "e").collect()}
    assert got == {1: ("none", None), 2: ("single", "a.csv"), 3: ("geo", "b.gpkg"), 4: ("batch", None), 5: ("shp", "a.shp")}


def test_json_safe_is_deep(spark):
    df = spark.createDataFrame([([float("nan"), 1.0],)], "a array<double>").select("a", F.struct(F.lit(float("-inf")).alias("x"), F.lit("2024-01-02").cast("date").alias("d")).alias("s"))
    r = report.json_safe(df).first()
    assert r["a"] == [None, 1.0] and r["s"]["x"] is None and r["s"]["d"] == "2024-01-02"


def test_decimal_comma(spark):
    rows = spark.createDataFrame([("1,5",), ("1.5",), ("1d",), ("n/a",), ("",), ("-2e3",), (None,)], "v string")
    assert [r[0] for r in rows.select(clean.decimal_comma(F.col("v"))).collect()] == [1.5, 1.5, None, None, None, -2000.0, None]


def test_occupancy_returns_to_zero(spark):
    df = spark.createDataFrame([("2023-12-30", "2024-01-02"), ("2024-01-01", "2024-01-01"), ("2024-01-02", None)], "a string, b string").selectExpr("date(a) a", "date(b) b")
    got = {str(r["day"]): r["active"] for r in temporal.occupancy_curve(df, "a", "b").collect()}
    assert got == {"2023-12-30": 1, "2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 0}


def test_malformed_text_is_counted(spark):
    df = spark.createDataFrame([("POINT (1 2)",), ("oops",), (None,)], "t string")
    r = locate.malformed_count(locate.add_geometry(df, "from_wkt", ["t"], "g"), "t", "g").first()
    assert (r["n_present"], r["n_malformed"]) == (2, 1)
