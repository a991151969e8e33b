"""Properties of physical plans that the operators rely on at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terraprofile.operators import clean, metrics, neighbours
from terraprofile.plans.dataset_profile import profile_points
from terraprofile.session import scratch_path, shared_dir

QUERIES = entry.queries()
PLAIN = [
    "filter_bounds_points", "completeness_all", "column_details", "key_name_candidates", "key_detect", "detect_geometry", "guess_crs_points",
    "reproject_2154", "centroid", "geometry_as_wkt", "grid_variation", "duplicates_exact", "first_of_coordinates", "fill_rate_lines", "coverage_envelope",
    "pick_data_table", "archive_primary_file", "flatten_profile", "batch_summary", "translate_report", "occupancy_curve", "profile_lines",
]


def plan_of(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 100000)
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_joins_and_no_python(name, spark, data_dir):
    plan = plan_of(QUERIES[name](spark, data_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas", "ArrowEval"):
        assert word not in plan, word


def points_file(spark):
    path = scratch_path(spark, "points")
    spark.range(1000).select("id", (F.col("id") % 20 - 5.0).alias("lon"), (F.col("id") % 15 + 40.0).alias("lat"), F.lit("x").alias("other")).write.parquet(path)
    return spark.read.parquet(path)


def test_bounds_reach_the_scan(spark):
    plan = plan_of(clean.filter_bounds(points_file(spark), "lon", "lat"))
    assert "GreaterThanOrEqual(lon,-5.5)" in plan and "LessThanOrEqual(lat,51.5)" in plan


def test_profile_reads_two_columns_and_filters_in_the_scan(spark):
    plan = plan_of(profile_points(points_file(spark), "lon", "lat"))
    assert "ReadSchema: struct<lon:double,lat:double>" in plan
    assert "GreaterThanOrEqual(lon,-5.5)" in plan


def test_copies_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    assert "WindowGroupLimit" in plan_of(neighbours._places(df, 4))


def test_partial_aggregation_of_cells(spark, inputs):
    counts, _ = metrics.cell_counts_points(inputs.view("grid_points"), "x", "y")
    assert "partial_count" in plan_of(counts)


class FakeSession:
    def __init__(self, folder, master):
        self.conf = self
        self.sparkContext = self
        self.folder, self.master, self.applicationId = folder, master, f"app-{master}"

    def get(self, _key, default):
        return self.folder or default


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(FakeSession("hdfs://host/shared", "yarn")) == "hdfs://host/shared"
    first, second = scratch_path(spark, "a"), scratch_path(spark, "a")
    assert first != second and first.startswith(f"{shared_dir(spark).rstrip('/')}/terraprofile/")
    with pytest.raises(ValueError):
        shared_dir(FakeSession(None, "yarn"))


def test_a_row_equal_to_the_header_is_data(spark, tmp_path):
    from terraprofile.plans.batch_report import delimited_catalog, delimited_cells

    (tmp_path / "a.csv").write_text("x,y\n1,2\nx,y\n3,4\n")
    (tmp_path / "b.csv").write_text("x;y\n1;2\n")
    rows = delimited_catalog(*delimited_cells(spark, str(tmp_path))).collect()
    assert {(r.dataset_id[-5:], r.column, r.n, r.n_bad) for r in rows} == {("a.csv", c, 3, 0) for c in "xy"} | {("b.csv", c, 1, 0) for c in "xy"}


def test_full_report_of_every_file(spark, tmp_path):
    """Quoted line breaks, mixed schemas and separators, keys, encodings, errors and the order of a stop."""
    from terraprofile.plans.batch_report import batch_profile
    from terraprofile.plans.dataset_profile import dataset_profile

    files = {
        "points.csv": "code_insee,longitude,latitude,note\n" + "".join(f'{10000 + k},{k % 9},{42 + k % 8},"two\nlines {k}"\n' for k in range(40)) + "bad,row\n",
        "lines.txt": "xD;yD;xF;yF\n" + "".join(f"{k % 5},5;4{2 + k % 6},0;{k % 5 + 1},25;4{3 + k % 5},5\n" for k in range(30)),
        "wkt.csv": "id|the geom\n" + "".join(f"{k}|LINESTRING ({k % 7} 42, {k % 7 + 1} 44)\n" for k in range(20)) + "21|nonsense\n",
        "plain.csv": "a\tb\n1\t\n2\tx\n",
        "head.csv": "only,names\n",
        "area.geojson": '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code_departement":"33"},"geometry":{"type":"Point","coordinates":[2,45]}}]}',
        "note.pdf": "x",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    names = [*files, "missing.csv"]
    asked = spark.createDataFrame([(f"file:{tmp_path}/{n}", k) for k, n in enumerate(names)], "path string, position long")
    rows = {r["Nom du fichier"]: r for r in batch_profile(spark, asked, str(tmp_path)).collect()}
    assert {n: (r.error or "").split(":")[0] for n, r in rows.items() if not r.success} == {"note.pdf": "Unsupported file extension", "missing.csv": "File not found"}
    points = rows["points.csv"]
    assert (points["Nb lignes"], points.n_bad, points["Types de géométrie"], points["CRS"]) == (40, 1, "Point", "EPSG:4326")
    assert [tuple(k) for k in points["Clés géographiques"]][0][1] == "code_insee" and "insee" in points["Granularité"].lower()
    assert points["Colonnes"][3]["Exemple"] == "two\nlines 0" and points["Taille (Ko)"] > 0 and len(points["Date de création du fichier (Y-M-D)"]) == 10
    assert (rows["lines.txt"]["Types de géométrie"], rows["lines.txt"]["Complexité moyenne des géométries"]) == ("LineString", 2.0)
    assert rows["wkt.csv"]["Score de complétude géographique"][0] == round(20 / 21 * 100, 1)
    assert rows["plain.csv"]["Type de fichier"] == "CSV" and rows["head.csv"]["Nb colonnes"] == 2 and rows["head.csv"]["Nb lignes"] == 0
    assert rows["area.geojson"]["Type de fichier"] == "Geospatial" and rows["area.geojson"]["Clés géographiques"][0][1] == "code_departement"
    # a file's row is the one its table alone gives
    table = spark.read.option("header", True).option("multiLine", True).option("inferSchema", True).option("mode", "DROPMALFORMED").csv(str(tmp_path / "points.csv"))
    single = dataset_profile(table.where("latitude IS NOT NULL"), "points.csv").first()
    for c in ("Emprise estimée (km2)", "Densité (obj/km2)", "Taux de remplissage géométrique (%)", "Part des geometries dupliquees (%)", "CRS", "Clés géographiques", "Granularité", "Score de complétude des clés géographique"):
        assert points[c] == single[c], c
    stopped = batch_profile(spark, asked, str(tmp_path), stop_on_error=True).orderBy("position").collect()
    assert [r["Nom du fichier"] for r in stopped] == names[: names.index("note.pdf") + 1] and not stopped[-1].success
