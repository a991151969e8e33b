"""Registered queries: dataset profiles, batches and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraprofile.functions.tables import ENGLISH
from terraprofile.operators import report
from terraprofile.plans.batch_report import batch_profile
from terraprofile.plans.dataset_profile import dataset_profile
from terraprofile.plans.fixtures import Inputs
from terraprofile.plans.queries_geometry import POLY_VERTICES, forward_sql, polygons
from terraprofile.plans.queries_metrics import ENVELOPE_COVER, LINE_STATS, METRIC_POINTS, TILES, hull_sql, metric_row_sql, territory
from terraprofile.plans.queries_sources import collections_of
from terraprofile.plans.queries_table import CODES, LINES, POINTS, POLYS
from terraprofile.plans.registry import query
from terraprofile.session import scratch_path

BATCH = ("batch_results",)


# one file per event type and eighth of the events; the note is a quoted cell with a line break and quotes
BATCH_ROWS = """f AS (SELECT concat(event_type, '_', event_id % 8, '.csv') AS file_name, CAST(10000 + event_id % 80000 AS VARCHAR) AS code_insee, event_id, user_id, longitude, latitude,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('user ', user_id, chr(10), 'did "', event_type, '", once') END AS note FROM geo_points)"""
_M = "longitude BETWEEN -5.5 AND 10.0 AND latitude BETWEEN 41.0 AND 51.5"
_PX, _PY = forward_sql(2154, "longitude", "latitude")
_VX, _VY = forward_sql(2154, "x", "y")


def _column_json(columns: str) -> str:
    """The column table as JSON, from (name, type, present values, smallest value)."""
    one = """concat('{{"position":', {i}, ',"Colonne":"{n}"', CASE WHEN {e} IS NULL THEN ',"Exemple":"N/A"' ELSE concat(',"Exemple":', to_json({e})) END, ',"Type":"{t}","Valeurs manquantes":', {m}, '}}')"""
    parts = [one.format(i=i, n=n, t=t, m=m, e=e) for i, (n, t, m, e) in enumerate(columns)]
    return "concat('[', " + ", ',', ".join(parts) + ", ']')"


_POINT_COLUMNS = _column_json(
    [(n, t, f"count(*) - count({n})", f"min(CAST({n} AS VARCHAR))") for n, t in (("code_insee", "bigint"), ("event_id", "bigint"), ("user_id", "bigint"), ("longitude", "double"), ("latitude", "double"), ("note", "string"))]
)


def _report_sql(name: str, kind: str, n_columns: int, columns: str, ratios: list[str], keys: str, label: str, keys_pct: str, geo: str, coverage: str, grain: str, source: str) -> str:
    """The report's row of a whole table, its geometry measured in the CTE ``geo``."""
    return f"""SELECT '{name}' AS file_name, '{kind}' AS file_type, n_rows, CAST({n_columns} AS BIGINT) AS n_columns, columns, round(list_avg(r) * 100, 1) AS mean_pct, round(list_stddev_pop(r) * 100, 1) AS std_pct,
'{keys}' AS keys, '{label}' AS label, {keys_pct} AS keys_pct, g.present_pct, g.valid_pct, g.crs, g.geometry_types AS kinds, g.extent_km2, g.density, g.fill_rate_pct, g.complexity, g.duplicate_pct, {coverage} AS coverage_pct, '{grain}' AS granularity
FROM (SELECT count(*) AS n_rows, {columns} AS columns, [{', '.join(f'count({c}) / count(*)' for c in ratios)}] AS r FROM {source}), ({geo}) g"""


def _details(*columns: tuple[str, str]) -> str:
    return _column_json([(n.strip('"'), t, f"count(*) - count({n})", f"min({n}) || ''" if t != "double" else f"CAST(min({n}) AS VARCHAR)") for n, t in columns])


_POINT_GEO = "SELECT g.*, " + ENVELOPE_COVER + " AS cover FROM (" + metric_row_sql("Point", "'EPSG:4326'", "CAST(NULL AS DOUBLE)", "q").replace("AS coverage_pct FROM q", "AS coverage_pct, a, b, c, d FROM q") + ") g"
_POINT_STATS = "q AS (SELECT count(*) AS n, count(*) AS n_valid, count(DISTINCT concat(longitude, ' ', latitude)) AS n_distinct, min(mx) AS a, min(my) AS b, max(mx) AS c, max(my) AS d, min(mx) AS ca, min(my) AS cb, max(mx) AS cc, max(my) AS cd, CAST(NULL AS DOUBLE) AS complexity FROM f)"


@query("dataset_profile", f"WITH {METRIC_POINTS}, {_POINT_STATS} " + _report_sql(
    "geo_points", "CSV with geometry", 6, _details(("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("longitude", "double"), ("latitude", "double")),
    ["event_id", "user_id", "event_type", "value", "longitude", "latitude"], "[]", "Présence géométrie séparée (x,y)", "0.0::DOUBLE", _POINT_GEO, "g.cover", "Ponctuelle (géométrie)", "geo_points"), POINTS + TILES)
def _(t: Inputs):
    return report_row(dataset_profile(t.view("geo_points"), "geo_points", key_order=["event_id"], territory=territory(t)))


def report_row(profiled):
    return report.flatten_profile(profiled).select(F.col("Nom du fichier").alias("file_name"), *report_figures())


@query("dataset_profile_lines", LINE_STATS + _report_sql(
    "geo_lines", "CSV with geometry", 5, _details(("road_id", "bigint"), ('"xD"', "string"), ('"yD"', "string"), ('"xF"', "string"), ('"yF"', "string")),
    ["road_id", '"xD"', '"yD"', '"xF"', '"yF"'], "[]", "Présence géométrie multiples (x1,y1), (x2,y2)", "0.0::DOUBLE", metric_row_sql("LineString", "'EPSG:4326'", "CAST(NULL AS DOUBLE)", "q"), "g.coverage_pct", "Linéaire (géométrie)", "geo_lines"), LINES)
def _(t: Inputs):
    return report_row(dataset_profile(t.view("geo_lines"), "geo_lines", key_order=["road_id"]))


_TX, _TY = forward_sql(2154, "x", "y")


@query("dataset_profile_text", f"""WITH p AS (SELECT c_custkey, TRY_CAST(trim(string_split("geo point", ',')[2]) AS DOUBLE) AS x, TRY_CAST(trim(string_split("geo point", ',')[1]) AS DOUBLE) AS y FROM geo_codes),
f AS (SELECT *, {_TX} AS mx, {_TY} AS my FROM p WHERE x IS NOT NULL AND x BETWEEN -5.5 AND 10.0 AND y BETWEEN 41.0 AND 51.5),
q AS (SELECT count(*) AS n, count(*) AS n_valid, count(DISTINCT (x, y)) AS n_distinct, min(mx) AS a, min(my) AS b, max(mx) AS c, max(my) AS d, min(mx) AS ca, min(my) AS cb, max(mx) AS cc, max(my) AS cd, CAST(NULL AS DOUBLE) AS complexity FROM f),
m AS ({metric_row_sql("Point", "'EPSG:4326'", "CAST(NULL AS DOUBLE)", "q")}), hp AS (SELECT DISTINCT mx AS x, my AS y FROM f), {hull_sql("hp")}, g2 AS (SELECT m.* REPLACE (round(area / 1e6::DOUBLE, 2) AS extent_km2, round(n_objects / (area / 1e6::DOUBLE), 2) AS density, (SELECT round(area / ((max(x) - min(x)) * (max(y) - min(y))) * 100, 2) FROM hp) AS fill_rate_pct, round(n_objects * 100.0::DOUBLE / (n_objects + (SELECT count(*) FROM p WHERE x IS NULL)), 1) AS present_pct, round(n_objects * 100.0::DOUBLE / (n_objects + (SELECT count(*) FROM p WHERE x IS NULL)), 1) AS valid_pct) FROM m, area) """ + _report_sql(
    "geo_codes", "CSV with geometry", 8, _details(("c_custkey", "bigint"), ("c_mktsegment", "string"), ("code_insee", "string"), ("code_commune", "bigint"), ("departement", "string"), ("region", "string"), ("code_postal", "string"), ('"geo point"', "string")),
    ["c_custkey", "c_mktsegment", "code_insee", "code_commune", "departement", "region", "code_postal", '"geo point"'],
    '[{"Reference area":"Code INSEE commune","Identified key":"code_insee"},{"Reference area":"Code département","Identified key":"departement"}]', "Présence Géométrie",
    "(SELECT round((1 + count(departement) / count(*)) / 2 * 100, 1) FROM geo_codes)", "SELECT * FROM g2", "g.coverage_pct", "Ponctuelle (géométrie) + Commune / INSEE", "geo_codes"), CODES)
def _(t: Inputs):
    return report_row(dataset_profile(t.view("geo_codes"), "geo_codes", key_order=["c_custkey"]))


@query("batch_with_errors", f"""
WITH {BATCH_ROWS}, {POLY_VERTICES},
n AS (SELECT file_name, count(*) AS n_rows, list_transform([count(longitude), count(latitude), count(note)], lambda k: k / count(*)) AS r, {_POINT_COLUMNS} AS columns FROM f GROUP BY file_name),
m AS (SELECT file_name, count(*) AS n, count(DISTINCT concat(longitude, ' ', latitude)) AS n_distinct, (max({_PX}) - min({_PX})) * (max({_PY}) - min({_PY})) / 1e6::DOUBLE AS extent FROM f WHERE {_M} GROUP BY file_name),
points AS (SELECT file_name, true AS success, CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS n_bad, 'CSV with geometry' AS file_type, n_rows, CAST(6 AS BIGINT) AS n_columns, columns,
  round(list_avg([1, 1, 1, r[1], r[2], r[3]]) * 100, 1) AS mean_pct, round(list_stddev_pop([0, 0, 0, 1 - r[1], 1 - r[2], 1 - r[3]]) * 100, 1) AS std_pct,
  '[{{"Reference area":"Code INSEE commune","Identified key":"code_insee"}}]' AS keys, 'Présence géométrie séparée (x,y)' AS label, 100.0::DOUBLE AS keys_pct, 100.0::DOUBLE AS present_pct, 100.0::DOUBLE AS valid_pct, 'EPSG:4326' AS crs, 'Point' AS kinds,
  round(extent, 2) AS extent_km2, round(n / extent, 2) AS density, 100.0::DOUBLE AS fill_rate_pct, CAST(NULL AS DOUBLE) AS complexity, round((n - n_distinct) * 100.0::DOUBLE / n, 2) AS duplicate_pct, CAST(NULL AS DOUBLE) AS coverage_pct, 'Ponctuelle (géométrie) + Commune / INSEE' AS granularity FROM n JOIN m USING (file_name)),
b AS (SELECT poly_id, (max({_VX}) - min({_VX})) * (max({_VY}) - min({_VY})) / 1e6::DOUBLE AS extent FROM v WHERE poly_id BETWEEN 30 AND 59 GROUP BY poly_id),
shapes AS (SELECT concat('tile_', poly_id, '.geojson') AS file_name, true AS success, CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS n_bad, 'Geospatial' AS file_type, CAST(1 AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_columns,
  {_column_json([("poly_id", "bigint", "0", "CAST(poly_id AS VARCHAR)"), ("label_text", "string", "0", "label_text")]).replace(", ']')", "")}, replace(',{{"position":1048576,"Colonne":"geometry","Exemple":"#","Type":"string","Valeurs manquantes":0}}]', '#', left(geometry, 100))) AS columns,
  100.0::DOUBLE AS mean_pct, 0.0::DOUBLE AS std_pct, '[]' AS keys, 'Données géographiques' AS label, 0.0::DOUBLE AS keys_pct, 100.0::DOUBLE AS present_pct, 100.0::DOUBLE AS valid_pct, 'EPSG:4326' AS crs, 'Polygon' AS kinds,
  round(extent, 2) AS extent_km2, round(1 / extent, 2) AS density, 0.0::DOUBLE AS fill_rate_pct, 5.0::DOUBLE AS complexity, 0.0::DOUBLE AS duplicate_pct, 'Surfacique (géométrie)' AS granularity FROM geo_polys JOIN b USING (poly_id))
SELECT * FROM points UNION ALL BY NAME SELECT * FROM shapes
UNION ALL BY NAME SELECT x[1] AS file_name, false AS success, x[2] AS error FROM (SELECT unnest([['missing.csv', 'File not found'], ['note.pdf', 'Unsupported file extension'], ['area.shp', 'NotImplementedError']]) AS x)""", POINTS + POLYS)
def _(t: Inputs):
    return batch_files(t)


def batch_files(t: Inputs):
    root = scratch_path(t.spark, "batch")
    parts = scratch_path(t.spark, "parts")
    jvm = t.spark.sparkContext._jvm
    conf = t.spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(conf)
    fs.mkdirs(path(root))
    # files under names of their own, as users' folders hold them
    note = F.concat(F.lit("user "), "user_id", F.lit('\ndid "'), "event_type", F.lit('", once'))
    rows = t.view("geo_points").select(
        F.concat("event_type", F.lit("_"), F.col("event_id") % 8).alias("file"), (F.lit(10000) + F.col("event_id") % 80000).alias("code_insee"),
        "event_id", "user_id", "longitude", "latitude", F.when(F.col("event_id") % 5 != 0, note).alias("note"),
    )
    rows.repartition("file").write.partitionBy("file").option("header", True).option("escape", '"').csv(parts)
    names = []
    for status in fs.globStatus(path(f"{parts}/file=*/*.csv")):
        name = status.getPath().getParent().getName().split("=")[1] + ".csv"
        fs.rename(status.getPath(), path(f"{root}/{name}"))
        names.append(name)
    shapes = scratch_path(t.spark, "shapes")
    collections_of(polygons(t).where("poly_id BETWEEN 30 AND 59").select("poly_id", "label_text", "g"), "poly_id", "poly_id", shapes)
    for status in fs.globStatus(path(f"{shapes}/part=*/*.txt")):
        name = "tile_" + status.getPath().getParent().getName().split("=")[1] + ".geojson"
        fs.rename(status.getPath(), path(f"{root}/{name}"))
        names.append(name)
    for extra in ("note.pdf", "area.shp"):
        out = fs.create(path(f"{root}/{extra}"))
        out.write(0)
        out.close()
    base = fs.makeQualified(path(root)).toString()
    asked = t.spark.createDataFrame([(f"{base}/{n}",) for n in [*names, "note.pdf", "area.shp", "missing.csv"]], "path string")
    done = report.flatten_profile(batch_profile(t.spark, asked, root))
    return done.select(F.col("Nom du fichier").alias("file_name"), "success", F.get(F.split("error", ":"), F.lit(0)).alias("error"), "n_bad", *report_figures(F.col("success")))


def report_figures(known=None):
    """A flattened report's columns under short names."""
    score = lambda of, what: F.col(f"`{of} - Score de complétude {what} (%)`")
    whole, of_keys = "Score de complétude global", "Score de complétude des clés géographique"
    return [
        F.col("Type de fichier").alias("file_type"), F.col("Nb lignes").alias("n_rows"), F.col("Nb colonnes").alias("n_columns"),
        F.when(F.lit(True) if known is None else known, F.col("Colonnes (détails)")).alias("columns"), score(whole, "moyen").alias("mean_pct"), score(whole, "std").alias("std_pct"),
        F.to_json("Clés géographiques").alias("keys"), F.col("Géotransformation").alias("label"), score(of_keys, "moyen").alias("keys_pct"),
        F.col("`Score de complétude géographique - Présentes (%)`").alias("present_pct"), F.col("`Score de complétude géographique - Valides (%)`").alias("valid_pct"),
        F.col("CRS").alias("crs"), F.col("Types de géométrie").alias("kinds"), F.col("Emprise estimée (km2)").alias("extent_km2"),
        F.col("Densité (obj/km2)").alias("density"), F.col("Taux de remplissage géométrique (%)").alias("fill_rate_pct"),
        F.col("Complexité moyenne des géométries").alias("complexity"), F.col("Part des geometries dupliquees (%)").alias("duplicate_pct"),
        F.col("Couverture territoriale hexagonale (%)").alias("coverage_pct"), F.col("Granularité").alias("granularity"),
    ]


def nested(df):
    """Batch rows with their figures in nested structs, as a report holds them."""
    detail = F.array(F.struct(F.lit("n_rows").alias("Colonne"), F.col("n_rows").cast("string").alias("Exemple")))
    return df.select(
        "dataset_id", "success",
        F.struct(F.col("size_kb").alias("Taille (Ko)"), F.struct(F.col("n_rows").alias("Nb lignes"), F.col("file_type").alias("Type")).alias("contenu")).alias("fichier"),
        detail.alias("Colonnes"),
    )


@query("flatten_profile", """SELECT dataset_id, success, size_kb AS "fichier - Taille (Ko)", n_rows AS "fichier - contenu - Nb lignes", file_type AS "fichier - contenu - Type",
CASE WHEN n_rows IS NULL THEN '[{"Colonne":"n_rows"}]' ELSE concat('[{"Colonne":"n_rows","Exemple":"', n_rows, '"}]') END AS "Colonnes (détails)", CAST(1 AS BIGINT) AS "Nb colonnes détaillées" FROM batch_results""", BATCH)
def _(t: Inputs):
    return report.flatten_profile(nested(t.view("batch_results")))


@query("report_table", "SELECT dataset_id, success, error, file_type AS \"Type de fichier\", n_rows AS \"Nb lignes\", size_kb AS \"Taille (Ko)\", elapsed_s FROM batch_results", BATCH)
def _(t: Inputs):
    return report.report_table(t.view("batch_results").withColumnsRenamed({"file_type": "Type de fichier", "n_rows": "Nb lignes", "size_kb": "Taille (Ko)"}))


@query("report_table_successes", "SELECT dataset_id, success, n_rows FROM batch_results WHERE success", BATCH)
def _(t: Inputs):
    return report.report_table(t.view("batch_results").select("dataset_id", "success", "n_rows"), include_errors=False)


@query("batch_summary", """
SELECT count(*) AS total_files, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) / count(*) * 100, 4) AS success_rate, round(sum(elapsed_s), 2) AS total_time, round(avg(elapsed_s), 4) AS avg_time_per_file,
CAST(sum(n_rows) FILTER (success) AS BIGINT) AS total_rows, round(sum(size_kb) FILTER (success) / 1024, 2) AS total_size_mb FROM batch_results""", BATCH)
def _(t: Inputs):
    return report.batch_summary(t.view("batch_results"))


@query("file_type_counts", "SELECT coalesce(file_type, 'Unknown') AS file_type, count(*) AS n FROM batch_results WHERE success GROUP BY 1", BATCH)
def _(t: Inputs):
    return report.file_type_counts(t.view("batch_results"))


@query("error_type_counts", "SELECT coalesce(split_part(error, ':', 1), 'Unknown') AS error_type, count(*) AS n FROM batch_results WHERE NOT success GROUP BY 1", BATCH)
def _(t: Inputs):
    return report.error_type_counts(t.view("batch_results"))


KEYS_CASE = ["Nb lignes", "Taille (Ko)", "Type de fichier", "Aucune géométrie", "Granularité", "hors dictionnaire"]
_case = lambda k: " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(k))


@query("translate_report", f"""SELECT dataset_id, CASE dataset_id % 6 {_case([ENGLISH.get(v, v) for v in KEYS_CASE])} END AS key, coalesce(file_type, '') AS value FROM batch_results""", BATCH)
def _(t: Inputs):
    key = F.lit(None).cast("string")
    for i, v in enumerate(KEYS_CASE):
        key = F.when(F.col("dataset_id") % 6 == i, F.lit(v)).otherwise(key)
    rows = t.view("batch_results").select("dataset_id", key.alias("key"), F.coalesce("file_type", F.lit("")).alias("value"))
    return report.translate_rows(rows, ["key", "value"])


@query("translate_headers", 'SELECT n_rows AS "Nb rows", size_kb AS "Size (KB)", file_type AS "File type" FROM batch_results', BATCH)
def _(t: Inputs):
    df = t.view("batch_results").select(F.col("n_rows").alias("Nb lignes"), F.col("size_kb").alias("Taille (Ko)"), F.col("file_type").alias("Type de fichier"))
    return report.translate_headers(df)


@query("json_safe", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN NULL ELSE value END AS v, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts FROM events""")
def _(t: Inputs):
    k = F.col("event_id") % 3
    bad = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("value"))
    return report.json_safe(t.table("events").select("event_id", bad.alias("v"), "ts"))


@query("report_filter_geo", """SELECT dataset_id, CASE WHEN file_type = 'CSV' THEN 'Aucune géométrie' ELSE 'Présence Géométrie' END AS label FROM batch_results WHERE success AND file_type <> 'CSV'""", BATCH)
def _(t: Inputs):
    label = F.when(F.col("file_type") == "CSV", "Aucune géométrie").otherwise("Présence Géométrie")
    return report.filter_with_geometry(t.view("batch_results").where("success").select("dataset_id", label.alias("label")), "label")


@query("report_top_k", "SELECT dataset_id, size_kb FROM batch_results ORDER BY size_kb DESC NULLS LAST, dataset_id LIMIT 5", BATCH)
def _(t: Inputs):
    return report.top_k(t.view("batch_results").select("dataset_id", "size_kb"), "size_kb", "dataset_id")


@query("report_group_agg", 'SELECT file_type AS "group", count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS total_rows FROM batch_results GROUP BY file_type', BATCH)
def _(t: Inputs):
    return report.group_totals(t.view("batch_results"), "file_type", "n_rows")


@query("report_totals", "SELECT CAST(sum(n_rows) AS BIGINT) AS total_rows, round(avg(n_rows), 4) AS mean_rows, round(avg(size_kb), 4) AS mean_score FROM batch_results", BATCH)
def _(t: Inputs):
    return report.totals(t.view("batch_results"), "n_rows", "size_kb")


@query("large_file_flag", "SELECT dataset_id, (ext = '.xlsx' AND size_bytes / 1048576 > 10) OR size_bytes / 1048576 > 50 AS is_large FROM dataset_inventory", ("dataset_inventory",))
def _(t: Inputs):
    return t.view("dataset_inventory").select("dataset_id", report.large_file_flag(F.col("size_bytes"), F.col("ext")).alias("is_large"))
