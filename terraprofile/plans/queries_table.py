"""Registered queries: filters, table profile, join keys, encoding detection, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraprofile.functions.tables import COUNTRIES, KEY_DEFINITIONS
from terraprofile.operators import clean, detect, keys, profile, temporal
from terraprofile.plans.fixtures import Inputs
from terraprofile.plans.registry import query

POINTS, LINES, CODES, JSON, RAW, POLYS = (
    ("geo_points",), ("geo_lines",), ("geo_codes",), ("geo_json",), ("raw_rows",), ("geo_polys",)
)
FRANCE = "BETWEEN -5.5 AND 10.0", "BETWEEN 41.0 AND 51.5"


def text_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# ---------------------------------------------------------------------- filters

@query("filter_not_null_coords", """
SELECT event_id, longitude, latitude FROM geo_points WHERE longitude IS NOT NULL AND latitude IS NOT NULL""", POINTS)
def _(t: Inputs):
    return clean.with_coordinates(t.view("geo_points"), "longitude", "latitude").select("event_id", "longitude", "latitude")


@query("filter_bounds_points", f"""
SELECT event_id, longitude, latitude FROM geo_points WHERE longitude {FRANCE[0]} AND latitude {FRANCE[1]}""", POINTS)
def _(t: Inputs):
    return clean.filter_bounds(t.view("geo_points"), "longitude", "latitude").select("event_id", "longitude", "latitude")


@query("filter_bounds_points_counts", f"""
SELECT count(*) FILTER (longitude IS NOT NULL AND latitude IS NOT NULL) AS n_located,
  count(*) FILTER (longitude {FRANCE[0]} AND latitude {FRANCE[1]}) AS n_kept,
  count(*) FILTER (longitude IS NOT NULL AND latitude IS NOT NULL AND NOT (longitude {FRANCE[0]} AND latitude {FRANCE[1]})) AS n_excluded
FROM geo_points""", POINTS)
def _(t: Inputs):
    return clean.count_outside_bounds(t.view("geo_points"), "longitude", "latitude")


CASTS = ", ".join(
    f"""TRY_CAST(replace("{c}", ',', '.') AS DOUBLE) AS {a}""" for c, a in zip(("xD", "yD", "xF", "yF"), ("x_s", "y_s", "x_e", "y_e"))
)
CAST_LINES = f"""WITH l AS (SELECT road_id, {CASTS} FROM geo_lines),
c AS (SELECT * FROM l WHERE x_s IS NOT NULL AND y_s IS NOT NULL AND x_e IS NOT NULL AND y_e IS NOT NULL)
"""


def cast_lines(t: Inputs):
    return clean.cast_decimal_comma(t.view("geo_lines"), ["xD", "yD", "xF", "yF"], ["x_s", "y_s", "x_e", "y_e"], keep=["road_id"])


@query("cast_decimal_comma", CAST_LINES + "SELECT * FROM c", LINES)
def _(t: Inputs):
    return cast_lines(t)


@query("filter_bounds_lines", CAST_LINES + f"SELECT * FROM c WHERE x_s {FRANCE[0]} AND y_s {FRANCE[1]}", LINES)
def _(t: Inputs):
    return clean.filter_bounds(cast_lines(t), "x_s", "y_s")


@query("clean_column_names", r"""
SELECT file, row_no, trim(regexp_replace(concat(' ', c1, chr(13), chr(10), c0, chr(10)), '\r\n|\n', ' ', 'g')) AS header
FROM raw_rows WHERE c0 IS NOT NULL AND c1 IS NOT NULL""", RAW)
def _(t: Inputs):
    rows = t.view("raw_rows").where("c0 IS NOT NULL AND c1 IS NOT NULL")
    return rows.select("file", "row_no", clean.clean_name_column(F.concat(F.lit(" "), F.col("c1"), F.lit("\r\n"), F.col("c0"), F.lit("\n"))).alias("header"))


@query("project_exclude_rename", """
SELECT * EXCLUDE (geometry), length(geometry) AS geometry_length FROM geo_polys""", POLYS)
def _(t: Inputs):
    df = t.view("geo_polys")
    return clean.exclude_and_add(df, ["geometry"], geometry_length=F.length("geometry").cast("bigint"))


@query("repair_code_columns", """
WITH w AS (SELECT avg(length(CAST(code_commune AS VARCHAR))) AS m FROM geo_codes)
SELECT c_custkey, code_insee, CASE WHEN m >= 3.5 AND m < 4.5 THEN CASE WHEN length(CAST(code_commune AS VARCHAR)) < 5 THEN lpad(CAST(code_commune AS VARCHAR), 5, '0') ELSE CAST(code_commune AS VARCHAR) END
  WHEN m >= 1.0 AND m < 1.5 THEN CASE WHEN length(CAST(code_commune AS VARCHAR)) < 2 THEN lpad(CAST(code_commune AS VARCHAR), 2, '0') ELSE CAST(code_commune AS VARCHAR) END
  ELSE CAST(code_commune AS VARCHAR) END AS code_commune FROM geo_codes, w""", CODES)
def _(t: Inputs):
    return clean.repair_code_columns(t.view("geo_codes")).select("c_custkey", "code_insee", "code_commune")


@query("code_repair_report", """
WITH w AS (SELECT avg(length(CAST(code_commune AS VARCHAR))) AS m FROM geo_codes)
SELECT 'code_commune' AS col, CASE WHEN m >= 3.5 THEN 5 ELSE 2 END AS width,
  CASE WHEN m >= 3.5 THEN 'code_insee_commune' ELSE 'code_departement' END AS label
FROM w WHERE (m >= 3.5 AND m < 4.5) OR (m >= 1.0 AND m < 1.5)""", CODES)
def _(t: Inputs):
    return clean.code_repair_report(t.view("geo_codes"))


# ---------------------------------------------------------------- table profile

@query("row_column_count", "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM geo_points", POINTS)
def _(t: Inputs):
    return profile.row_column_count(t.view("geo_points"))


def ratios(view: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", avg(CASE WHEN "{c}" IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS null_ratio FROM {view}"""
        for i, c in enumerate(columns)
    )


POINT_COLUMNS = ["event_id", "user_id", "event_type", "value", "longitude", "latitude"]
CODE_COLUMNS = ["c_custkey", "c_mktsegment", "code_insee", "code_commune", "departement", "region", "code_postal", "geo point"]
SCORE = """SELECT round((1 - avg(null_ratio)) * 100, 1) AS mean_pct, round(stddev_pop(null_ratio) * 100, 1) AS std_pct FROM r"""


@query("null_ratio_per_column", f'SELECT position, "column", round(null_ratio, 6) AS null_ratio FROM ({ratios("geo_points", POINT_COLUMNS)})', POINTS)
def _(t: Inputs):
    return profile.null_ratio_per_column(t.view("geo_points")).withColumn("null_ratio", F.round("null_ratio", 6))


@query("completeness_all", f"WITH r AS ({ratios('geo_codes', CODE_COLUMNS)}) {SCORE}", CODES)
def _(t: Inputs):
    return profile.completeness(t.view("geo_codes"))


@query("completeness_keys", f"WITH r AS ({ratios('geo_codes', ['code_insee', 'departement', 'region'])}) {SCORE}", CODES)
def _(t: Inputs):
    return profile.completeness(t.view("geo_codes"), ["code_insee", "departement", "region"])


def catalog_sql(view: str, columns: list[tuple[str, str]], dataset: str | None = None) -> str:
    """The column catalog as SQL; ``columns`` are (name, type text)."""
    head = f"'{dataset}' AS dataset_id, " if dataset else ""
    return " UNION ALL ".join(
        f"""SELECT {head}CAST({i} AS BIGINT) AS position, '{c}' AS "column", '{ty}' AS type, count("{c}") AS non_null, count(*) AS n, CAST(min("{c}") AS VARCHAR) AS sample FROM {view}"""
        for i, (c, ty) in enumerate(columns)
    )


CODE_TYPES = list(zip(CODE_COLUMNS, ["bigint", "string", "string", "bigint", "string", "string", "string", "string"]))
POINT_TYPES = list(zip(POINT_COLUMNS, ["bigint", "bigint", "string", "double", "double", "double"]))
LINE_TYPES = list(zip(["road_id", "xD", "yD", "xF", "yF"], ["bigint", "string", "string", "string", "string"]))
JSON_TYPES = list(zip(["s_suppkey", "geom", "shape"], ["bigint", "string", "string"]))


@query("column_details", f"""
SELECT position, "column", coalesce(substr(sample, 1, 100), 'N/A') AS example, type, n - non_null AS missing
FROM ({catalog_sql("geo_codes", CODE_TYPES)})""", CODES)
def _(t: Inputs):
    return profile.column_details(t.view("geo_codes"))


MANY = {"codes": "geo_codes", "lines": "geo_lines", "json": "geo_json"}
MANY_SQL = " UNION ALL ".join(
    catalog_sql(v, ty, d) for d, v, ty in (("codes", "geo_codes", CODE_TYPES), ("lines", "geo_lines", LINE_TYPES), ("json", "geo_json", JSON_TYPES))
)


def many_catalog(t: Inputs):
    return profile.profile_many({d: t.view(v) for d, v in MANY.items()})


@query("profile_many", MANY_SQL, CODES + LINES + JSON)
def _(t: Inputs):
    return many_catalog(t)


@query("profile_grouped", """
SELECT event_type AS dataset_id, CAST(0 AS BIGINT) AS position, 'longitude' AS "column", 'double' AS type, count(longitude) AS non_null, count(*) AS n, CAST(min(longitude) AS VARCHAR) AS sample FROM geo_points GROUP BY event_type
UNION ALL SELECT event_type, 1, 'user_id', 'bigint', count(user_id), count(*), CAST(min(user_id) AS VARCHAR) FROM geo_points GROUP BY event_type""", POINTS)
def _(t: Inputs):
    return profile.profile_grouped(t.view("geo_points"), F.col("event_type"), ["longitude", "user_id"])


@query("dataset_completeness", f"""
SELECT dataset_id, max(n) AS n_rows, count(*) AS n_columns, round((1 - avg(1 - non_null / n)) * 100, 1) AS mean_pct, round(stddev_pop(1 - non_null / n) * 100, 1) AS std_pct
FROM ({MANY_SQL}) GROUP BY dataset_id""", CODES + LINES + JSON)
def _(t: Inputs):
    return profile.dataset_completeness(many_catalog(t))


# -------------------------------------------------------------------- join keys

def definition_values(country: str = "france") -> str:
    rows = []
    for no, (label, patterns, fmt) in enumerate(KEY_DEFINITIONS[country]):
        quoted = text_list([fmt]) if fmt else "NULL"
        rows += [f"({no}, {text_list([label])}, {text_list([p])}, {quoted})" for p in patterns]
    return f"defs(def_no, label, pattern, fmt) AS (VALUES {', '.join(rows)})"


CANDIDATES = f"""WITH cat AS ({catalog_sql("geo_codes", CODE_TYPES)}), {definition_values()},
cand AS (SELECT position, "column", non_null, n, CAST(def_no AS BIGINT) AS def_no, label, fmt AS value_format
  FROM cat JOIN defs ON contains(lower("column"), pattern) GROUP BY ALL)
"""
VALUES_LONG = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", c_custkey AS k, CAST("{c}" AS VARCHAR) AS v FROM geo_codes WHERE "{c}" IS NOT NULL"""
    for c in ("code_insee", "code_commune", "departement", "region", "code_postal")
)


def rates_sql() -> str:
    return CANDIDATES + f""", vals AS (SELECT * FROM ({VALUES_LONG})),
rates AS (SELECT c."column", c.def_no, c.label, count(v) AS n_tested,
  avg(CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(trim(v), concat('^(?:', value_format, ')')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS match_rate
  FROM cand c LEFT JOIN vals USING ("column") GROUP BY ALL)
"""


RATE = 'SELECT "column", def_no, label, n_tested, round(match_rate, 6) AS match_rate FROM rates'
DETECT = """SELECT "column", min(def_no) AS def_no, arg_min(label, def_no) AS label FROM rates
WHERE n_tested > 0 AND (match_rate IS NULL OR match_rate >= 0.5) GROUP BY "column\""""


@query("key_name_candidates", CANDIDATES + "SELECT * FROM cand", CODES)
def _(t: Inputs):
    return keys.key_name_candidates(profile.column_catalog(t.view("geo_codes")))


@query("key_all_null_skip", CANDIDATES + "SELECT * FROM cand WHERE non_null > 0", CODES)
def _(t: Inputs):
    return keys.skip_all_null(keys.key_name_candidates(profile.column_catalog(t.view("geo_codes"))))


@query("key_value_match_rate", rates_sql() + RATE, CODES)
def _(t: Inputs):
    return keys.key_value_match_rate(t.view("geo_codes"), ["c_custkey"]).withColumn("match_rate", F.round("match_rate", 6))


@query("key_value_match_rate_all", rates_sql() + RATE, CODES)
def _(t: Inputs):
    return keys.key_value_match_rate(t.view("geo_codes"), sample=None).withColumn("match_rate", F.round("match_rate", 6))


@query("key_detect", rates_sql() + DETECT, CODES)
def _(t: Inputs):
    return keys.key_detect(t.view("geo_codes"), ["c_custkey"])


LENGTHS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {num} AS num, '{short}' AS short, coalesce(avg(length(nullif(regexp_extract(CAST("{c}" AS VARCHAR), '\\(([^)]+)\\)', 1), ''))), avg(length(CAST("{c}" AS VARCHAR)))) AS m, count("{c}") AS n FROM geo_codes"""
    for c, num, short in (
        ("code_insee", "false", keys.LABEL_COMMUNE_PART), ("code_commune", "true", keys.LABEL_EITHER),
        ("departement", "false", keys.LABEL_DEPARTMENT), ("region", "false", keys.LABEL_REGION), ("code_postal", "false", keys.LABEL_EITHER),
    )
).replace(keys.LABEL_COMMUNE_PART, keys.LABEL_EITHER)


@query("key_detect_by_length", f"""
WITH s AS ({LENGTHS}), l AS (SELECT "column", CASE WHEN m BETWEEN 4.5 AND 5.5 THEN CASE WHEN num THEN '{keys.LABEL_ZEROS_LOST}' ELSE '{keys.LABEL_INSEE}' END
  WHEN m BETWEEN 3.5 AND 4.5 THEN '{keys.LABEL_ZEROS_LOST}' WHEN m BETWEEN 1.5 AND 3.5 THEN short END AS label, round(m, 4) AS mean_length FROM s WHERE n > 0)
SELECT * FROM l WHERE label IS NOT NULL""", CODES)
def _(t: Inputs):
    return keys.key_detect_by_length(t.view("geo_codes"))


@query("key_report", rates_sql() + f', d AS ({DETECT}) SELECT label AS "Reference area", "column" AS "Identified key" FROM d', CODES)
def _(t: Inputs):
    return keys.key_report(keys.key_detect(t.view("geo_codes"), ["c_custkey"]))


@query("granularity", """
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' END AS types,
  CASE o_orderkey % 5 WHEN 0 THEN 'code_insee, region' WHEN 1 THEN 'departement' WHEN 2 THEN 'code_region' WHEN 3 THEN 'autre' END AS key_names FROM orders),
g AS (SELECT o_orderkey, concat_ws(' + ', CASE types WHEN 'Point' THEN 'Ponctuelle (géométrie)' WHEN 'LineString' THEN 'Linéaire (géométrie)' WHEN 'Polygon' THEN 'Surfacique (géométrie)' END,
  CASE key_names WHEN 'code_insee, region' THEN 'Commune / INSEE' WHEN 'departement' THEN 'Département' WHEN 'code_region' THEN 'Région' END) AS g FROM s)
SELECT o_orderkey, CASE WHEN g = '' THEN 'Inconnue' ELSE g END AS granularity FROM g""")
def _(t: Inputs):
    k = F.col("o_orderkey")
    types = F.when(k % 4 == 0, "Point").when(k % 4 == 1, "LineString").when(k % 4 == 2, "Polygon")
    names = F.when(k % 5 == 0, "code_insee, region").when(k % 5 == 1, "departement").when(k % 5 == 2, "code_region").when(k % 5 == 3, "autre")
    return t.table("orders").select("o_orderkey", keys.granularity(types, names).alias("granularity"))


COUNTRY_NAMES = ["France", "uk", "GERMANY", "italy", "spain", "usa", "europe", "atlantis"]
COUNTRY_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(COUNTRY_NAMES))
COUNTRY_ROWS = ", ".join(f"('{n}', {e}, {', '.join(f'{v}::DOUBLE' for v in b)})" for n, (e, b) in COUNTRIES.items())


@query("country_lookup", f"""
WITH params(name, epsg, minx, miny, maxx, maxy) AS (VALUES {COUNTRY_ROWS}),
c AS (SELECT c_custkey, CASE c_nationkey % 8 {COUNTRY_CASE} END AS country FROM customer)
SELECT c_custkey, country, coalesce(p.epsg, f.epsg) AS epsg, coalesce(p.minx, f.minx) AS minx, coalesce(p.miny, f.miny) AS miny, coalesce(p.maxx, f.maxx) AS maxx, coalesce(p.maxy, f.maxy) AS maxy
FROM c LEFT JOIN params p ON p.name = lower(country) CROSS JOIN (SELECT * FROM params WHERE name = 'france') f""")
def _(t: Inputs):
    country = F.lit(None).cast("string")
    for i, n in enumerate(COUNTRY_NAMES):
        country = F.when(F.col("c_nationkey") % 8 == i, F.lit(n)).otherwise(country)
    return keys.country_lookup(t.table("customer").select("c_custkey", country.alias("country")), "country")


# ----------------------------------------------------------- encoding detection

def detected(df):
    """Arrays as text, so that rows compare across engines."""
    return df.withColumn("columns", F.array_join("columns", ","))


def rule_query(name: str, rule: str, view: str, sql: str):
    @query(name, sql, (view,))
    def _(t: Inputs):
        return detected(detect.detect_rule(profile.column_catalog(t.view(view), "d"), rule))


def cat(view: str, types) -> str:
    return f"WITH cat AS ({catalog_sql(view, types, 'd')}), named AS (SELECT *, lower(\"column\") AS name FROM cat)\n"


GEOM = r"regexp_matches(name, '\b(geometry|geom|shape|point|polygon)\b') AND sample IS NOT NULL"
NATIVE = "'Présence Géométrie' AS label"
PAIR = "'Présence géométrie séparée (x,y)' AS label"
ENDS = "'Présence géométrie multiples (x1,y1), (x2,y2)' AS label"
FIRST = "ORDER BY position LIMIT 1"

rule_query("detect_geopoint", "geopoint", "geo_codes", cat("geo_codes", CODE_TYPES) + f"""
SELECT dataset_id, 'Point' AS type, 'geopoint' AS method, "column" AS columns, {NATIVE} FROM named
WHERE {GEOM} AND contains(name, 'point') AND contains(name, 'geo') AND type = 'string' AND contains(sample, ',') {FIRST}""")

rule_query("detect_geojson", "geojson", "geo_json", cat("geo_json", JSON_TYPES) + f"""
SELECT dataset_id, json_extract_string(sample, '$.type') AS type, 'geojson' AS method, "column" AS columns, {NATIVE} FROM named
WHERE {GEOM} AND json_valid(sample) AND json_extract_string(CASE WHEN json_valid(sample) THEN sample ELSE '{{}}' END, '$.coordinates') IS NOT NULL {FIRST}""")

rule_query("detect_wkt", "wkt", "geo_json", cat("geo_json", JSON_TYPES) + f"""
, k AS (SELECT *, CASE WHEN contains(upper(sample), 'POINT') THEN 'Point' WHEN contains(upper(sample), 'LINESTRING') THEN 'Linestring' WHEN contains(upper(sample), 'POLYGON') THEN 'Polygon' END AS kind FROM named WHERE {GEOM})
SELECT dataset_id, kind AS type, 'from_wkt' AS method, "column" AS columns, {NATIVE} FROM k WHERE kind IS NOT NULL {FIRST}""")

rule_query("detect_lonlat", "lonlat", "geo_points", cat("geo_points", POINT_TYPES) + rf"""
SELECT 'd' AS dataset_id, 'Point' AS type, 'points_from_xy' AS method, concat(lon, ',', lat) AS columns, {PAIR} FROM
(SELECT (SELECT "column" FROM named WHERE regexp_matches(name, '\b(lat|latitude)\b') {FIRST}) AS lat, (SELECT "column" FROM named WHERE regexp_matches(name, '\b(lon|long|lng|longitude)\b') {FIRST}) AS lon)
WHERE lat IS NOT NULL AND lon IS NOT NULL""")

XY = """, xs AS (SELECT * FROM named WHERE regexp_matches(name, '(^x[^a-zA-Z0-9]?|[^a-zA-Z0-9]x$)')), ys AS (SELECT * FROM named WHERE regexp_matches(name, '(^y[^a-zA-Z0-9]?|[^a-zA-Z0-9]y$)')),
pair AS (SELECT xs.dataset_id, xs."column" AS x, ys."column" AS y, xs.name AS xname FROM xs JOIN ys ON replace(xs.name, 'x', '') = replace(ys.name, 'y', '') ORDER BY xs.position, ys.position LIMIT 1)
"""

rule_query("detect_xy", "xy", "geo_lines", cat("geo_lines", LINE_TYPES) + XY + f"""
SELECT dataset_id, 'Point' AS type, 'points_from_xy' AS method, concat(x, ',', y) AS columns, {PAIR} FROM pair""")

rule_query("detect_linestring_pairs", "linestring_pairs", "geo_lines", cat("geo_lines", LINE_TYPES) + XY + f"""
SELECT pair.dataset_id, 'LineString' AS type, 'linestring_coords' AS method, concat_ws(',', x, y, xs."column", ys."column") AS columns, {ENDS}
FROM pair, xs, ys WHERE regexp_matches(xname, '(d|debut|start)') AND xs."column" <> x AND ys."column" <> y
  AND regexp_matches(xs.name, '(f|fin|end)') AND regexp_matches(ys.name, '(f|fin|end)') ORDER BY xs.position, ys.position LIMIT 1""")

ADDRESS_TYPES = [("c_custkey", "bigint"), ("adresse_client", "string")]


@query("detect_address", f"""WITH v AS (SELECT c_custkey, c_name AS adresse_client FROM customer), cat AS ({catalog_sql("v", ADDRESS_TYPES, "d")})
SELECT dataset_id, 'Address' AS type, 'geocoding_required' AS method, "column" AS columns, 'Géocodage de l''adresse' AS label FROM cat WHERE contains(lower("column"), 'adresse') {FIRST}""")
def _(t: Inputs):
    df = t.table("customer").select("c_custkey", F.col("c_name").alias("adresse_client"))
    return detected(detect.detect_rule(profile.column_catalog(df, "d"), "address"))


KEYS_LABEL = "'Jointure spatiale à l''aide de clés géographiques' AS label"
rule_query("detect_admin_keys", "admin_keys", "geo_codes", cat("geo_codes", CODE_TYPES) + f"""
SELECT dataset_id, 'Administrative' AS type, 'join_required' AS method, string_agg("column", ',' ORDER BY position) AS columns, {KEYS_LABEL}
FROM named WHERE regexp_matches(name, '(dep|reg|insee|com)') GROUP BY dataset_id""")


@query("detect_geometry", f"""
WITH cat AS ({MANY_SQL} UNION ALL {catalog_sql("geo_points", POINT_TYPES, "points")} UNION ALL {catalog_sql("customer", [("c_custkey", "bigint"), ("c_name", "string")], "plain")}),
named AS (SELECT *, lower("column") AS name FROM cat),
g AS (SELECT *, {GEOM} AS geo FROM named),
r1 AS (SELECT dataset_id, position, CASE WHEN contains(name, 'point') AND contains(name, 'geo') AND type = 'string' AND contains(sample, ',') THEN 'Point'
    WHEN json_valid(sample) AND json_extract_string(CASE WHEN json_valid(sample) THEN sample ELSE '{{}}' END, '$.coordinates') IS NOT NULL THEN json_extract_string(CASE WHEN json_valid(sample) THEN sample ELSE '{{}}' END, '$.type')
    WHEN contains(upper(sample), 'POINT') THEN 'Point' WHEN contains(upper(sample), 'LINESTRING') THEN 'Linestring' WHEN contains(upper(sample), 'POLYGON') THEN 'Polygon' END AS type,
  CASE WHEN contains(name, 'point') AND contains(name, 'geo') AND type = 'string' AND contains(sample, ',') THEN 'geopoint'
    WHEN json_valid(sample) THEN 'geojson' ELSE 'from_wkt' END AS method, "column" AS columns, {NATIVE}, 1 AS rule FROM g WHERE geo),
lonlat AS (SELECT dataset_id, arg_min("column", position) FILTER (regexp_matches(name, '\\b(lat|latitude)\\b')) AS lat, arg_min("column", position) FILTER (regexp_matches(name, '\\b(lon|long|lng|longitude)\\b')) AS lon FROM named GROUP BY dataset_id),
xs AS (SELECT * FROM named WHERE regexp_matches(name, '(^x[^a-zA-Z0-9]?|[^a-zA-Z0-9]x$)')), ys AS (SELECT * FROM named WHERE regexp_matches(name, '(^y[^a-zA-Z0-9]?|[^a-zA-Z0-9]y$)')),
pair AS (SELECT xs.dataset_id, xs."column" AS x, ys."column" AS y, xs.name AS xname FROM xs JOIN ys ON xs.dataset_id = ys.dataset_id AND replace(xs.name, 'x', '') = replace(ys.name, 'y', '')
  QUALIFY row_number() OVER (PARTITION BY xs.dataset_id ORDER BY xs.position, ys.position) = 1),
ends AS (SELECT pair.dataset_id, concat_ws(',', x, y, xs."column", ys."column") AS columns FROM pair JOIN xs ON xs.dataset_id = pair.dataset_id JOIN ys ON ys.dataset_id = pair.dataset_id
  WHERE regexp_matches(xname, '(d|debut|start)') AND xs."column" <> x AND ys."column" <> y AND regexp_matches(xs.name, '(f|fin|end)') AND regexp_matches(ys.name, '(f|fin|end)')
  QUALIFY row_number() OVER (PARTITION BY pair.dataset_id ORDER BY xs.position, ys.position) = 1),
hits AS (SELECT dataset_id, type, method, columns, label, rule, position FROM r1 WHERE type IS NOT NULL
  UNION ALL SELECT dataset_id, 'Point', 'points_from_xy', concat(lon, ',', lat), 'Présence géométrie séparée (x,y)', 2, 0 FROM lonlat WHERE lat IS NOT NULL AND lon IS NOT NULL
  UNION ALL SELECT dataset_id, 'LineString', 'linestring_coords', columns, 'Présence géométrie multiples (x1,y1), (x2,y2)', 3, 0 FROM ends
  UNION ALL SELECT dataset_id, 'Point', 'points_from_xy', concat(x, ',', y), 'Présence géométrie séparée (x,y)', 4, 0 FROM pair
  UNION ALL SELECT dataset_id, 'Address', 'geocoding_required', "column", 'Géocodage de l''adresse', 5, position FROM named WHERE contains(name, 'adresse')
  UNION ALL SELECT dataset_id, 'Administrative', 'join_required', string_agg("column", ',' ORDER BY position), 'Jointure spatiale à l''aide de clés géographiques', 6, 0 FROM named WHERE regexp_matches(name, '(dep|reg|insee|com)') GROUP BY dataset_id
  UNION ALL SELECT DISTINCT dataset_id, NULL, 'none', '', 'Aucune géométrie', 7, 0 FROM named)
SELECT dataset_id, type, method, columns, label FROM hits QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY rule, position) = 1""",
CODES + LINES + JSON + POINTS)
def _(t: Inputs):
    catalog = profile.profile_many(
        {**{d: t.view(v) for d, v in MANY.items()}, "points": t.view("geo_points"), "plain": t.table("customer").select("c_custkey", "c_name")}
    )
    return detected(detect.detect_geometry(catalog))


# ------------------------------------------------------------------------- dates

@query("date_columns", r"""
WITH v AS (SELECT o_orderdate, o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day_text, CAST(o_orderkey AS VARCHAR) AS code_text FROM orders),
r AS (SELECT CAST(0 AS BIGINT) AS position, 'o_orderdate' AS "column", 1.0::DOUBLE AS date_rate UNION ALL
SELECT 1, 'o_orderpriority', avg(CASE WHEN TRY_CAST(o_orderpriority AS TIMESTAMP) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM v UNION ALL
SELECT 2, 'o_orderstatus', avg(CASE WHEN TRY_CAST(o_orderstatus AS TIMESTAMP) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM v UNION ALL
SELECT 3, 'day_text', avg(CASE WHEN TRY_CAST(day_text AS TIMESTAMP) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM v UNION ALL
SELECT 4, 'code_text', avg(CASE WHEN TRY_CAST(code_text AS TIMESTAMP) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM v)
SELECT position, "column", round(date_rate, 4) AS date_rate FROM r WHERE date_rate >= 0.5""")
def _(t: Inputs):
    df = t.table("orders").select(
        "o_orderdate", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"), F.col("o_orderkey").cast("string").alias("code_text")
    )
    return temporal.date_columns(df)


@query("date_coverage", """
SELECT min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, CAST(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS BIGINT) AS span_days,
count(DISTINCT CAST(ts AS DATE)) AS present_days, round(count(DISTINCT CAST(ts AS DATE)) / (date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1) * 100, 2) AS coverage_pct, count(*) AS n_rows FROM events""")
def _(t: Inputs):
    return temporal.date_coverage(t.table("events"), "ts")


@query("date_histogram", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, count(*) AS n_rows FROM orders GROUP BY 1")
def _(t: Inputs):
    return temporal.date_histogram(t.table("orders"), "o_orderdate", "month")


@query("date_histogram_daily", "SELECT CAST(date_trunc('day', ts) AS DATE) AS bucket, count(*) AS n_rows FROM events GROUP BY 1")
def _(t: Inputs):
    return temporal.date_histogram(t.table("events"), "ts", "day")


@query("interval_median_duration", """
SELECT count(*) AS n_intervals, CAST(median(date_diff('day', start_date, end_date)) AS DOUBLE) AS median_days FROM intervals""", ("intervals",))
def _(t: Inputs):
    return temporal.interval_median_duration(t.view("intervals"), "start_date", "end_date")


@query("occupancy_curve", """
WITH e AS (SELECT start_date AS day, 1 AS delta FROM intervals UNION ALL SELECT CAST(end_date + INTERVAL 1 DAY AS DATE), -1 FROM intervals),
d AS (SELECT day, sum(delta) AS delta FROM e GROUP BY day)
SELECT day, CAST(sum(delta) OVER (ORDER BY day) AS BIGINT) AS active FROM d""", ("intervals",))
def _(t: Inputs):
    return temporal.occupancy_curve(t.view("intervals"), "start_date", "end_date")
