"""Input views derived from the physical tables.

Each view is one SQL text used by Spark and by the checking engine, so both
sides see the same rows. ``[S]`` stands for the text type and ``"name"`` for a
quoted identifier; the arithmetic is integer only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "geo_points": """
SELECT event_id, user_id, event_type, value,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(-8000 + ((user_id*311 + CAST(FLOOR(value) AS BIGINT)*97) % 20000) AS DOUBLE)/1000 END AS longitude,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(39000 + ((user_id*173 + CAST(FLOOR(value) AS BIGINT)*59) % 14000) AS DOUBLE)/1000 END AS latitude
  FROM {events}""",
    "geo_lines": """
SELECT o_orderkey AS road_id,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat(CAST((o_orderkey*7) % 9 AS [S]), ',', lpad(CAST((o_orderkey*131) % 1000 AS [S]), 3, '0')) END AS "xD",
  concat(CAST(42 + (o_custkey*5) % 9 AS [S]), ',', lpad(CAST((o_custkey*77) % 1000 AS [S]), 3, '0')) AS "yD",
  CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' ELSE concat(CAST((o_orderkey*7) % 9 AS [S]), '.', lpad(CAST((o_orderkey*131 + 50) % 1000 AS [S]), 3, '0')) END AS "xF",
  concat(CAST(42 + (o_custkey*5) % 9 AS [S]), ',', lpad(CAST((o_custkey*77 + 25) % 1000 AS [S]), 3, '0')) AS "yF"
  FROM {orders}""",
    # tiles of a lattice, two neighbouring rows at a time; some lie beyond the points and beyond the bounds
    "geo_polys": """
SELECT poly_id, zone, label_text,
  concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ', x0, ' ', y0, '))') AS geometry
  FROM (SELECT poly_id, zone, label_text, CAST(CAST(a AS DOUBLE)/1000 AS [S]) AS x0, CAST(CAST(a + 200 AS DOUBLE)/1000 AS [S]) AS x1, CAST(CAST(b AS DOUBLE)/1000 AS [S]) AS y0, CAST(CAST(b + 40 AS DOUBLE)/1000 AS [S]) AS y1
    FROM (SELECT CAST(p_partkey AS INT) AS poly_id, CAST(p_partkey % 5 AS INT) AS zone, concat(p_name, ' ', CAST(p_partkey AS [S])) AS label_text, -9475 + 200*(p_partkey % 100) AS a,
      41510 + 40*((74*CAST(FLOOR(p_partkey/200) AS BIGINT) + CAST(FLOOR(p_partkey/100) AS BIGINT) % 2) % 200) AS b FROM {part}) k) t""",
    # the same lattice in metres
    "metric_tiles": """
SELECT poly_id, value, x0, y0, x0 + 5000 AS x1, y0 + 2000 AS y1
  FROM (SELECT CAST(p_partkey AS INT) AS poly_id, CAST(p_size AS DOUBLE) AS value, 450000 + 5000*(p_partkey % 100) AS x0,
    6450000 + 2000*((74*CAST(FLOOR(p_partkey/200) AS BIGINT) + CAST(FLOOR(p_partkey/100) AS BIGINT) % 2) % 200) AS y0 FROM {part}) t""",
    "geo_codes": """
SELECT c_custkey, c_mktsegment,
  lpad(CAST((c_custkey*37) % 95000 + 1000 AS [S]), 5, '0') AS code_insee,
  (c_custkey*37) % 9000 + 1000 AS code_commune,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE lpad(CAST(c_nationkey + 1 AS [S]), 2, '0') END AS departement,
  concat('Zone (', lpad(CAST(c_nationkey % 13 + 11 AS [S]), 2, '0'), ')') AS region,
  CAST(NULL AS [S]) AS code_postal,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat(CAST(42 + c_custkey % 8 AS [S]), '.5, ', CAST(c_custkey % 7 AS [S]), '.25') END AS "geo point"
  FROM {customer}""",
    "grid_points": """
SELECT event_id, value,
  500000 + (user_id*7919 + (event_id % 97)*3301) % 400000 AS x,
  6500000 + (user_id*6101 + (event_id % 89)*4409) % 300000 AS y
  FROM {events}""",
    "geo_json": """
SELECT s_suppkey,
  CASE WHEN s_suppkey % 10 = 9 THEN '{broken' ELSE concat('{"type":"Point","coordinates":[', CAST(s_suppkey % 9 AS [S]), '.5,', CAST(42 + s_suppkey % 8 AS [S]), '.25]}') END AS geom,
  CASE WHEN s_suppkey % 10 = 9 THEN 'not wkt' ELSE concat('LINESTRING (', CAST(s_suppkey % 9 AS [S]), ' 42, ', CAST(s_suppkey % 9 + 1 AS [S]), ' 43, ', CAST(s_suppkey % 9 + 2 AS [S]), ' ', CAST(42 + s_suppkey % 5 AS [S]), ')') END AS shape
  FROM {supplier}""",
    "intervals": """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_date, CAST(MAX(l_shipdate) AS DATE) AS end_date
  FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate HAVING MAX(l_shipdate) >= o_orderdate""",
    "raw_rows": """
SELECT concat('file_', CAST(f AS [S])) AS file, r AS row_no,
  CASE WHEN r < f % 5 THEN NULL WHEN r = f % 5 THEN 'code_insee' ELSE CAST(10000 + r AS [S]) END AS c0,
  CASE WHEN r < f % 5 THEN (CASE WHEN r = 0 THEN 'note' ELSE NULL END) WHEN r = f % 5 THEN 'latitude' ELSE concat(CAST(42 + r % 8 AS [S]), '.5') END AS c1,
  CASE WHEN r < f % 5 THEN NULL WHEN r = f % 5 THEN 'longitude' ELSE CAST(r % 9 AS [S]) END AS c2
  FROM (SELECT DISTINCT s_suppkey AS f FROM {supplier}) a CROSS JOIN (SELECT DISTINCT CAST(p_size AS BIGINT) - 1 AS r FROM {part} WHERE p_size <= 30) b""",
    "dataset_inventory": """
SELECT p_partkey AS dataset_id, CAST(FLOOR(p_partkey / 7) AS BIGINT) AS archive_id,
  concat(CASE p_partkey % 5 WHEN 0 THEN 'data_' WHEN 1 THEN 'readme_' WHEN 2 THEN 'export_' WHEN 3 THEN 'notes_' ELSE 'sheet_' END, CAST(p_partkey AS [S])) AS name,
  CASE p_partkey % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.geojson' WHEN 2 THEN '.txt' WHEN 3 THEN '.shp' WHEN 4 THEN '.xlsx' ELSE '.pdf' END AS ext,
  (p_partkey * 7919) % 90000000 AS size_bytes, (p_partkey * 31) % 20000 AS n_rows, p_size AS n_cols
  FROM {part}""",
    "batch_results": """
SELECT o_orderkey AS dataset_id, o_orderkey % 8 <> 0 AS success,
  CASE WHEN o_orderkey % 16 = 0 THEN 'IOException: unreadable: bad header' WHEN o_orderkey % 8 = 0 THEN 'Unsupported file extension: .pdf' END AS error,
  CASE WHEN o_orderkey % 8 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'CSV with geometry' ELSE 'Geospatial' END END AS file_type,
  CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey * 37) % 5000 END AS n_rows,
  CASE WHEN o_orderkey % 8 <> 0 THEN CAST((o_orderkey * 113) % 900000 AS DOUBLE) / 100 END AS size_kb,
  CAST(o_orderkey % 250 AS DOUBLE) / 100 AS elapsed_s
  FROM {orders}""",
}

_TABLE_REF = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def duck_view(name: str) -> str:
    """The view text in the checking engine's dialect."""
    return _TABLE_REF.sub(r"\1", VIEWS[name]).replace("[S]", "VARCHAR")


class Inputs:
    """Tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("[S]", "STRING")
        text = re.sub(r'"(xD|yD|xF|yF|geo point)"', r"`\1`", text)
        names = sorted(set(_TABLE_REF.findall(text)))
        for table in names:
            self.table(table).createOrReplaceTempView(f"tp_{table}")
        return self.spark.sql(_TABLE_REF.sub(r"tp_\1", text))
