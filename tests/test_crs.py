import pytest
from pyspark.sql import functions as F

from terraprofile.functions import crs

# public anchors: false origins and computed points
ANCHORS = [
    (2154, 3.0, 46.5, 700000.0, 6600000.0),
    (2154, 2.3522, 48.8566, 652469.0227, 6862035.2594),
    (3857, 1.0, 45.0, 111319.4908, 5621521.4862),
    (25832, 9.0, 0.0, 500000.0, 0.0),
    (3035, 10.0, 52.0, 4321000.0, 3210000.0),
    (5070, -96.0, 23.0, 0.0, 0.0),
    (27700, -2.0, 49.0, 400000.0, -100000.0),
    (2062, -3.0, 40.0, 2500000.0, 0.0),
]


def test_anchors(spark):
    row = spark.range(1).select(
        *[c for e, lon, lat, _, _ in ANCHORS for c in crs.transformer(4326, e)(F.lit(lon), F.lit(lat))]
    ).first()
    for i, (_, _, _, x, y) in enumerate(ANCHORS):
        assert row[2 * i] == pytest.approx(x, abs=1e-3)
        assert row[2 * i + 1] == pytest.approx(y, abs=1e-3)


@pytest.mark.parametrize("epsg", sorted(crs.PROJECTIONS))
def test_round_trip(spark, epsg):
    lon0 = crs.PROJECTIONS[epsg].get("lon0", 0.0)
    pts = spark.range(200).select((F.lit(lon0) + (F.col("id") % 20 - 10) * 0.4).alias("lon"), (F.lit(38.0) + F.floor(F.col("id") / 20) * 1.7).alias("lat"))
    x, y = crs.transformer(4326, epsg)(F.col("lon"), F.col("lat"))
    moved = pts.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = crs.transformer(epsg, 4326)(F.col("x"), F.col("y"))
    worst = moved.select(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-11


def test_between_projections_and_unknown(spark):
    x, y = crs.transformer(2154, 3857)(F.lit(700000.0), F.lit(6600000.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(333958.4724, abs=1e-3) and r["y"] == pytest.approx(5860839.8299, abs=1e-3)
    with pytest.raises(ValueError):
        crs.transformer(4326, 9999)


def test_equal_codes_add_nothing(spark):
    df = spark.range(1).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    x, y = crs.transformer(2154, 2154)(F.col("x"), F.col("y"))
    assert str(x) == str(F.col("x")) and str(y) == str(F.col("y"))
    assert df.select(x, y).first() == (1.0, 2.0)
