"""Feature collections read by blocks of any size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terraprofile.functions import geometry as G
from terraprofile.sources import collections, files

WORDS = ["a", "}", "{", "[x]", 'say "hi"', "back\\slash\\", "\\\"", "é", "two\nlines", "}]}", ""]


def feature(chance):
    props = {"k": chance.choice(WORDS), "n": chance.choice([1, 2.5, None]), "deep": {"list": [{"type": "Feature"}, chance.choice(WORDS)]}}
    return {"type": "Feature", "properties": props, "geometry": {"type": "Point", "coordinates": [chance.randrange(9), chance.randrange(9)]}}


def written(tmp_path, n):
    chance = random.Random(n)
    wanted = {}
    for f, indent in enumerate([None, 1, None]):
        features = [feature(chance) for _ in range(n)]
        root = {"type": "FeatureCollection", "links": [{"type": "Feature", "href": "}"}], "crs": {"type": "name", "properties": {"name": "x"}}, "features": features, "more": [{"type": "Feature"}, [{}]]}
        if f == 2:
            root = {"features": features}
        (tmp_path / f"f{f}.geojson").write_text(json.dumps(root, indent=indent, ensure_ascii=f == 0))
        wanted[f"f{f}.geojson"] = sorted(json.dumps(x, sort_keys=True) for x in features)
    (tmp_path / "none.geojson").write_text('{"type":"Point","coordinates":[1,2]}')
    (tmp_path / "empty.geojson").write_text('{"features":[]}')
    return wanted


@pytest.mark.parametrize("block", [150, 1000, 1 << 20])
def test_features_across_blocks(spark, tmp_path, block):
    wanted = written(tmp_path, 9)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        rows = collections.feature_texts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in rows:
        assert not r.broken
        found.setdefault(r.path.rsplit("/", 1)[1], []).append(json.dumps(json.loads(r.value), sort_keys=True))
    assert {k: sorted(v) for k, v in found.items()} == wanted


def test_without_broadcast_of_blocks(spark, tmp_path, monkeypatch):
    wanted = written(tmp_path, 12)
    monkeypatch.setattr(collections, "BROADCAST_BLOCKS", 0)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        assert collections.feature_texts(spark, str(tmp_path)).count() == sum(map(len, wanted.values()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_large_file_is_many_tasks_and_bad_features_are_counted(spark, tmp_path):
    body = ",".join(json.dumps({"type": "Feature", "properties": {"k": k}, "geometry": {"type": "Point", "coordinates": [k, 1]}}) for k in range(2000))
    (tmp_path / "a.json").write_text('{"features":[' + body + ',{"type":"Feature","properties":{"k":}},{"type":"Feature","properties":{"k":5},"geometry":{"type":"Poi')
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        assert collections._texts(spark, str(tmp_path), None).rdd.getNumPartitions() > 5
        counts = files.feature_counts(spark, str(tmp_path)).first()
        rows = files.scan_geojson(spark, str(tmp_path))
        assert (counts.n_features, counts.n_bad) == (2002, 2)
        assert rows.select(F.sum(G.vertices(F.col("geometry"))[0]["x"]).alias("s")).first().s == sum(range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_collections_are_written_from_one_look_at_the_rows(spark, tmp_path):
    from terraprofile.plans.queries_sources import collections_of

    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    rows = spark.range(12).select("id", (F.col("id") % 3).alias("zone"), F.udf(look, "string")(F.concat(F.lit("n"), "id")).alias("name"), G.point(F.col("id"), F.lit(1.0)).alias("g"))
    collections_of(rows, "id", "zone", str(tmp_path / "c"))
    assert seen.value == 12
    assert files.scan_geojson(spark, str(tmp_path / "c")).count() == 12
