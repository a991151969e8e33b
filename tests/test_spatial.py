"""Hulls, coverage, grids and neighbour statistics against direct computation."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraprofile.functions import geometry as G
from terraprofile.operators import cover, hull, locate, metrics, neighbours
from terraprofile.plans.dataset_profile import Rules, Territory, compute_all_metrics, profile_geometry, profile_points
from terraprofile.session import CLEANUP, materialize


def frame(spark, **columns):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns))


def shoelace(p):
    x, y = p[:, 0], p[:, 1]
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


@pytest.mark.parametrize("shape", ["square", "circle", "line", "one", "three"])
def test_hull(spark, shape):
    rng = np.random.default_rng(3)
    pts = {
        "square": rng.random((3000, 2)) * 100,
        "circle": np.c_[np.cos(np.arange(500) * 0.3), np.sin(np.arange(500) * 0.3)] * 10,
        "line": np.c_[np.arange(50.0), np.arange(50.0) * 2],
        "one": np.ones((20, 2)),
        "three": np.array([[0.0, 0], [4, 0], [0, 3]]),
    }[shape]
    r = hull.convex_hull(frame(spark, x=pts[:, 0], y=pts[:, 1]), F.col("x"), F.col("y")).first()
    expected = hull._monotone_chain(pts)
    assert r["n_vertices"] == len(expected)
    assert r["area"] == pytest.approx(shoelace(expected) if len(expected) > 2 else 0.0, rel=1e-9, abs=1e-9)


def test_hull_drops_inner_points_early():
    rng = np.random.default_rng(4)
    assert len(hull._outer_points(rng.random((4000, 2)))) < 1000


def test_fill_rate_points_edges(spark):
    rate = lambda xs, ys: metrics.fill_rate_points(frame(spark, x=np.array(xs, float), y=np.array(ys, float)), "x", "y").first()["fill_rate"]
    assert rate([0, 1, 0, 1], [0, 0, 1, 1]) == 100.0
    assert rate([0, 2, 0], [0, 0, 2]) == 50.0
    assert rate([0, 1], [0, 1]) == 0.0
    assert rate([5, 5, 5], [1, 2, 3]) == 100.0


def test_overlap_check(spark):
    boxes = lambda rows: spark.createDataFrame([(float(a), float(b), float(c), float(d)) for a, b, c, d in rows], "a double, b double, c double, d double").select(
        G.line(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g")
    )
    check = lambda rows: cover.reference_overlap_check(boxes(rows), "g").first()["overlaps"]
    tiles = [(i, j, i + 1, j + 1) for i in range(15) for j in range(15)]
    assert check(tiles) is False
    assert check([*tiles, (3.2, 3.2, 3.3, 3.3)]) is True
    assert check([(0, 0, 1, 1), (0, 0, 1, 1)]) is True
    # many slivers beside one large box: cells are split, and nothing overlaps
    slivers = [(0, i / 1000, 1, (i + 1) / 1000) for i in range(1000)]
    assert check([*slivers, (1, 0, 50, 50)]) is False
    assert check([*slivers, (0.99, 0, 50, 50)]) is True
    assert check([]) is False


def test_union_area_of_overlapping_squares(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))",), ("POLYGON ((5 5, 15 5, 15 15, 5 15, 5 5))",)], "w string").select(G.from_wkt(F.col("w")).alias("g"))
    assert cover.reference_overlap_check(df, "g").first()["overlaps"]
    assert cover.union_area(df, "g", True).first()["area"] == pytest.approx(175, rel=0.01)
    assert cover.fill_rate_polygons(df, "g").first()["fill_rate"] == pytest.approx(175 / 225 * 100, rel=0.01)


def test_buffered_cells_of_one_line(spark):
    segs = frame(spark, x1=np.array([0.0]), y1=np.array([0.0]), x2=np.array([300.0]), y2=np.array([400.0]))
    r = cover.fill_rate_lines(segs).first()
    area = 2 * 0.5 * 500 + np.pi * 0.25
    assert r["fill_rate"] == pytest.approx(area / 120000 * 100, rel=0.02)


def test_guess_crs_straddling_medians(spark):
    guess = lambda xs, ys: locate.guess_crs(frame(spark, x=np.array(xs, float), y=np.array(ys, float)), F.col("x"), F.col("y")).first()["epsg"]
    rng = np.random.default_rng(5)

    def direct(xs, ys):
        mx, my = np.median(xs), np.median(ys)
        if -10 < mx < 10 and 40 < my < 60:
            return 4326
        if 1e5 < mx < 1.3e6 and 6e6 < my < 7.4e6:
            return 2154
        return 3857 if abs(mx) < 2.2e6 and abs(my) < 2.2e6 else None

    cases = [([0, 1], [45, 50]), ([10, 10], [45, 45]), ([9, 11], [50, 50]), ([9, 10.5], [50, 50]), ([-11, -9, 3], [39, 41, 45]), ([1e6, 1e6], [6.5e6, 7e6]), ([5e6], [5e6]), ([8, 12, 10, 10], [50, 50, 50, 50])]
    cases += [(rng.integers(5, 16, n).tolist(), rng.integers(35, 66, n).tolist()) for n in range(1, 30)]
    for xs, ys in cases:
        assert guess(xs, ys) == direct(xs, ys), (xs, ys)


def test_grid_edges_count_twice(spark):
    # the middle point lies on an inner edge and counts in both cells
    df = frame(spark, x=np.array([0.0, 1.0, 2.0]), y=np.array([0.0, 0.5, 1.0]))
    counts, _ = metrics.cell_counts_points(df, "x", "y", 1.0)
    assert {(r["ix"], r["iy"]): r["c"] for r in counts.collect()} == {(0, 0): 2, (1, 0): 2}


def neighbours_directly(xy, ids, k):
    out = {}
    for i in range(len(xy)):
        d = ((xy - xy[i]) ** 2).sum(1)
        d[i] = np.inf
        out[ids[i]] = list(ids[np.lexsort((ids, d))[:k]])
    return out


def skewed_points():
    """A third at one place, a third in a tiny cluster, a third spread wide."""
    rng = np.random.default_rng(6)
    n = 900
    kind = np.arange(n) % 3
    xy = np.where((kind == 0)[:, None], 5.0, np.where((kind == 1)[:, None], rng.random((n, 2)) * 1e-3, rng.random((n, 2)) * 1e5))
    return xy, rng.permutation(n) * 3, rng.normal(size=n)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_neighbours_on_skewed_points(spark, k):
    xy, ids, v = skewed_points()
    df = frame(spark, id=ids, x=xy[:, 0], y=xy[:, 1], v=v)
    edges = neighbours.knn_edges(df, "id", "x", "y", k).toPandas().sort_values(["src", "rank"])
    got = edges.groupby("src").dst.apply(list).to_dict()
    expected = neighbours_directly(xy, ids, k)
    assert got == expected
    z = dict(zip(ids, v - v.mean()))
    stat = sum(z[a] * np.mean([z[b] for b in bs]) for a, bs in expected.items()) / sum(t * t for t in z.values())
    assert neighbours.moran_knn(df, "id", "x", "y", "v", k).first()["moran_i"] == pytest.approx(stat, abs=1e-4)


def test_few_points(spark):
    df = frame(spark, id=np.array([1, 2, 3]), x=np.array([0.0, 1, 5]), y=np.zeros(3), v=np.array([1.0, 2, 4]))
    assert neighbours.moran_knn(df, "id", "x", "y", "v").first()["n"] == 3


def squares(n):
    return [(i * n + j, f"POLYGON (({i} {j}, {i + 1} {j}, {i + 1} {j + 1}, {i} {j + 1}, {i} {j}))", i, j) for i in range(n) for j in range(n)]


def queen_directly(rows, values):
    corners = {}
    for k, w, *_ in rows:
        pts = {p.strip() for p in w.split("((")[1].split("))")[0].split(",")}
        for p in pts:
            corners.setdefault(p, set()).add(k)
    near = {k: set() for k, *_ in rows}
    for members in corners.values():
        for m in members:
            near[m] |= members - {m}
    z = {k: v - np.mean(list(values.values())) for k, v in values.items()}
    s0 = sum(1 for k in near if near[k])
    num = sum(z[k] * np.mean([z[j] for j in near[k]]) for k in near if near[k])
    return len(near) / s0 * num / sum(t * t for t in z.values())


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_queen_with_copies_and_hot_vertices(spark, hot):
    rows = [(k, w) for k, w, *_ in squares(6)]
    # copies of one shape, a fan around one corner, and an island
    rows += [(100 + i, rows[7][1]) for i in range(5)]
    rows += [(200 + i, f"POLYGON ((3 3, {50 + i} {i}, {51 + i} {i}, 3 3))") for i in range(12)]
    rows += [(300, "POLYGON ((90 90, 91 90, 91 91, 90 90))")]
    values = {k: float((k * 37) % 11) for k, _ in rows}
    df = spark.createDataFrame([(k, w, values[k]) for k, w in rows], "k int, w string, v double").select("k", "v", G.from_wkt(F.col("w")).alias("g"))
    got = neighbours.moran_queen(df, "g", "v", hot).first()["moran_i"]
    assert got == pytest.approx(queen_directly(rows, values), abs=1e-4)


def test_gradient_positive_checkerboard_negative(spark):
    n = 12
    df = spark.createDataFrame([(k, w, float(i + j), float((i + j) % 2)) for k, w, i, j in squares(n)], "k int, w string, grad double, board double").select("k", "grad", "board", G.from_wkt(F.col("w")).alias("g"))
    assert neighbours.moran_queen(df, "g", "grad").first()["moran_i"] > 0.5
    pts = spark.createDataFrame([(i * n + j, float(i), float(j), float((i + j) % 2), float(i)) for i in range(n) for j in range(n)], "id int, x double, y double, board double, grad double")
    assert neighbours.moran_knn(pts, "id", "x", "y", "board").first()["moran_i"] < 0
    s = neighbours.moran_significance(pts, "id", "x", "y", "grad", permutations=39).first()
    assert s["p_value"] <= 0.05 and s["z_score"] > 2 and s["interpretation"] == neighbours.POSITIVE


def test_dense_index_is_a_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("id"))
    idx = [r["idx"] for r in neighbours.dense_index(df, "id").select("idx").collect()]
    assert sorted(idx) == list(range(1000))


def shapes(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "w string").select(G.from_wkt(F.col("w")).alias("g"))


def box_wkt(a, b, c, d):
    return f"POLYGON(({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"


def test_coverage_counts_overlapping_territory_once(spark):
    twice = shapes(spark, box_wkt(0, 0, 1, 1), box_wkt(0, 0, 1, 1), box_wkt(2, 0, 3, 1))
    box = spark.createDataFrame([(2.0, 0.0, 3.0, 1.0)], "minx double, miny double, maxx double, maxy double")
    assert abs(cover.coverage_envelope(twice, "g", box).first()[0] - 50) < 0.5
    ring = spark.createDataFrame([([(2.0, 0.0), (3.0, 0.0), (3.0, 1.0), (2.0, 1.0)],)], "ring array<struct<x: double, y: double>>")
    assert abs(cover.coverage_hull(twice, "g", ring).first()[0] - 50) < 0.5
    apart = shapes(spark, box_wkt(0, 0, 1, 1), box_wkt(2, 0, 3, 1))
    assert cover.coverage_envelope(apart, "g", box).first()[0] == 50


def test_cell_coverage_of_a_far_larger_territory(spark):
    territory = shapes(spark, box_wkt(-500, -500, 500, 500))
    data = shapes(spark, box_wkt(0, 0, 20, 10))
    f = cover.frame(cover.geometry_box(data, "g"))
    assert cover.polygon_spans(territory, "g", f, clip=True).count() < 2000
    pct = cover.coverage_cells(territory, "g", cover.polygon_cells(data, "g", f), f).first()[0]
    assert abs(pct - 0.02) < 0.001


def test_cell_coverage_of_overlapping_territory(spark):
    territory = shapes(spark, box_wkt(0, 0, 10, 10), box_wkt(0, 0, 10, 10), box_wkt(10, 0, 20, 10))
    data = shapes(spark, box_wkt(0, 0, 10, 10))
    f = cover.frame(cover.geometry_box(data, "g"))
    assert abs(cover.coverage_cells(territory, "g", cover.polygon_cells(data, "g", f), f).first()[0] - 50) < 0.5


def test_presence_counts_rows_without_a_readable_shape(spark):
    df = shapes(spark, box_wkt(0, 45, 1, 46), "LINESTRING(0 45, 1 46)", "POLYGON((broken", None)
    row = profile_geometry(df, "g", Rules(), epsg=4326).first()
    assert (row.n_objects, row.present_pct, row.valid_pct) == (2, 50.0, 50.0)
    more = shapes(spark, "POINT(1 45)", "POINT(1 46)", "LINESTRING(0 45, 1 46)")
    assert profile_geometry(more, "g", Rules(), epsg=4326).first().geometry_types == "Point, LineString"


def test_most_frequent_kind_decides_whatever_the_row_order(spark):
    texts = ["LINESTRING(0 0, 9 9)", "POINT(0 0)", "POINT(5 1)", "POINT(2 7)"]
    rows = []
    for order in (texts, texts[::-1]):
        df = shapes(spark, *order).withColumn("k", F.monotonically_increasing_id())
        rows.append(compute_all_metrics(df, "k", "g").first())
    assert rows[0].fill == rows[1].fill and rows[0].kinds.other == rows[1].kinds.other == 1


def test_unknown_crs_is_compared_as_it_is(spark):
    territory = Territory(shapes(spark, box_wkt(9e8, 9e8, 9e8 + 4, 9e8 + 4)), "g", 4326, overlaps=False)
    row = profile_points(frame(spark, x=[9e8, 9e8 + 2], y=[9e8, 9e8 + 4]), "x", "y", territory=territory).first()
    assert row.crs == "Unknown" and row.coverage_pct == 50


def significance_directly(weights, z, permutations, ids):
    """Index and replicates from a dense row-standardised weight matrix."""
    n = len(z)
    rank = {i: k for k, i in enumerate(sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)))}
    at = np.array([rank[i] for i in ids])
    by_rank = np.empty(n)
    by_rank[at] = z
    s0 = (weights.sum(axis=1) > 0).sum()
    index = [n * (v @ weights @ v) / (s0 * (z @ z)) for _, a, b in neighbours.affine_maps(n, permutations, neighbours.SEED) for v in [by_rank[(a * at + b) % n]]]
    i, sims = index[0], np.array(index[1:])
    larger = int((sims >= i - abs(i) * 1e-9).sum())
    return i, (min(larger, permutations - larger) + 1) / (permutations + 1), (i - sims.mean()) / sims.std()


@pytest.mark.parametrize("hot, subsets", [(1000, 10), (2, 10), (2, 1), (1, 2)])
def test_significance_of_shapes(spark, monkeypatch, hot, subsets):
    monkeypatch.setattr(neighbours, "SUBSETS", subsets)
    chance = random.Random(hot + subsets)
    corners = [(chance.randrange(5), chance.randrange(5)) for _ in range(34)]
    texts = [f"POLYGON (({a} {b}, {a + 1} {b}, {a + 1} {b + 1}, {a} {b + 1}, {a} {b}))" for a, b in corners]
    values = [float(chance.randrange(50)) for _ in texts]
    df = spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(zip(texts, values))], "id long, t string, v double").withColumn("g", G.from_wkt(F.col("t")))
    touch = np.array([[float(i != j and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1) for j, b in enumerate(corners)] for i, a in enumerate(corners)])
    weights = touch / np.maximum(touch.sum(axis=1, keepdims=True), 1)
    i, p, score = significance_directly(weights, np.array(values) - np.mean(values), 150, list(range(len(texts))))
    got = neighbours.moran_queen_significance(df, "id", "g", "v", hot, permutations=150).first()
    assert (got["moran_i"], got["p_value"], got["z_score"]) == (pytest.approx(i, abs=1e-4), pytest.approx(p, abs=1e-4), pytest.approx(score, abs=1e-4))
    assert neighbours.moran_queen(df, "g", "v", hot).first()["moran_i"] == pytest.approx(i, abs=1e-4)


@pytest.fixture
def small_broadcasts(spark):
    """Fails broadcasts of more than 64 MB; a hash table of any size may take half of that."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def nearest_weights(xy, ids, k):
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    weights = np.zeros_like(d2)
    np.put_along_axis(weights, np.lexsort((np.broadcast_to(ids, d2.shape), d2))[:, :k], 1 / k, axis=1)
    return weights


@pytest.mark.parametrize("block, part", [(8192, 4096), (97, 50)])
def test_significance_of_points_sends_no_replicates_through_the_driver(spark, monkeypatch, small_broadcasts, block, part):
    monkeypatch.setattr(neighbours, "BLOCK", block, raising=False)
    monkeypatch.setattr(neighbours, "PART", part, raising=False)
    rng = np.random.default_rng(5)
    xy, ids, v = rng.integers(0, 60, (2500, 2)).astype(float), rng.permutation(2500), rng.random(2500)
    got = neighbours.moran_significance(frame(spark, id=ids, x=xy[:, 0], y=xy[:, 1], v=v), "id", "x", "y", "v").first()
    i, p, score = significance_directly(nearest_weights(xy, ids, 4), v - v.mean(), 999, list(ids))
    assert (got["moran_i"], got["p_value"], got["z_score"]) == (pytest.approx(i, abs=1e-4), pytest.approx(p, abs=1e-4), pytest.approx(score, abs=1e-4))


def shuffle_bytes(spark):
    """Of the shuffle files that are on disk now."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_"))


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_bytes(spark)
    got = materialize(spark.range(10_000).repartition(5, "id"), "kept")
    assert got.count() == 10_000 and shuffle_bytes(spark) < before + 10_000
    assert spark.conf.get(CLEANUP) == "false"


def test_significance_of_points_writes_no_replicates_to_disk(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, id=np.arange(2500), x=rng.random(2500), y=rng.random(2500), v=rng.random(2500))
    before = shuffle_bytes(spark)
    assert neighbours.moran_significance(df, "id", "x", "y", "v").first()["n"] == 2500
    # 999 replicates are 20 MB
    assert shuffle_bytes(spark) < before + 5e6


def test_significance_of_held_and_of_exchanged_values_with_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "PART", 50)
    rng = np.random.default_rng(7)
    # some ids have two, some three rows
    ids = np.concatenate([np.arange(200), np.arange(60), np.arange(30)])
    df = frame(spark, id=ids, x=rng.integers(0, 30, 290).astype(float), y=rng.random(290), v=(ids * 7 % 31).astype(float))
    rows = []
    for held in (1000, 0):
        monkeypatch.setattr(neighbours, "HELD", held)
        rows.append(neighbours.moran_significance(df, "id", "x", "y", "v", permutations=150).first())
    assert rows[0] == rows[1] and rows[0]["z_score"] is not None


def test_significance_of_parcels_sends_no_replicates_through_the_driver(spark, small_broadcasts):
    n = 50
    ring = F.array(*[G.xy(F.col(x), F.col(y)) for x, y in ("ab", "cb", "cd", "ad", "ab")])
    df = parcels(spark, n).select(F.monotonically_increasing_id().alias("id"), G.polygon(ring).alias("g"), ((F.col("a") * 7 + F.col("b") * 3) % 10).alias("v"))
    rows = df.select("id", "v", F.col("g.parts")[0][0][0].alias("p")).collect()
    at = np.array([[r.p.x, r.p.y] for r in rows])
    touch = (np.abs(at[:, None] - at[None]).max(axis=2) == 1).astype(float)
    v = np.array([r.v for r in rows])
    i, p, score = significance_directly(touch / touch.sum(axis=1, keepdims=True), v - v.mean(), 999, [r.id for r in rows])
    got = neighbours.moran_queen_significance(df, "id", "g", "v").first()
    assert (got["moran_i"], got["p_value"], got["z_score"]) == (pytest.approx(i, abs=1e-4), pytest.approx(p, abs=1e-4), pytest.approx(score, abs=1e-4))


def test_all_metrics_send_no_replicates_through_the_driver(spark, small_broadcasts):
    corners = parcels(spark, 50).withColumn("id", F.monotonically_increasing_id())
    points = corners.select("id", (F.col("a") % 3).alias("v"), G.point(F.col("a"), F.col("b")).alias("g"))
    ring = F.array(*[G.xy(F.col(x), F.col(y)) for x, y in ("ab", "cb", "cd", "ad", "ab")])
    solid = corners.select("id", (F.col("a") % 3).alias("v"), G.polygon(ring).alias("g"))
    for df in (points, solid):
        assert compute_all_metrics(df, "id", "g", value="v", grid_size=10.0).first().moran.n == 2500


def test_all_metrics_of_points_write_no_replicates_to_disk(spark):
    corners = parcels(spark, 50).withColumn("id", F.monotonically_increasing_id())
    points = corners.select("id", (F.col("a") * 7 % 3).alias("v"), G.point(F.col("a"), F.col("b")).alias("g"))
    before = shuffle_bytes(spark)
    assert compute_all_metrics(points, "id", "g", value="v", grid_size=10.0).first().moran.n == 2500
    assert shuffle_bytes(spark) < before + 5e6


def hash_broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_neighbours_of_points_are_joined_without_broadcasts(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, id=np.arange(300), x=rng.random(300), y=rng.random(300), v=rng.random(300))
    edges = neighbours.knn_edges(df, "id", "x", "y")
    links, homes = neighbours._neighbourhoods(df, edges)
    assert [hash_broadcasts(d) for d in (edges, homes)] == [0, 0]
    assert links.agg(F.sum("w")).first()[0] == 4 * 300


def test_shapes_and_cells_are_joined_without_broadcasts(spark):
    ring = F.array(*[G.xy(F.col(x), F.col(y)) for x, y in ("ab", "cb", "cd", "ad", "ab")])
    df = parcels(spark, 9).select(G.polygon(ring).alias("g"))
    sums = neighbours.queen_sums(neighbours.queen_groups(df, "g", F.lit(1.0)), hot=3)
    f = cover.frame(cover.geometry_box(df, "g"))
    share = cover.coverage_cells(df, "g", cover.polygon_cells(df, "g", f), f, overlaps=False)
    assert [hash_broadcasts(d) for d in (sums, share)] == [0, 0]
    assert sums.agg(F.sum("cnt")).first()[0] == 4 * 3 + 28 * 5 + 49 * 8 and share.first()[0] == pytest.approx(100, abs=0.5)


def test_significance_of_nothing_and_of_equal_values(spark):
    df = spark.createDataFrame([(k, float(k), 0.0, 1.0) for k in range(5)], "id long, x double, y double, v double")
    none = neighbours.moran_significance(df.where("id = 1"), "id", "x", "y", "v", permutations=9).first()
    assert none["n"] == 1 and none["moran_i"] is None and none["interpretation"] is None
    assert neighbours.moran_significance(df, "id", "x", "y", "v", permutations=9).first()["p_value"] is None


def test_ten_thousand_sets_over_shared_vertices(spark):
    # every shape has the two crowded vertices and one of its own pair
    n = 10_000
    rows = spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("g"),
        F.array(G.xy(F.lit(0), F.lit(0)), G.xy(F.lit(1), F.lit(0)), G.xy(F.floor(F.col("id") / 2) + 2, F.lit(5))).alias("v"),
        F.lit(1).cast("bigint").alias("m"), F.lit(1.0).alias("s"), F.lit(1.0).alias("ss"),
    )
    sums = neighbours.queen_sums(rows, 100)
    assert sums.where((F.col("cnt") != n - 1) | (F.col("sum") != n - 1.0)).count() == 0 and sums.count() == n


def parcels(spark, n, side=1.0):
    """n x n parcels as boxes, side by side from (10, 0) on."""
    x, y = (F.col("id") % n) * side + 10, F.floor(F.col("id") / n) * side
    return spark.range(n * n).select(x.alias("a"), y.alias("b"), (x + side).alias("c"), (y + side).alias("d"))


def overlap(rows):
    return cover.reference_overlap_check(rows.select(G.line(*[F.col(c) for c in "abcd"]).alias("g")), "g").first()["overlaps"]


def test_one_large_box_among_many_small_ones(spark):
    box = lambda *v: spark.createDataFrame([tuple(map(float, v))], "a double, b double, c double, d double")
    small = parcels(spark, 150)
    assert not overlap(small.unionByName(box(-5000, 0, 10, 150)))
    assert not overlap(small.unionByName(box(-1e9, -1e9, 10, 1e9)))
    assert overlap(small.unionByName(box(-5000, 0, 10.5, 0.25)))
    assert overlap(small.unionByName(box(0, 0, 1000, 1000)))
    # strips, a scatter over many scales, and two that share a sliver
    strips = spark.range(5000).select(F.lit(0.0).alias("a"), F.col("id").cast("double").alias("b"), F.lit(1e6).alias("c"), (F.col("id") + 1).cast("double").alias("d"))
    assert not overlap(strips) and overlap(strips.unionByName(box(5, 77.5, 6, 77.75)))
    scales = spark.range(300).select(F.pow(F.lit(1.1), "id").alias("a"), F.lit(0.0).alias("b"), F.pow(F.lit(1.1), F.col("id") + 1).alias("c"), F.pow(F.lit(1.1), "id").alias("d"))
    assert not overlap(scales) and overlap(scales.unionByName(box(1.0, 0.5, 1.0000001, 0.6)))


def test_neighbours_with_one_place_very_far(spark):
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.random((3600, 2)) * 1e-3, [[1e12, -1e12]], [[-3e5, 7.0]]])
    ids = rng.permutation(len(xy))
    df = frame(spark, id=ids, x=xy[:, 0], y=xy[:, 1])
    got = neighbours.knn_edges(df, "id", "x", "y", 3).toPandas().sort_values(["src", "rank"]).groupby("src").dst.apply(list).to_dict()
    assert got == neighbours_directly(xy, ids, 3)
    points = df.select("id", "x", "y", F.lit(0.0).alias("z"))
    places = neighbours._places(points, 3)
    leaves, _ = neighbours._leaves(places, neighbours._frame(places), 32)
    assert leaves.groupBy(*neighbours.CELL).count().agg(F.max("count")).first()[0] <= 32


def test_scan_lines_of_a_polygon_of_a_million_edges(spark):
    n = 1_000_000
    ring = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: G.xy(F.cos(2 * np.pi / n * (k % n)), F.sin(2 * np.pi / n * (k % n))))
    df = spark.range(1).select(G.polygon(ring).alias("g"))
    f = cover.frame(cover.geometry_box(df, "g"))
    cell = 2 * np.sqrt(2) * cover.BUFFER_SHARE / cover.CELLS_PER_BUFFER
    n_cells = cover.span_count(cover.polygon_spans(df, "g", f)).first()["n_cells"]
    assert n_cells * cell**2 == pytest.approx(np.pi, rel=1e-3)
    plan = cover.polygon_spans(df, "g", f)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(edges" in plan


def test_scan_lines_of_equal_shapes_and_holes(spark):
    texts = ["POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 8, 8 8, 8 2, 2 2))"] * 2 + ["POLYGON ((3 3, 7 3, 7 7, 3 7, 3 3))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(G.from_wkt(F.col("t")).alias("g"))
    f = cover.frame(cover.geometry_box(df, "g"))
    cell = np.sqrt(200) * cover.BUFFER_SHARE / cover.CELLS_PER_BUFFER
    assert cover.span_count(cover.polygon_spans(df, "g", f)).first()["n_cells"] * cell**2 == pytest.approx(100 - 36 + 16, rel=2e-3)


def test_text_geometry_is_measured_by_hulls(spark):
    from terraprofile.plans.dataset_profile import dataset_profile

    texts = {
        "points": [f"POINT ({x} {y})" for x, y in ((200000, 6500000), (210000, 6500000), (200000, 6510000), (202000, 6502000))],
        "polygons": ["POLYGON ((200000 6500000, 210000 6500000, 210000 6510000, 200000 6500000))", "POLYGON ((230000 6500000, 240000 6500000, 240000 6510000, 230000 6510000, 230000 6500000))"],
    }
    territory = Territory(spark.createDataFrame([("POLYGON ((200000 6500000, 240000 6500000, 240000 6520000, 200000 6520000, 200000 6500000))",)], "t string").select(G.from_wkt(F.col("t")).alias("g")), "g", 2154)
    rows = {k: dataset_profile(spark.createDataFrame([(t,) for t in v], "geometry string"), k, territory=territory).first() for k, v in texts.items()}
    figures = lambda r: [r[c] for c in ("Emprise estimée (km2)", "Densité (obj/km2)", "Taux de remplissage géométrique (%)", "Couverture territoriale hexagonale (%)")]
    assert figures(rows["points"]) == [50.0, 0.08, 50.0, 6.25]
    area, density, fill, share = figures(rows["polygons"])
    assert (area, density, share) == (350.0, 0.01, 43.75) and fill == pytest.approx(37.5, abs=0.5)


def test_shapes_are_parsed_once_for_boxes_and_coverage(spark):
    df = spark.createDataFrame([(box_wkt(0, 0, 2, 1),), (box_wkt(5, 5, 6, 6),), ("broken",), (None,)], "t string").withColumn("g", G.from_wkt(F.col("t")))
    b = df.select(G.bbox(F.col("g")).alias("b")).select("b.*")
    lines = b.select(G.line(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]).alias("g"))
    covered = cover.coverage_envelope(df, "g", spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("minx", 0.0), ("miny", 0.0), ("maxx", 1.0), ("maxy", 1.0))]), overlaps=False)
    for found in (cover.boxes(df, "g"), cover.boxes(lines, "g"), covered):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert sorted(tuple(r) for r in cover.boxes(lines, "g").collect()) == [(0.0, 0.0, 2.0, 1.0), (5.0, 5.0, 6.0, 6.0)]
    assert covered.first()[0] == pytest.approx(100 / 3, abs=1e-4)
