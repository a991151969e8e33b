"""Neighbour graphs and spatial autocorrelation (Moran's I).

Nearest neighbours are exact. Rows are first reduced to distinct places, which
keep only their few smallest ids, so any number of copies costs one row. Places
are spread over a quadtree whose leaves hold few of them however dense the data
is locally. Distances inside the own leaf bound each place's search radius, and
only leaves that radius reaches are looked at. Every step is an equi-join on a
cell or place; no step meets all pairs of a group.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.functions import geometry as G
from terraprofile.operators.clean import col
from terraprofile.session import materialize, shuffled

NEIGHBOURS = 4
LEAF_CAPACITY = 32
HOT_VERTEX = 1000
SUBSETS = 10
PERMUTATIONS = 999
CHUNK = 125
BLOCK = 8192
PART = 4096
HELD = 1 << 24
SEED = 12345
SIGNIFICANT = 0.05
CELL = ["lvl", "cx", "cy"]


# ------------------------------------------------------------------ places, tree

def _places(points: DataFrame, k: int) -> DataFrame:
    """Distinct positions with their k + 1 smallest ids, row count and value sum."""
    w = Window.partitionBy("x", "y").orderBy("id")
    # the rank filter is pushed below the shuffle, so copies of a place stay in their task
    first = (
        points.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
        .groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("id", "z"))).alias("ids"))
    )
    sums = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"), F.sum("z").alias("sz"))
    return first.join(shuffled(sums), ["x", "y"])


def _frame(places: DataFrame) -> dict:
    """The root cell: its side is a power of two, so cells of any depth have exact bounds."""
    r = places.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far"), F.count(F.lit(1)).alias("n"), F.sum("m").alias("rows")).first()
    power = math.frexp(r["far"] or 1.0)[1] + 1
    return {"power": power, "side": math.ldexp(1.0, power), "n": r["n"], "rows": r["rows"] or 0}


def _cell(v: Column, fr: dict, level: Column) -> Column:
    """Index of a cell of side 2**(power - level); the root, level 0, holds both signs.

    Scaling by a power of two loses nothing, so places that differ are told apart at some level,
    and as digits are limited, the index there fits 64 bits.
    """
    return F.when(level == 0, F.lit(0)).otherwise(F.floor(v * F.pow(F.lit(2.0), level - fr["power"]))).cast("bigint")


def _up(index: Column, level: Column, to: Column) -> Column:
    """The index of the cell's ancestor at a level; beyond 63 levels only the sign is left."""
    return F.when(to == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftright", index, F.least(level - to, F.lit(63))))


def _at_level(df: DataFrame, fr: dict, level: Column) -> DataFrame:
    return df.withColumn("lvl", level.cast("int")).withColumns({"cx": _cell(F.col("x"), fr, F.col("lvl")), "cy": _cell(F.col("y"), fr, F.col("lvl"))})


def _deepest(x: Column, y: Column, fr: dict) -> Column:
    """The level down to which the indices of a place fit 62 bits."""
    far = F.greatest(F.abs(x), F.abs(y))
    return F.when(far > 0, F.floor(fr["power"] + 62 - F.log2(far))).otherwise(1000).cast("int")


def _leaves(places: DataFrame, fr: dict, capacity: int) -> tuple[DataFrame, int]:
    """Places with their leaf cell, and the coarsest leaf level.

    Crowded cells are split until they are not: at once down to the size of the box around their
    places, so the depth follows the data and one place far from all others costs one round.
    """
    start = max(0, min(30, math.ceil(math.log(max(fr["n"], 1) / (capacity / 2), 4)) if fr["n"] > capacity else 0))
    placed = _at_level(places, fr, F.lit(start))
    while True:
        size = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
        deepest = F.min(_deepest(F.col("x"), F.col("y"), fr))
        cells = placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("c"), size.alias("size"), deepest.alias("deepest"))
        around = F.floor(fr["power"] - F.log2("size")) - 1
        wanted = F.greatest(F.col("lvl"), around) + F.greatest(F.lit(1), F.ceil(F.log(4.0, F.col("c") / capacity)))
        crowded = cells.where((F.col("c") > capacity) & (F.col("size") > 0)).select(*CELL, F.least(wanted, F.col("deepest")).cast("int").alias("to")).where("to > lvl")
        crowded = materialize(crowded, "crowded")
        if crowded.isEmpty():
            return placed, start
        marked = placed.join(shuffled(crowded), CELL, "left")
        placed = materialize(_at_level(marked.withColumn("lvl", F.coalesce("to", "lvl")), fr, F.col("lvl")).drop("to"), "leaves")


def _ancestors(cells: DataFrame, *keep: str) -> DataFrame:
    """Every cell under each of its levels up to the root."""
    up = F.sequence(F.lit(0), F.col("lvl"))
    leaf = lambda c: F.col(f"leaf_{c}")
    return cells.select(*keep, *[F.col(c).alias(f"leaf_{c}") for c in CELL], F.explode(up).alias("l")).select(
        *keep, *[f"leaf_{c}" for c in CELL], F.col("l").alias("lvl"), _up(leaf("cx"), leaf("lvl"), F.col("l")).alias("cx"), _up(leaf("cy"), leaf("lvl"), F.col("l")).alias("cy")
    )


def _square(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def _top(entries: DataFrame, k: int) -> DataFrame:
    """Per place ``near``, the k + 1 entries nearest to it, ties by id."""
    w = Window.partitionBy("place").orderBy("d2", "id")
    first = entries.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    return first.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("d2", "id", "z"))).alias("near"))


def nearest_lists(df: DataFrame, id: str, x: str, y: str, value: str | None = None, k: int = NEIGHBOURS, capacity: int = LEAF_CAPACITY) -> DataFrame:
    """Per distinct place ``(x, y, m, sz, near)``.

    ``near`` lists the k + 1 rows nearest to the place, its own rows included,
    as ``(d2, id, z)`` by distance and id. A row's neighbours are ``near``
    without the row itself, cut to k. ``m`` and ``sz`` are the number of rows
    at the place and the sum of their values.
    """
    z = col(value).cast("double") if value else F.lit(0.0)
    # NULL, NaN and infinite coordinates are no places
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    points = df.select(col(id).alias("id"), col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), z.alias("z")).where(finite)
    # places go by number: joins and windows over pairs of doubles would deal the same rows out again each
    places = materialize(_places(points, k).withColumn("place", F.monotonically_increasing_id()), "places")
    fr = _frame(places)
    placed, start = _leaves(places.select("place", "x", "y", "m", "ids"), fr, capacity)
    leaf = materialize(placed, "leaf")

    q = leaf.select("place", F.col("x").alias("px"), F.col("y").alias("py"), *CELL)
    other = shuffled(leaf.select("x", "y", "ids", *CELL))
    d2 = _square(F.col("px"), F.col("x")) + _square(F.col("py"), F.col("y"))
    entry = lambda rows: rows.select("place", d2.alias("d2"), F.explode("ids").alias("e")).select("place", "d2", "e.id", "e.z")
    own = materialize(_top(entry(q.join(other, CELL)), k), "own")

    # search radius: the (k+1)-th distance in the own leaf, or the diagonal of the
    # smallest enclosing cell with enough rows
    reach = own.select("place", F.size("near").alias("have"), F.element_at("near", -1)["d2"].alias("d2"))
    need = min(k + 1, fr["rows"])
    cells = leaf.groupBy(*CELL).agg(F.sum("m").alias("rows"))
    above = _ancestors(cells, "rows")
    enough = above.groupBy(*CELL).agg(F.sum("rows").alias("rows")).where(F.col("rows") >= need).select(*CELL)
    sparse = _ancestors(cells.where(F.col("rows") < need).select(*CELL))
    roomy = sparse.join(shuffled(enough), CELL).groupBy(*[F.col(f"leaf_{c}").alias(c) for c in CELL]).agg(F.max("lvl").alias("roomy_lvl"))
    diagonal = F.lit(fr["side"] * math.sqrt(2)) / F.pow(F.lit(2.0), F.col("roomy_lvl"))
    known = q.join(shuffled(reach), "place").join(shuffled(roomy), CELL, "left").select(
        "place", "px", "py", *CELL,
        (F.when(F.col("have") >= need, F.sqrt("d2")).otherwise(diagonal) * (1 + 1e-9)).alias("r"),
    )

    def edge(c: str, beyond: int) -> Column:
        return (F.col(c) + beyond) * F.pow(F.lit(2.0), fr["power"] - F.col("lvl"))

    # a disc within its own leaf needs no other
    inside = (
        (F.col("px") - F.col("r") > edge("cx", 0)) & (F.col("px") + F.col("r") < edge("cx", 1))
        & (F.col("py") - F.col("r") > edge("cy", 0)) & (F.col("py") + F.col("r") < edge("cy", 1))
    )
    seekers = known.where((F.col("r") > 0) & ~inside)
    # at this level the disc spans at most two cells each way
    reach_level = F.floor(fr["power"] - F.log2(F.col("r") * 2))
    deepest = _deepest(F.greatest(F.abs("px"), F.abs("py")) + F.col("r"), F.lit(0.0), fr)
    fit = F.greatest(F.lit(0), F.least(reach_level, deepest)).cast("int")
    base = seekers.select("place", "px", "py", "r", *[F.col(c).alias(f"own_{c}") for c in CELL], fit.alias("fit"))
    span = lambda v: F.sequence(_cell(F.col(v) - F.col("r"), fr, F.col("fit")), _cell(F.col(v) + F.col("r"), fr, F.col("fit")))
    # a leaf lies under a fitting cell, or is itself a coarser cell around the disc's place
    at_fit = F.flatten(
        F.transform(
            span("px"),
            lambda a: F.transform(
                span("py"), lambda b: F.struct(F.lit(True).alias("under"), F.col("fit").alias("lvl"), a.alias("cx"), b.alias("cy"))
            ),
        )
    )
    levels = F.when(F.col("fit") > start, F.sequence(F.lit(start), F.col("fit") - 1)).otherwise(F.array().cast("array<int>"))
    coarser = F.flatten(
        F.transform(
            "cells",
            lambda c: F.transform(
                levels,
                lambda l: F.struct(
                    F.lit(False).alias("under"),
                    l.alias("lvl"),
                    _up(c["cx"], F.col("fit"), l).alias("cx"),
                    _up(c["cy"], F.col("fit"), l).alias("cy"),
                ),
            ),
        )
    )
    own_cell = [F.col(f"own_{c}") for c in CELL]
    keyed = base.select("place", "px", "py", "r", *own_cell, "fit", at_fit.alias("cells")).select(
        "place", "px", "py", "r", *own_cell, F.explode(F.concat("cells", F.array_distinct(coarser))).alias("c")
    ).select("place", "px", "py", "r", *own_cell, "c.*")
    tree = _ancestors(cells.select(*CELL))
    itself = tree.where(F.col("lvl") == F.col("leaf_lvl"))
    index = tree.select(F.lit(True).alias("under"), "*").unionByName(itself.select(F.lit(False).alias("under"), "*"))
    found = keyed.join(shuffled(index), ["under", *CELL]).where(
        ~((F.col("leaf_lvl") == F.col("own_lvl")) & (F.col("leaf_cx") == F.col("own_cx")) & (F.col("leaf_cy") == F.col("own_cy")))
    )
    size = F.pow(F.lit(2.0), fr["power"] - F.col("leaf_lvl"))
    gap = lambda v, c: F.greatest(F.lit(0.0), F.col(c) * size - F.col(v), F.col(v) - (F.col(c) + 1) * size)
    near = _square(gap("px", "leaf_cx"), F.lit(0.0)) + _square(gap("py", "leaf_cy"), F.lit(0.0))
    visits = found.where(near <= F.col("r") * F.col("r")).select("place", "px", "py", "r", *[F.col(f"leaf_{c}").alias(c) for c in CELL])
    far = materialize(_top(entry(visits.join(other, CELL).where(d2 <= F.col("r") * F.col("r"))), k), "far").withColumnRenamed("near", "far")
    best = F.slice(F.sort_array(F.concat("near", F.coalesce("far", F.array()))), 1, k + 1)
    lists = places.drop("ids").join(shuffled(own), "place").join(shuffled(far), "place", "left")
    return lists.select("x", "y", "m", "sz", best.alias("near"))


def _without(near: Column, id: Column, k: int) -> Column:
    return F.slice(F.filter(near, lambda e: e["id"] != id), 1, k)


def knn_edges(df: DataFrame, id: str, x: str, y: str, k: int = NEIGHBOURS, value: str | None = None) -> DataFrame:
    """Directed edges ``(src, dst, rank, distance)`` to the k nearest rows, ties by id."""
    lists = nearest_lists(df, id, x, y, value, k).select("x", "y", "near")
    rows = df.select(col(id).alias("src"), col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    near = F.posexplode(_without(F.col("near"), F.col("src"), k))
    return rows.join(shuffled(lists), ["x", "y"]).select("src", near.alias("rank", "e")).select(
        "src", F.col("e.id").alias("dst"), (F.col("rank") + 1).cast("bigint").alias("rank"), F.sqrt("e.d2").alias("distance")
    )


# --------------------------------------------------------------------- statistic

def _moran_row(n: Column, s0: Column, num: Column, den: Column) -> list[Column]:
    return [
        F.round(F.try_divide(n * num, s0 * den), 4).alias("moran_i"),
        F.round(F.try_divide(F.lit(-1.0), n - 1), 4).alias("expected_i"),
        n.cast("bigint").alias("n"),
    ]


def moran_knn(df: DataFrame, id: str, x: str, y: str, value: str, k: int = NEIGHBOURS) -> DataFrame:
    """Moran's I with k nearest neighbours and row-standardised weights.

    It is summed over places: rows of a place outside its ``near`` list share
    the same neighbours, so only their value sum is needed.
    """
    rows = df.where(col(x).isNotNull() & col(y).isNotNull() & col(value).isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(col(value)).alias("mean"), F.var_pop(col(value)).alias("var"))
    t = total.first()
    n, mean = t["n"], t["mean"] or 0.0
    k = max(1, min(k, n - 1))
    centred = rows.withColumn("_z", col(value) - F.lit(mean))
    lists = nearest_lists(centred, id, x, y, "_z", k)
    mean_z = lambda es: F.aggregate(es, F.lit(0.0), lambda a, e: a + e["z"]) / F.size(es)
    mine = F.filter("near", lambda e: e["d2"] == 0)
    listed = F.aggregate(mine, F.lit(0.0), lambda a, e: a + e["z"])
    shared = F.when(F.col("m") > F.size(mine), (F.col("sz") - listed) * mean_z(F.slice("near", 1, k))).otherwise(0.0)
    single = F.aggregate(mine, F.lit(0.0), lambda a, e: a + e["z"] * mean_z(_without(F.col("near"), e["id"], k)))
    num = lists.agg(F.sum(shared + single).alias("num"))
    c = lambda v: F.lit(v).cast("double")
    return num.select(*_moran_row(c(n), c(n), F.col("num"), c((t["var"] or 0.0) * n)))


def queen_groups(df: DataFrame, geometry: str, value: Column) -> DataFrame:
    """Equal shapes as one row: key, distinct vertices, row count and value sums."""
    rows = df.where(col(geometry).isNotNull()).select(
        F.sha2(G.as_wkt(col(geometry)), 256).alias("g"), F.array_distinct(G.vertices(col(geometry))).alias("v"), value.alias("z")
    )
    return rows.groupBy("g").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("m"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("ss")
    )


def _corners(groups: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Shapes by vertices that few others have, and per shape the set of its crowded ones."""
    corner = groups.select("g", F.explode("v").alias("p"))
    degree = corner.groupBy("p").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") > 1)
    shared = corner.join(shuffled(degree), "p")
    sets = shared.where(F.col("deg") > hot).groupBy("g").agg(F.sort_array(F.collect_set("p")).alias("hot"))
    return shared.where(F.col("deg") <= hot).select("p", "g"), sets


def queen_pairs(few: DataFrame, sets: DataFrame) -> DataFrame:
    """Directed pairs of shapes that share a vertex of few shapes and no crowded one."""
    few = few.join(shuffled(sets), "g", "left")
    a = few.select("p", F.col("g").alias("a"), F.col("hot").alias("ha"))
    b = few.select("p", F.col("g").alias("b"), F.col("hot").alias("hb"))
    met = F.coalesce(F.arrays_overlap("ha", "hb"), F.lit(False))
    return a.join(shuffled(b), "p").where((F.col("a") != F.col("b")) & ~met).select("a", "b").distinct()


def _subsets(hot: Column) -> Column:
    """Every non-empty subset of a set, with the sign it has in inclusion and exclusion."""
    empty = F.array(F.struct(F.lit(-1).alias("sign"), F.slice(hot, 1, 0).alias("part")))
    grown = F.aggregate(
        hot, empty, lambda acc, p: F.concat(acc, F.transform(acc, lambda s: F.struct((-s["sign"]).alias("sign"), F.concat(s["part"], F.array(p)).alias("part"))))
    )
    return F.filter(grown, lambda s: F.size(s["part"]) > 0)


def _crowded_links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which sets of crowded vertices overlap, without meeting them pairwise.

    Of sets with up to ``SUBSETS`` vertices, those that overlap a set follow from the sums over all
    sets that contain each of its subsets: rows (g, part, sign). Only larger sets are met in pairs.
    Both give directed links between all shapes with a crowded vertex, each with itself too.
    """
    small = sets.where(F.size("hot") <= SUBSETS).select("g", F.explode(_subsets(F.col("hot"))).alias("s")).select("g", "s.part", "s.sign")
    by_set = sets.select("hot").distinct()
    left = by_set.select(F.col("hot").alias("ha"), F.explode("hot").alias("p"))
    right = by_set.select(F.col("hot").alias("hb"), F.explode("hot").alias("p"))
    large = (F.size("ha") > SUBSETS) | (F.size("hb") > SUBSETS)
    pairs = left.where(F.size("ha") > SUBSETS).join(shuffled(right), "p").unionByName(left.where(F.size("ha") <= SUBSETS).join(shuffled(right.where(F.size("hb") > SUBSETS)), "p"))
    return small, pairs.where(large).select("ha", "hb").distinct()


def queen_sums(groups: DataFrame, hot: int = HOT_VERTEX) -> DataFrame:
    """Per shape the number and value sum of the rows of other shapes sharing a vertex.

    Vertices of few shapes give pairs. Vertices of more than ``hot`` shapes do not: shapes meet
    there through sums over sets of such vertices; pairs met there are left out of the rest.
    """
    few, sets = _corners(groups, hot)
    own = shuffled(groups.select("g", "m", "s"))
    pairs = queen_pairs(few, sets).join(own.select(F.col("g").alias("b"), "m", "s"), "b")
    direct = pairs.groupBy(F.col("a").alias("g")).agg(F.sum("m").alias("cnt"), F.sum("s").alias("sum"))
    small, linked = _crowded_links(sets)
    parts = small.join(own, "g")
    of_part = parts.groupBy("part").agg(F.sum("m").alias("pm"), F.sum("s").alias("ps"))
    through = parts.join(shuffled(of_part), "part").groupBy("g").agg(
        (F.sum(F.col("sign") * F.col("pm")) - F.first("m")).alias("cnt"), (F.sum(F.col("sign") * F.col("ps")) - F.first("s")).alias("sum")
    )
    by_set = sets.join(own, "g").groupBy("hot").agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    far = linked.join(shuffled(by_set), F.col("hb") == F.col("hot")).groupBy("ha").agg(F.sum("m").alias("lm"), F.sum("s").alias("ls"))
    # a large set meets itself among its pairs, so its shapes leave themselves out here
    large = F.size("hot") > SUBSETS
    through_large = sets.join(own, "g").join(shuffled(far), F.col("hot") == F.col("ha")).select(
        "g", (F.col("lm") - F.when(large, F.col("m")).otherwise(0)).alias("cnt"), (F.col("ls") - F.when(large, F.col("s")).otherwise(0.0)).alias("sum")
    )
    return direct.unionByName(through).unionByName(through_large).groupBy("g").agg(F.sum("cnt").alias("cnt"), F.sum("sum").alias("sum"))


def moran_queen(df: DataFrame, geometry: str, value: str, hot: int = HOT_VERTEX) -> DataFrame:
    """Moran's I on shapes that share a vertex; rows of equal shapes are neighbours too."""
    rows = df.where(col(geometry).isNotNull() & col(value).isNotNull())
    mean = rows.agg(F.avg(col(value)).alias("mean")).scalar()
    groups = materialize(queen_groups(rows, geometry, col(value).cast("double") - mean), "shapes")
    sums = groups.join(shuffled(queen_sums(groups, hot)), "g", "left").select(
        "m", "s", "ss", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("sum", F.lit(0.0)).alias("sum")
    )
    around = F.col("cnt") + F.col("m") - 1
    num = F.when(around > 0, (F.col("s") * (F.col("sum") + F.col("s")) - F.col("ss")) / around).otherwise(0.0)
    return sums.agg(
        F.sum("m").alias("n"), F.sum(F.when(around > 0, F.col("m")).otherwise(0)).alias("s0"), F.sum(num).alias("num"), F.sum("ss").alias("den")
    ).select(*_moran_row(F.col("n").cast("double"), F.col("s0").cast("double"), F.col("num"), F.col("den")))


# Interpretation texts.
POSITIVE = "Autocorrelation positive significative (clustering)"
NEGATIVE = "Autocorrelation negative significative (dispersion)"
RANDOM = "Pas d autocorrelation significative (distribution aleatoire)"


def numbered(df: DataFrame, *order: str, keep: Sequence[str]) -> DataFrame:
    """Some columns and ``idx``, which numbers the rows 0..n-1 in the order of others.

    Rows are dealt by ranges of these and sorted there; the ranges' sizes (one row per range)
    give the offsets.
    """
    spread = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("_n")), "numbered")
    part = F.shiftrightunsigned(F.col("_n"), 33)
    sizes = spread.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("offset"))
    return spread.withColumn("part", part).join(offsets, "part").withColumn(
        "idx", F.col("offset") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("_n", "part", "offset")


def dense_index(df: DataFrame, id: str) -> DataFrame:
    """Number rows 0..n-1 by the digest of their id."""
    digest = F.unhex(F.md5(col(id).cast("string").cast("binary")))
    return numbered(df.withColumns({"_h": digest, "_id": col(id)}), "_h", "_id", keep=df.columns)


def affine_maps(n: int, permutations: int, seed: int) -> list[tuple[int, int, int]]:
    """(r, a, b) of the permutations i -> (a i + b) mod n, r 0 being the identity.

    Both numbers come from a digest of seed and r; a is the next one coprime to n, and so small
    that a i does not leave 64 bits.
    """
    draw = lambda r, what: int(hashlib.md5(f"{seed}:{r}:{what}".encode()).hexdigest()[:8], 16)
    maps = [(0, 1, 0)]
    for r in range(1, permutations + 1):
        a = 1 + draw(r, "a") % max(1, min(n - 1, 2**62 // n))
        while math.gcd(a, n) != 1:
            a += 1
        maps.append((r, a, draw(r, "b") % n))
    return maps


def _chunk_maps(maps: list[tuple[int, int, int]], chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers a and b of a chunk's maps, as columns."""
    part = np.array(maps[chunk * CHUNK : (chunk + 1) * CHUNK], dtype=np.int64)
    return part[:, 1:2], part[:, 2:3]


def _sender(n: int, maps: list[tuple[int, int, int]], chunks: Sequence[int]) -> Callable:
    """Deals a block's values to the blocks whose rows get them: by map, then by the place they come from."""
    back = [(r, pow(a, -1, n), b) for r, a, b in maps]

    def send(key: tuple, block: pa.Table) -> pa.Table:
        at, z = block["idx"].to_numpy(), block["z"].to_numpy()
        order = np.argsort(at)
        at, z = at[order], z[order]
        tables = []
        for chunk in chunks:
            a, b = _chunk_maps(back, chunk)
            to = (((at - b) % n * a) % n // BLOCK).ravel()
            dealt = np.argsort(to, kind="stable")
            blocks, starts = np.unique(to[dealt], return_index=True)
            ends = pa.array(np.append(starts, len(to)).astype(np.int32))
            tables.append(pa.table({
                "to": blocks, "chunk": np.full(len(blocks), chunk, dtype=np.int32), "origin": np.full(len(blocks), key[0].as_py(), dtype=np.int64),
                "zs": pa.ListArray.from_arrays(ends, pa.array(z[dealt % len(at)])),
            }))
        return pa.concat_tables(tables)

    return send


def _receiver(n: int, maps: list[tuple[int, int, int]]) -> Callable:
    """Puts the values sent to a block into the order of its rows, one vector a row."""

    def receive(key: tuple, rows: pa.Table, sent: pa.Table) -> pa.Table:
        first, (a, b) = key[0].as_py() * BLOCK, _chunk_maps(maps, key[1].as_py())
        at = (np.arange(first, min(n, first + BLOCK)) * a + b) % n
        by_place = np.argsort(at, axis=1)
        origin = np.take_along_axis(at, by_place, 1) // BLOCK
        place = (by_place + np.arange(len(a))[:, None] * at.shape[1]).ravel()[np.argsort(origin.ravel(), kind="stable")]
        values = np.empty(at.size)
        values[place] = pc.list_flatten(sent.sort_by("origin")["zs"].combine_chunks()).to_numpy()
        vectors = values.reshape(at.shape).T[rows["idx"].to_numpy() - first]
        ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * len(a))
        return rows.drop_columns(["block", "idx"]).append_column("zs", pa.ListArray.from_arrays(ends, pa.array(vectors.ravel())))

    return receive


def relabelled(rows: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """Per row (id, z and others) its values under all relabellings, as vectors: id, others, chunk, zs.

    A vector holds ``CHUNK`` replicates, those of chunk c being numbered from c * CHUNK. Rows are
    numbered and cut into blocks; a block sends each other block the values that this one's rows get
    under all maps of a chunk, as one list in an order that both sides know from the maps. So a value
    moves once a replicate, without a key, and a task holds one block and one chunk of it.
    """
    nodes = materialize(dense_index(rows, "id"), "nodes")
    return relabelled_chunks(nodes, n, permutations, seed, range(permutations // CHUNK + 1))


def relabelled_chunks(nodes: DataFrame, n: int, permutations: int, seed: int, chunks: Sequence[int]) -> DataFrame:
    """:func:`relabelled` for some chunks of rows that :func:`dense_index` has numbered."""
    maps = affine_maps(n, permutations, seed)
    nodes = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK))
    sent = nodes.select("block", "idx", "z").groupBy("block").applyInArrow(_sender(n, maps, chunks), "to bigint, chunk int, origin bigint, zs array<double>")
    asked = nodes.drop("z").withColumn("chunk", F.explode(F.array(*[F.lit(c) for c in chunks])))
    schema = T.StructType([*asked.drop("block", "idx").schema.fields, T.StructField("zs", T.ArrayType(T.DoubleType()))])
    found = asked.groupBy("block", "chunk").cogroup(sent.groupBy("to", "chunk")).applyInArrow(_receiver(n, maps), schema)
    counts = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if counts.isEmpty():
        return found
    # rows of one id share a vector: the first of all their values by replicate
    pairs = F.sort_array(F.flatten(F.collect_list(F.transform("zs", lambda z, k: F.struct(k.alias("k"), z.alias("z"))))))
    others = [F.first(c).alias(c) for c in nodes.columns if c not in ("id", "z", "idx", "block")]
    return found.groupBy("id", "chunk").agg(*others, F.transform(F.slice(pairs, 1, F.first(F.size("zs"))), lambda e: e["z"]).alias("zs"))


def vector_sums(df: DataFrame, keys: Sequence[str], **vectors: Column) -> DataFrame:
    """Sums of vectors, element by element: one fixed-size partial sum a key and task."""
    elements = lambda v: F.array(*[F.sum(F.get(v, F.lit(i))) for i in range(CHUNK)])
    return df.groupBy(*keys).agg(*[elements(v).alias(name) for name, v in vectors.items()])


def _times(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda p, q: p * q)


def _by_replicate(sums: DataFrame, vector: str) -> DataFrame:
    """(r, num) from rows of chunk sums; rows of one replicate are added."""
    long = sums.select("chunk", F.posexplode(vector).alias("k", "v")).where("v IS NOT NULL")
    return long.groupBy((F.col("chunk") * CHUNK + F.col("k")).alias("r")).agg(F.sum("v").alias("num"))


def _significance_row(stats: DataFrame, n: int, permutations: int) -> DataFrame:
    """The report of a permutation test from (r, i), the index under each relabelling, 0 being none."""
    observed = F.max(F.when(F.col("r") == 0, F.col("i")))
    summary = stats.agg(
        observed.alias("i"),
        F.avg(F.when(F.col("r") > 0, F.col("i"))).alias("mean"),
        F.stddev_pop(F.when(F.col("r") > 0, F.col("i"))).alias("std"),
        F.collect_list(F.when(F.col("r") > 0, F.col("i"))).alias("sims"),
    )
    # a relabelling that changes nothing counts as reaching the index, whatever the order of its sum
    larger = F.size(F.filter("sims", lambda s: s >= F.col("i") - F.abs("i") * 1e-9))
    tail = F.least(larger, F.lit(permutations) - larger)
    p = F.when(F.col("i").isNotNull(), (tail + 1) / F.lit(permutations + 1.0))
    text = F.when(p >= SIGNIFICANT, RANDOM).when(F.col("i") > 0, POSITIVE).when(p.isNotNull(), NEGATIVE)
    return summary.select(
        F.round("i", 4).alias("moran_i"),
        F.round(F.try_divide(F.lit(-1.0), F.lit(n - 1)), 4).alias("expected_i"),
        F.round(p, 4).alias("p_value"),
        F.round(F.try_divide(F.col("i") - F.col("mean"), F.col("std")), 4).alias("z_score"),
        text.alias("interpretation"),
        F.lit(n).cast("bigint").alias("n"),
    )


def _curve(box: dict) -> Column:
    """A place's number on a Z-shaped curve through the box, 31 bits each way."""

    def spread(v: str) -> Column:
        low, high = box[f"min{v}"] or 0.0, box[f"max{v}"] or 0.0
        bits = F.floor((F.col(v) / 2 - F.lit(low / 2)) / F.lit((high / 2 - low / 2) or 1.0) * (2**31 - 1)).cast("bigint")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        return bits

    return spread("x").bitwiseOR(F.shiftleft(spread("y"), 1))


def _neighbourhoods(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by parts of the plane (part, a, b, w), and the parts where each id is met (id, num, parts).

    Ids are numbered along a curve, which keeps neighbours close, and cut into parts of ``PART``
    ids, so a part is bounded however crowded the plane is. Edges lie in the part of their source.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    xy = rows.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite & F.col("id").isNotNull())
    box = xy.agg(*[f(v).alias(f"{n}{v}") for n, f in (("min", F.min), ("max", F.max)) for v in "xy"]).first()
    places = xy.groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y")
    ids = numbered(places.withColumn("z", _curve(box)), "z", "x", "y", "id", keep=["id"]).withColumnRenamed("idx", "num")
    ids = materialize(ids.withColumn("part", F.floor(F.col("num") / PART)), "curve")
    source = ids.select(F.col("id").alias("src"), F.col("num").alias("a"), "part")
    target = ids.select(F.col("id").alias("dst"), F.col("num").alias("b"))
    links = edges.join(shuffled(source), "src").join(shuffled(target), "dst").groupBy("part", "a", "b").agg(F.count(F.lit(1)).alias("w"))
    links = materialize(links, "links")
    met = links.select("part", F.col("a").alias("num")).unionByName(links.select("part", F.col("b").alias("num"))).groupBy("num").agg(F.collect_set("part").alias("parts"))
    return links, ids.select("id", "num").join(shuffled(met), "num").select("id", "num", "parts")


def _products(key: tuple, vectors: pa.Table, links: pa.Table) -> pa.Table:
    """The sums over a part's edges of the products of their ends' values, one a replicate."""
    num = vectors["num"].to_numpy()
    order = np.argsort(num)
    table = pc.list_flatten(vectors["zs"].combine_chunks()).to_numpy().reshape(len(num), -1)
    a, b = (order[np.searchsorted(num, links[c].to_numpy(), sorter=order)] for c in "ab")
    return pa.table({"chunk": pa.array([key[1].as_py()], pa.int32()), "v": [_over_edges(table, a, b, links["w"].to_numpy())]})


def _over_edges(table: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sums over edges of the products of two rows of a table."""
    total = np.zeros(table.shape[1])
    for i in range(0, len(w), PART):
        one = slice(i, i + PART)
        total += np.einsum("i,ij,ij->j", w[one].astype(float), table[a[one]], table[b[one]])
    return total


def _exchanged_sums(rows: DataFrame, links: DataFrame, homes: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """Sums of products (chunk, v) for more values than a task holds: they are sent to each other a chunk at a time.

    A chunk shuffles 1 KB a row twice, which is deleted before the next one begins.
    """
    nodes = materialize(dense_index(rows.join(shuffled(homes), "id", "left"), "id"), "nodes")
    sums = []
    for chunk in range(permutations // CHUNK + 1):
        vectors = relabelled_chunks(nodes, n, permutations, seed, [chunk])
        dealt = vectors.select("num", "chunk", F.explode("parts").alias("part"), "zs")
        asked = links.withColumn("chunk", F.lit(chunk))
        products = dealt.groupBy("part", "chunk").cogroup(asked.groupBy("part", "chunk")).applyInArrow(_products, "chunk int, v array<double>")
        sums.append(materialize(vector_sums(products, ["chunk"], v=F.col("v")), "sums"))
    return functools.reduce(DataFrame.unionByName, sums)


def _pack(key: tuple, homes: pa.Table, links: pa.Table) -> pa.Table:
    """A part as one row: places in the numbering by id of its ids' rows, rows an id, edges between its ids."""
    homes = homes.sort_by([("num", "ascending"), ("idx", "ascending")])
    num, counts = np.unique(homes["num"].to_numpy(), return_counts=True)
    a, b = (np.searchsorted(num, links[c].to_numpy()).astype(np.int32) for c in "ab")
    columns = {"idx": homes["idx"].to_numpy(), "counts": counts.astype(np.int32), "a": a, "b": b, "w": links["w"].to_numpy()}
    return pa.table({"part": [key[0].as_py()]} | {name: pa.array([v.tobytes()], pa.binary()) for name, v in columns.items()})


def _pack_values(key: tuple, block: pa.Table) -> pa.Table:
    return pa.table({"part": pa.array([-1 - key[0].as_py()], pa.int64()), "zs": pa.array([block.sort_by("idx")["z"].to_numpy().tobytes()], pa.binary())})


def _table(z: np.ndarray, idx: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of a part's ids under a chunk of maps, a row an id.

    Rows of one id share a vector: the first of all their values by replicate.
    """
    table, starts = np.empty((len(counts), len(a))), np.cumsum(counts) - counts
    for c in np.unique(counts):
        ids = np.flatnonzero(counts == c)
        maps = slice(-(-len(a) // c))
        at = idx[starts[ids][:, None] + np.arange(c)][:, None, :] * a[maps] + b[maps]
        # faster than the remainder
        at -= at // len(z) * len(z)
        table[ids] = np.sort(z[at], axis=2).reshape(len(ids), -1)[:, : len(a)]
    return table


def _summer(n: int, maps: list[tuple[int, int, int]]) -> Callable:
    """Sums the products of all edges dealt to a task, whose rows begin with the blocks of all values."""
    chunks = range(-(-len(maps) // CHUNK))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, totals = np.empty(n), [0.0] * len(chunks)
        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch[c][row].as_buffer(), kind)  # noqa: E731, B023
                block = -1 - batch["part"][row].as_py()
                if block >= 0:
                    z[block * BLOCK : (block + 1) * BLOCK] = read("zs", np.float64)
                    continue
                idx, counts = read("idx", np.int64), read("counts", np.int32)
                a, b, w = read("a", np.int32), read("b", np.int32), read("w", np.int64)
                for chunk in chunks:
                    totals[chunk] += _over_edges(_table(z, idx, counts, *_chunk_maps(maps, chunk)), a, b, w)
        found = {chunk: v for chunk, v in zip(chunks, totals) if np.ndim(v)}
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(found, pa.int32()), "v": pa.array(found.values(), pa.list_(pa.float64()))})

    return add


def _held_sums(rows: DataFrame, links: DataFrame, homes: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """Sums of products (chunk, v) by tasks that hold all values, and look them up under each map.

    The values are sent once a task, 8 bytes each, as many tasks as run at once; edges are sent once.
    """
    nodes = dense_index(rows, "id")
    placed = homes.join(shuffled(nodes.select("id", "idx")), "id").select("num", "idx", F.explode("parts").alias("part"))
    parts = placed.groupBy("part").cogroup(links.groupBy("part")).applyInArrow(_pack, "part bigint, idx binary, counts binary, a binary, b binary, w binary")
    blocks = nodes.select("idx", "z").groupBy(F.floor(F.col("idx") / BLOCK).alias("block")).applyInArrow(_pack_values, "part bigint, zs binary")
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART)))
    everywhere = blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    dealt = everywhere.unionByName(parts.withColumn("task", (F.col("part") % tasks).cast("int")), allowMissingColumns=True)
    ordered = dealt.repartitionById(tasks, "task").sortWithinPartitions("part").drop("task")
    products = ordered.mapInArrow(_summer(n, affine_maps(n, permutations, seed)), "chunk int, v array<double>")
    return vector_sums(products, ["chunk"], v=F.col("v"))


def _totals(rows: DataFrame, value: str) -> tuple[int, float, float]:
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var")).first()
    return t["n"], t["mean"] or 0.0, (t["var"] or 0.0) * t["n"]


def moran_significance(
    df: DataFrame, id: str, x: str, y: str, value: str, k: int = NEIGHBOURS, permutations: int = PERMUTATIONS, seed: int = SEED
) -> DataFrame:
    """:func:`moran_knn` with pseudo p-value, z-score and reading against random relabelling.

    Fewer than two rows, or values that are all equal, give NULL figures.
    """
    rows = df.where(col(x).isNotNull() & col(y).isNotNull() & col(value).isNotNull()).select(
        col(id).alias("id"), col(x).alias("x"), col(y).alias("y"), col(value).cast("double").alias("v")
    )
    n, mean, den = _totals(rows, "v")
    if n < 2:
        return _significance_row(df.sparkSession.createDataFrame([], "r int, i double"), n, permutations)
    k = max(1, min(k, n - 1))
    edges = materialize(knn_edges(rows, "id", "x", "y", k).select("src", "dst"), "edges")
    links, homes = _neighbourhoods(rows, edges)
    sums = (_held_sums if n <= HELD else _exchanged_sums)(rows.select("id", (F.col("v") - F.lit(mean)).alias("z")), links, homes, n, permutations, seed)
    i = F.try_divide(F.col("num"), F.lit(float(k)) * F.lit(den))
    return _significance_row(_by_replicate(sums, "v").select("r", i.alias("i")), n, permutations)


def moran_queen_significance(
    df: DataFrame, id: str, geometry: str, value: str, hot: int = HOT_VERTEX, permutations: int = PERMUTATIONS, seed: int = SEED
) -> DataFrame:
    """:func:`moran_queen` with pseudo p-value, z-score and reading against random relabelling.

    The index is a sum over pairs of shapes of the product of their value sums, for all relabellings
    at once as vectors; shapes that meet at crowded vertices are summed by sets of these, as there.
    """
    rows = df.where(col(geometry).isNotNull() & col(value).isNotNull()).select(
        col(id).alias("id"), col(geometry).alias("geometry"), col(value).cast("double").alias("v"), F.sha2(G.as_wkt(col(geometry)), 256).alias("g")
    )
    n, mean, den = _totals(rows, "v")
    if n < 2:
        return _significance_row(df.sparkSession.createDataFrame([], "r int, i double"), n, permutations)
    z = F.col("v") - F.lit(mean)
    groups = materialize(queen_groups(rows, "geometry", z), "shapes")
    few, sets = _corners(groups, hot)
    counts = groups.join(shuffled(queen_sums(groups, hot)), "g", "left").select("g", "m", (F.coalesce("cnt", F.lit(0)) + F.col("m") - 1).alias("around"))
    counts = materialize(counts.where("around > 0").join(shuffled(sets), "g", "left"), "around")
    s0 = counts.agg(F.sum("m")).first()[0] or 0
    vectors = shuffled(materialize(relabelled(rows.select("id", z.alias("z")), n, permutations, seed), "relabelled"))
    # value sums and sums of squares per shape; of few rows each, as equal shapes are one
    per_shape = vector_sums(rows.select("id", "g").join(vectors, "id").withColumn("qs", _times("zs", "zs")), ["g", "chunk"], s=F.col("zs"), q=F.col("qs"))
    shapes = shuffled(materialize(per_shape.join(shuffled(counts.select("g", "around", "hot")), "g"), "shape-vectors"))
    weighted = F.transform("s", lambda v: v / F.col("around"))
    one = shapes.select("g", "chunk", "s", weighted.alias("w"))
    other = one.select(F.col("g").alias("b"), "chunk", F.col("s").alias("t"))
    product = lambda df, a, b: vector_sums(df.select("chunk", _times(a, b).alias("v")), ["chunk"], v=F.col("v"))
    across = product(queen_pairs(few, sets).join(one, F.col("a") == F.col("g")).join(other, ["b", "chunk"]), "w", "t")
    # rows of a shape among themselves; with a crowded vertex the shape also meets itself among the sets
    square = F.when(F.col("hot").isNull(), _times("s", "s")).otherwise(F.transform("s", lambda v: v * 0.0))
    among = F.zip_with(square, "q", lambda a, b: (a - b) / F.col("around"))
    inside = vector_sums(shapes.select("chunk", among.alias("v")), ["chunk"], v=F.col("v"))
    small, linked = _crowded_links(sets)
    by_part = vector_sums(small.join(one, "g"), ["part", "sign", "chunk"], s=F.col("s"), w=F.col("w"))
    signed = by_part.select("chunk", F.transform(_times("s", "w"), lambda v: v * F.col("sign")).alias("v"))
    crowded = vector_sums(signed, ["chunk"], v=F.col("v"))
    by_set = vector_sums(sets.join(one, "g"), ["hot", "chunk"], s=F.col("s"), w=F.col("w"))
    ends = linked.join(shuffled(by_set.select(F.col("hot").alias("ha"), "chunk", "w")), "ha").join(shuffled(by_set.select(F.col("hot").alias("hb"), "chunk", "s")), ["hb", "chunk"])
    large = product(ends, "w", "s")
    num = _by_replicate(across.unionByName(inside).unionByName(crowded).unionByName(large), "v")
    i = F.try_divide(F.lit(float(n)) * F.col("num"), F.lit(float(s0)) * F.lit(den))
    return _significance_row(num.select("r", i.alias("i")), n, permutations)
