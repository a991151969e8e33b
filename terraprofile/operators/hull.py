"""Convex hulls of any number of points.

Each task folds its rows into a hull batch by batch: points inside the polygon
spanned by the extreme points of sixteen directions are dropped at once, the
few others go through a monotone chain. The tasks' hulls are merged per hash
group and then once more, so the last merge sees hull vertices only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraprofile.functions import geometry as G

DIRECTIONS = 16


def _monotone_chain(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull vertices of an (n, 2) array, collinear points left out."""
    pts = np.unique(points, axis=0)
    if len(pts) <= 2:
        return pts

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) >= 2 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0
            ):
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


_ANGLES = 2 * np.pi * np.arange(DIRECTIONS) / DIRECTIONS


def _outer_points(pts: np.ndarray) -> np.ndarray:
    """Points not strictly inside the polygon of the extreme points by direction."""
    top = pts[np.argmax(pts @ np.vstack([np.cos(_ANGLES), np.sin(_ANGLES)]), axis=0)]
    top = top[np.r_[True, (np.diff(top, axis=0) != 0).any(axis=1)]]
    if len(np.unique(top, axis=0)) < 3:
        return pts
    inside = np.ones(len(pts), dtype=bool)
    for (ax, ay), (bx, by) in zip(top, np.roll(top, -1, axis=0)):
        if ax != bx or ay != by:
            inside &= (bx - ax) * (pts[:, 1] - ay) - (by - ay) * (pts[:, 0] - ax) > 0
    return pts[~inside]


def _partial_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hull of all rows of a task, folded batch by batch."""
    hull = np.empty((0, 2))
    for batch in batches:
        pts = batch[["x", "y"]].to_numpy(dtype=float)
        pts = np.vstack([hull, pts[np.isfinite(pts).all(axis=1)]])
        if len(pts):
            hull = _monotone_chain(_outer_points(pts))
    yield pd.DataFrame(hull, columns=["x", "y"])


def hull_vertices(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Hull vertices ``(x, y)`` of all located rows."""
    ddl = "x double, y double"
    pts = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    per_task = pts.mapInPandas(_partial_hulls, ddl)
    per_group = per_task.repartition("x", "y").mapInPandas(_partial_hulls, ddl)
    return per_group.repartition(1).mapInPandas(_partial_hulls, ddl)


def hull_ring(vertices: DataFrame) -> DataFrame:
    """One row with the hull as a counter-clockwise vertex list and its area.

    Vertices are ordered by angle about their mean, which lies inside.
    """
    mid = vertices.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.collect_list(G.xy(F.col("x"), F.col("y"))).alias("pts"))
    angled = F.sort_array(
        F.transform("pts", lambda p: F.struct(F.atan2(p["y"] - F.col("my"), p["x"] - F.col("mx")).alias("t"), p.alias("p")))
    )
    return mid.select(F.transform(angled, lambda r: r["p"]).alias("ring")).select(
        "ring", F.size("ring").cast("bigint").alias("n_vertices"), G.open_area(F.col("ring")).alias("area")
    )


def convex_hull(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return hull_ring(hull_vertices(df, x, y))


def ring_edges(ring: Column) -> Column:
    """Directed edges of an open vertex list, for clipping."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def vertex_rows(df: DataFrame, geometry: Column) -> DataFrame:
    """All coordinates of a geometry column as rows."""
    return df.select(F.explode(G.vertices(geometry)).alias("p")).select("p.x", "p.y")
