"""Areas through grid cells, overlap checks and coverage of a territory.

The cell size is a fixed fraction of the bounding box's diagonal, so the number
of different cells has a constant bound (about two million) whatever the number
of rows. Shapes become runs of cells per grid line, which are merged before any
cell is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraprofile.functions import geometry as G
from terraprofile.operators.clean import col
from terraprofile.operators.hull import ring_edges
from terraprofile.session import materialize, shuffled

BUFFER_SHARE = 0.001
CELLS_PER_BUFFER = 2


def geometry_box(df: DataFrame, geometry: str) -> DataFrame:
    """One row: the bounding box of a geometry column."""
    return df.select(G.bbox(col(geometry)).alias("b")).agg(
        F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy")
    )


def frame(box: DataFrame) -> Column:
    """Scalar struct: box, diagonal, buffer and cell size."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    diagonal = F.sqrt(w * w + h * h)
    return box.select(
        F.struct(
            "minx", "miny", "maxx", "maxy",
            (w * h).alias("area"),
            F.least(w, h).alias("side"),
            (diagonal * BUFFER_SHARE).alias("buffer"),
            (diagonal * BUFFER_SHARE / CELLS_PER_BUFFER).alias("cell"),
        ).alias("f")
    ).scalar()


def segments(df: DataFrame, geometry: str) -> DataFrame:
    """Straight pieces of lines as flat columns."""
    pieces = F.flatten(F.transform(F.flatten(col(geometry)["parts"]), G.steps))
    return df.select(F.explode(pieces).alias("s")).select(
        F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")
    )


def merged_spans(spans: DataFrame, line: str) -> DataFrame:
    """Disjoint intervals ``(line, lo, hi)`` with the same cells as all ``spans``.

    First the farthest end per line and start is taken, which is at most one row
    per grid cell and mostly map-side; then each interval is cut where the ones
    before it already reach.
    """
    longest = spans.groupBy(line, "lo").agg(F.max("hi").alias("hi")).where("lo <= hi")
    w = Window.partitionBy(line).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("hi").over(w)
    return longest.select(line, F.greatest(F.col("lo"), F.coalesce(reached + 1, F.col("lo"))).alias("lo"), "hi").where("lo <= hi")


def span_cells(spans: DataFrame, line: str, across: str) -> DataFrame:
    return spans.select(line, F.explode(F.sequence("lo", "hi")).alias(across)).select("ix", "iy")


def span_count(spans: DataFrame) -> DataFrame:
    return spans.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).alias("n_cells"))


def buffered_spans(segs: DataFrame, f: Column) -> DataFrame:
    """Cells whose centre lies within the buffer of some segment, as ``(ix, lo, hi)``.

    For each column of cells the buffered segment is one vertical interval,
    known in closed form.
    """
    ordered = F.col("x1") <= F.col("x2")
    s = segs.dropna(subset=["x1", "y1", "x2", "y2"]).select(
        F.least("x1", "x2").alias("x1"), F.when(ordered, F.col("y1")).otherwise(F.col("y2")).alias("y1"),
        F.greatest("x1", "x2").alias("x2"), F.when(ordered, F.col("y2")).otherwise(F.col("y1")).alias("y2"), f.alias("f"),
    )
    # lengths in cells from here on, with the box's corner as origin
    c = F.col("f.cell")
    scaled = lambda v, o: ((F.col(v) - F.col(o)) / c).alias(v)
    s = s.where(c > 0).select(scaled("x1", "f.minx"), scaled("y1", "f.miny"), scaled("x2", "f.minx"), scaled("y2", "f.miny"), (F.col("f.buffer") / c).alias("b"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = s.select("*", dx.alias("dx"), dy.alias("dy"), F.try_divide(F.col("b"), F.sqrt(dx * dx + dy * dy)).alias("k"))
    first, last = F.ceil(F.col("x1") - F.col("b") - 0.5), F.floor(F.col("x2") + F.col("b") - 0.5)
    columns = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    cols = s.select(
        "x1", "y1", "x2", "y2", "dx", (F.col("b") * F.col("b")).alias("bb"), F.try_divide(F.col("dy"), F.col("dx")).alias("slope"),
        (F.col("dy") * F.col("k")).alias("ox"), (F.col("dx") * F.col("k")).alias("oy"), F.explode(columns).alias("ix"),
    )
    xc = F.col("ix") + 0.5
    cols = cols.select("ix", "y1", "y2", "dx", "bb", "slope", "ox", "oy", (xc - F.col("x1")).alias("h1"), (xc - F.col("x2")).alias("h2"))

    def cap(h: str, y: str, sign: int) -> Column:
        # null, as the root of a negative number is NaN, where the line misses the disc
        return F.nanvl(F.col(y) + F.sqrt(F.col("bb") - F.col(h) * F.col(h)) * sign, F.lit(None).cast("double"))

    def side(sign: int) -> Column:
        # the edge parallel to the segment, shifted by the buffer
        h = F.col("h1") + F.col("ox") * sign
        return F.when((h >= 0) & (h <= F.col("dx")), F.col("y1") + F.col("oy") * sign + h * F.col("slope"))

    top = F.greatest(cap("h1", "y1", 1), cap("h2", "y2", 1), side(1))
    low = F.least(cap("h1", "y1", -1), cap("h2", "y2", -1), side(-1))
    spans = cols.select("ix", F.ceil(low - 0.5).alias("lo"), F.floor(top - 0.5).alias("hi"))
    return merged_spans(spans, "ix")


def polygon_spans(df: DataFrame, geometry: str, f: Column, clip: bool = False) -> DataFrame:
    """Cells whose centre lies in some polygon, as ``(iy, lo, hi)``, by scan lines.

    Edges become rows per line that crosses them, so no shape is copied or gathered whole.
    ``clip`` leaves out cells beyond the frame's box and its buffer.
    """
    solid = df.where(col(geometry)["kind"].isin("POLYGON", "MULTIPOLYGON"))
    numbered = solid.select(F.monotonically_increasing_id().alias("shape"), F.flatten(F.transform(F.flatten(col(geometry)["parts"]), G.steps)).alias("edges"))
    e = numbered.select("shape", F.explode("edges").alias("e"), f.alias("f")).select(
        "shape", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"), "f"
    )
    c, x0, y0 = F.col("f.cell"), F.col("f.minx"), F.col("f.miny")
    # lines next to the edge's ends are decided by the exact test below
    first, last = F.ceil((F.least("ay", "by") - y0) / c - 0.5) - 1, F.floor((F.greatest("ay", "by") - y0) / c - 0.5) + 1
    if clip:
        # a buffer is two cells wide
        first = F.greatest(first, F.lit(-CELLS_PER_BUFFER - 1))
        last = F.least(last, F.ceil((F.col("f.maxy") - y0) / c) + CELLS_PER_BUFFER)
    width = F.ceil((F.col("f.maxx") - x0) / c) + CELLS_PER_BUFFER
    lines = e.where((c > 0) & (F.col("ay") != F.col("by")) & (first <= last)).select(
        "shape", "ax", "ay", "bx", "by", width.alias("width"), c.alias("c"), x0.alias("x0"), y0.alias("y0"), F.explode(F.sequence(first, last)).alias("iy")
    )
    yc = F.col("y0") + (F.col("iy") + 0.5) * F.col("c")
    crossed = lines.where((F.col("ay") <= yc) != (F.col("by") <= yc)).select(
        "shape", "iy", "width", "c", "x0", (F.col("ax") + (yc - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("x")
    )
    # a line enters a shape at its odd crossings and leaves it at the next
    w = Window.partitionBy("shape", "iy").orderBy("x")
    spans = crossed.select("*", F.row_number().over(w).alias("k"), F.lead("x").over(w).alias("out")).where("k % 2 = 1 AND out IS NOT NULL")
    lo = F.ceil((F.col("x") - F.col("x0")) / F.col("c") - 0.5)
    hi = F.ceil((F.col("out") - F.col("x0")) / F.col("c") - 0.5) - 1
    if clip:
        lo, hi = F.greatest(lo, F.lit(-CELLS_PER_BUFFER - 1)), F.least(hi, F.col("width"))
    return merged_spans(spans.select("iy", lo.alias("lo"), hi.alias("hi")), "iy")


def buffered_cells(segs: DataFrame, f: Column) -> DataFrame:
    return span_cells(buffered_spans(segs, f), "ix", "iy")


def polygon_cells(df: DataFrame, geometry: str, f: Column) -> DataFrame:
    return span_cells(polygon_spans(df, geometry, f), "iy", "ix")


def fill_rate_lines(segs: DataFrame) -> DataFrame:
    """Area within the buffer of any line over the bounding box's area, in percent."""
    box = segs.agg(
        F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"),
    )
    f = frame(box)
    covered = span_count(buffered_spans(segs, f))
    return covered.select(
        "n_cells",
        F.when(f["side"] < 1e-6, F.lit(100.0)).otherwise(F.round(F.col("n_cells") * f["cell"] * f["cell"] / f["area"] * 100, 4)).alias("fill_rate"),
    )


def boxes(df: DataFrame, geometry: str) -> DataFrame:
    shapes = df.select(G.computed(col(geometry)).alias("g"))
    return shapes.where(G.present(F.col("g"))).select(G.bbox(F.col("g")).alias("b")).select("b.*")


MAX_BOXES_PER_CELL = 64
BITS_AT_ONCE = 12
FINEST = 52  # halvings that a double's digits can tell
CELL = ["lx", "ly", "ix", "iy"]


def _cell_side(size: str, level: str) -> Column:
    return F.col(f"f.{size}") / F.pow(F.lit(2.0), F.col(level))


def _clip_to_cells(rows: DataFrame) -> DataFrame:
    """Clip the boxes ``p`` to their cells of the grid ``f``; what has no area there is left out."""
    sx, sy = _cell_side("sx", "lx"), _cell_side("sy", "ly")
    left, low = F.col("f.x0") + F.col("ix") * sx, F.col("f.y0") + F.col("iy") * sy
    inner = F.struct(
        F.greatest("p.minx", left).alias("minx"), F.greatest("p.miny", low).alias("miny"),
        F.least("p.maxx", left + sx).alias("maxx"), F.least("p.maxy", low + sy).alias("maxy"),
    )
    return rows.select(*CELL, "box", inner.alias("p"), "f").where((F.col("p.maxx") > F.col("p.minx")) & (F.col("p.maxy") > F.col("p.miny")))


def _split(pieces: DataFrame) -> DataFrame:
    """Deal the pieces to the cells below theirs that they meet, ``bx`` and ``by`` levels down."""
    down = pieces.withColumns({"lx": F.col("lx") + F.col("bx"), "ly": F.col("ly") + F.col("by")})

    def below(low: str, high: str, origin: str, side: Column, cell: str, bits: str) -> Column:
        cells = F.pow(F.lit(2.0), F.col(bits)).cast("bigint")
        first, last = F.col(cell) * cells, (F.col(cell) + 1) * cells - 1
        at = lambda v: F.floor((F.col(f"p.{v}") - F.col(f"f.{origin}")) / side)
        # a step further each way, as the clipping decides exactly
        return F.sequence(F.least(last, F.greatest(first, at(low) - 1)), F.least(last, F.greatest(at(high) + 1, first)))

    xs, ys = below("minx", "maxx", "x0", _cell_side("sx", "lx"), "ix", "bx"), below("miny", "maxy", "y0", _cell_side("sy", "ly"), "iy", "by")
    rows = down.select("lx", "ly", "iy", "by", "box", "p", "f", F.explode(xs).alias("ix"))
    return _clip_to_cells(rows.select("lx", "ly", "ix", "box", "p", "f", F.explode(ys).alias("iy")))


def _bits(n: Column, width: Column, height: Column) -> list[Column]:
    """How many times to halve a cell each way so that pieces of a mean size, in shares of the cell's, are few in each."""
    need = F.least(F.lit(BITS_AT_ONCE), F.greatest(F.lit(1), F.ceil(F.log2(n * 2 / MAX_BOXES_PER_CELL))))
    room = lambda share: F.greatest(F.lit(0.0), -F.log2(share))
    rx, ry = room(width), room(height)
    share = F.when(rx + ry > 0, rx / (rx + ry)).otherwise(0.5)
    x = F.round(need * share).cast("int")
    return [x.alias("bx"), F.greatest(need.cast("int") - x, F.lit(0)).alias("by")]


def reference_overlap_check(df: DataFrame, geometry: str) -> DataFrame:
    """Whether any two bounding boxes of the layer share area.

    Equal boxes are grouped first. The layer's box is halved where it is crowded, each way as
    often as the boxes there are small, and boxes are clipped to the cells; a large box has a piece
    per cell it meets, which is no more than there are crowds. Where the clipped areas of a cell add
    up to more than the cell, two must overlap, and no pair is formed. Only in cells with few pieces
    are boxes compared, so a crowd of boxes never meets all at once.
    """
    spark = df.sparkSession
    distinct = materialize(boxes(df, geometry).groupBy("minx", "miny", "maxx", "maxy").agg(F.count(F.lit(1)).alias("copies")), "boxes")
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    solid = distinct.where((w > 0) & (h > 0))
    grid = solid.agg(
        F.min("minx").alias("x0"), F.min("miny").alias("y0"), (F.max("maxx") - F.min("minx")).alias("sx"), (F.max("maxy") - F.min("miny")).alias("sy"),
        F.max("copies").alias("copies"), F.sum(w * h).alias("area"), F.count(F.lit(1)).alias("n"), F.avg(w).alias("w"), F.avg(h).alias("h"),
    ).first()
    answer = lambda value: spark.range(1).select(F.lit(value).alias("overlaps"))
    if grid["n"] == 0 or grid["copies"] > 1 or grid["area"] > grid["sx"] * grid["sy"] * (1 + 1e-9):
        return answer(grid["n"] > 0)
    f = F.struct(*[F.lit(grid[k]).alias(k) for k in ("x0", "y0", "sx", "sy")])
    root = [F.lit(0).alias("lx"), F.lit(0).alias("ly"), F.lit(0).cast("bigint").alias("ix"), F.lit(0).cast("bigint").alias("iy")]
    box = F.struct("minx", "miny", "maxx", "maxy")
    pieces = solid.select(*root, box.alias("box"), box.alias("p"), f.alias("f"))
    if grid["n"] > MAX_BOXES_PER_CELL:
        pieces = _split(pieces.select("*", *_bits(F.lit(grid["n"]), F.lit(grid["w"] / grid["sx"]), F.lit(grid["h"] / grid["sy"]))))
    pieces = materialize(pieces, "pieces")
    pw, ph = F.col("p.maxx") - F.col("p.minx"), F.col("p.maxy") - F.col("p.miny")
    sx, sy = _cell_side("sx", "lx"), _cell_side("sy", "ly")
    while True:
        counts = materialize(
            pieces.groupBy(*CELL).agg(
                F.count(F.lit(1)).alias("n"), (F.sum(pw / sx * (ph / sy)) > 1 + 1e-9).alias("crowded"), F.avg(pw / sx).alias("w"), F.avg(ph / sy).alias("h")
            ), "cell-counts",
        )
        if not counts.where("crowded").isEmpty():
            return answer(True)
        # cells that numbers can't tell apart are not halved any more
        wide = counts.where((F.col("n") > MAX_BOXES_PER_CELL) & (F.col("lx") + BITS_AT_ONCE < FINEST) & (F.col("ly") + BITS_AT_ONCE < FINEST))
        if wide.isEmpty():
            break
        chosen = wide.select(*CELL, *_bits(F.col("n"), F.col("w"), F.col("h")))
        deeper = _split(pieces.join(shuffled(chosen), CELL))
        pieces = materialize(pieces.join(shuffled(chosen), CELL, "left_anti").unionByName(deeper), "pieces")
    a = pieces.select(*CELL, F.col("p").alias("a"), F.col("box").alias("abox"))
    b = pieces.select(*CELL, F.col("p").alias("b"), F.col("box").alias("bbox"))
    share = (
        (F.col("a.minx") < F.col("b.maxx")) & (F.col("b.minx") < F.col("a.maxx"))
        & (F.col("a.miny") < F.col("b.maxy")) & (F.col("b.miny") < F.col("a.maxy"))
    )
    hit = a.join(shuffled(b), CELL).where((F.col("abox") < F.col("bbox")) & share).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("overlaps"))


def union_area(df: DataFrame, geometry: str, overlaps: bool) -> DataFrame:
    """Area of the union: the sum if nothing overlaps, else covered cells."""
    if not overlaps:
        return df.agg(F.coalesce(F.sum(G.area(col(geometry))), F.lit(0.0)).alias("area"))
    f = frame(geometry_box(df, geometry))
    n = span_count(polygon_spans(df, geometry, f))
    return n.select((F.col("n_cells") * f["cell"] * f["cell"]).alias("area"))


def fill_rate_polygons(df: DataFrame, geometry: str, overlaps: bool | None = None) -> DataFrame:
    """Union of polygons over the bounding box's area, in percent."""
    if overlaps is None:
        overlaps = bool(reference_overlap_check(df, geometry).first()["overlaps"])
    f = frame(geometry_box(df, geometry))
    return union_area(df, geometry, overlaps).select(
        F.when(f["side"] < 1e-6, F.lit(100.0)).otherwise(F.round(F.col("area") / f["area"] * 100, 4)).alias("fill_rate")
    )


def coverage_of(reference: DataFrame, geometry: str, edges: Column, shape: DataFrame, overlaps: bool | None = None) -> DataFrame:
    """Share of a territory inside a convex shape, in percent.

    ``edges`` is a scalar, so the territory is read in place and never broadcast.
    ``shape`` holds the same polygon as its one geometry ``s``. Where polygons of
    the territory overlap (looked up if ``overlaps`` is not given), areas can't be
    added up, and cells that any of them covers are counted instead.
    """
    if overlaps is None:
        overlaps = bool(reference_overlap_check(reference, geometry).first()["overlaps"])
    if overlaps:
        f = frame(geometry_box(reference, geometry))
        inside = polygon_spans(shape, "s", f, clip=True).select("iy", F.col("lo").alias("from"), F.col("hi").alias("to"))
        territory = polygon_spans(reference, geometry, f)
        # a convex shape has one interval per line
        shared = F.greatest(F.lit(0), F.least("hi", "to") - F.greatest("lo", "from") + 1)
        sums = territory.join(inside, "iy", "left").agg(
            F.coalesce(F.sum(shared), F.lit(0)).alias("c"), F.sum(F.col("hi") - F.col("lo") + 1).alias("a")
        )
    else:
        rows = reference.select(G.computed(col(geometry)).alias("g")).where("g IS NOT NULL").select("g", edges.alias("edges"))
        sums = rows.select(G.area(F.col("g")).alias("a"), G.clipped_area(F.col("g"), F.col("edges")).alias("c")).agg(
            F.sum("c").alias("c"), F.sum("a").alias("a")
        )
    return sums.select(F.round(F.coalesce(F.try_divide("c", "a") * 100, F.lit(0.0)), 4).alias("coverage_pct"))


def coverage_envelope(reference: DataFrame, geometry: str, box: DataFrame, overlaps: bool | None = None) -> DataFrame:
    """Coverage by the envelope of the data; ``box`` has one row."""
    a, b, c, d = (F.col(n) for n in ("minx", "miny", "maxx", "maxy"))
    edges = box.select(G.rectangle_edges(a, b, c, d).alias("e")).scalar()
    corners = F.array(G.xy(a, b), G.xy(c, b), G.xy(c, d), G.xy(a, d), G.xy(a, b))
    return coverage_of(reference, geometry, edges, box.select(G.polygon(corners).alias("s")), overlaps)


def coverage_hull(reference: DataFrame, geometry: str, hull: DataFrame, overlaps: bool | None = None) -> DataFrame:
    """Coverage by the data's convex hull."""
    ring = F.col("ring")
    closed = F.concat(ring, F.slice(ring, 1, 1))
    edges = hull.select(ring_edges(ring).alias("e")).scalar()
    return coverage_of(reference, geometry, edges, hull.select(G.polygon(closed).alias("s")), overlaps)


def coverage_cells(reference: DataFrame, geometry: str, covered: DataFrame, f: Column, overlaps: bool | None = None) -> DataFrame:
    """Coverage by the cells ``covered`` of the frame ``f``, for lines and polygons.

    The territory is cut to the frame before its cells are listed, so their number
    is bounded by the frame's however much larger the territory is; its whole area
    comes from its polygons.
    """
    if overlaps is None:
        overlaps = bool(reference_overlap_check(reference, geometry).first()["overlaps"])
    territory = polygon_spans(reference, geometry, f, clip=True)
    hit = span_cells(territory, "iy", "ix").join(shuffled(covered), ["ix", "iy"], "left_semi").agg((F.count(F.lit(1)) * F.max(f["cell"] * f["cell"])).alias("hit"))
    total = union_area(reference, geometry, overlaps).scalar()
    return hit.select(
        F.round(F.coalesce(F.try_divide(F.col("hit"), total) * 100, F.lit(0.0)), 4).alias("coverage_pct")
    )
