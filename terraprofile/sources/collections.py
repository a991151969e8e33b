"""Features of GeoJSON collections, however large a file is.

A file is read in parallel by blocks, as the texts between closing braces. What a block means
depends on whether it begins inside a string and how deep in brackets: both follow from a
prefix over the file's blocks, of which each counts its quotes, and its brackets once as if it
began outside a string and once inside. Knowing this, tasks cut out the objects of the array of
features; those that lie across blocks are put together afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraprofile.session import materialize
from terraprofile.sources.records import BROADCAST_BLOCKS, join_torn

BATCH_BYTES = 1 << 22
# depth inside the array of features: the root object and the array
ARRAY = 2
_FEATURES_KEY = b'"features"'


def _texts(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true")
    text = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _runs(batches):
    """Rows of one block within a batch: path, block and their bytes with the braces put back; further columns of the first row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, blocks = batch.column(0), batch.column(1)
        same = pc.and_(pc.equal(paths.slice(1), paths.slice(0, len(paths) - 1)), pc.equal(blocks.slice(1), blocks.slice(0, len(blocks) - 1)))
        turns = [0, *(k + 1 for k in pc.indices_nonzero(pc.invert(same)).to_pylist()), batch.num_rows]
        for start, end in zip(turns, turns[1:]):
            text = b"}".join([*batch.column(2).slice(start, end - start).to_pylist(), b""])
            yield (paths[start].as_py(), blocks[start].as_py()), text, [c[start].as_py() for c in batch.columns[3:]]


def _quotes(b: np.ndarray) -> np.ndarray:
    """Places of the quotes that are not escaped; a run never begins behind a backslash."""
    quotes = np.flatnonzero(b == 0x22)
    escaped = quotes[(quotes > 0) & (b[quotes - 1] == 0x5C)]
    if not len(escaped):
        return quotes
    odd = []
    for q in escaped.tolist():
        k = q - 1
        while k >= 0 and b[k] == 0x5C:
            k -= 1
        if (q - 1 - k) % 2:
            odd.append(q)
    return np.setdiff1d(quotes, odd, assume_unique=True)


def _brackets(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the brackets outside strings, +1 or -1 each, and whether the text ends inside a string."""
    b = np.frombuffer(text, np.uint8)
    quotes = _quotes(b)
    opens, closes = (b == 0x7B) | (b == 0x5B), (b == 0x7D) | (b == 0x5D)
    places = np.flatnonzero(opens | closes)
    outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
    places = places[outside]
    return places, np.where(opens[places], 1, -1), (len(quotes) + inside) % 2


def _summaries(batches):
    """Per run: path, block, its order in the block, parity of quotes, and depth gained beginning outside and inside a string."""
    rows, at, n = [], None, 0
    for key, text, _ in _runs(batches):
        at, n = key, (n + 1 if key == at else 0)
        _, gain0, parity = _brackets(text, 0)
        _, gain1, _ = _brackets(text, 1)
        rows.append((*key, n, parity, int(gain0.sum()), int(gain1.sum())))
    if rows:
        yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(("path", "block", "n", "parity", "d0", "d1"), zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))})


def block_states(texts: DataFrame) -> DataFrame:
    """Per block: path, block, whether it begins inside a string, and the depth of brackets there."""
    runs = texts.mapInArrow(_summaries, "path string, block long, n long, parity int, d0 long, d1 long")
    before = Window.partitionBy("path").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    quoted = runs.withColumn("inside", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"))
    deep = quoted.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0"))).over(before), F.lit(0)))
    return deep.where("n = 0").select("path", "block", "inside", "depth")


def _objects(batches):
    """Objects of arrays below the root (kind 0), or pieces of them, and where the root's values begin (kind 1, with features 2)."""
    names = ["path", "block", "n", "kind", "value", "before", "behind"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    key, inside, depth, offset, held, held_at, going = None, 0, 0, 0, b"", 0, False
    out, size = [], 0

    def made():
        nonlocal out, size
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        out, size = [], 0
        return batch

    def put(value, at, before, behind):
        nonlocal size
        out.append((*key, at, 0, value, before, behind))
        size += len(value)

    for own, text, (begins, level) in _runs(batches):
        if own != key:
            if key is not None and depth > ARRAY and (held or going):
                put(held, held_at, int(going), 1)
            # a block that begins deeper goes on with an object of the block before
            key, inside, depth, offset, held, held_at, going = own, begins, level, 0, b"", 0, level > ARRAY
        places, steps, ends_inside = _brackets(text, inside)
        depths = depth + np.cumsum(steps)
        start = 0 if depth > ARRAY else None
        for k in np.flatnonzero((depths == ARRAY) | ((depths == ARRAY + 1) & (steps == 1))).tolist():
            place, up = int(places[k]), steps[k] == 1
            if up and depths[k] == ARRAY:
                bare = text[:place].rstrip()
                named = bare.endswith(b":") and bare[:-1].rstrip().endswith(_FEATURES_KEY) and text[place] == 0x5B
                out.append((*key, offset + place, 2 if named else 1, None, 0, 0))
            elif up:
                start, held_at = place, offset + place
            elif start is not None:
                put(held + text[start : place + 1], held_at, int(going), 0)
                held, going, start = b"", False, None
        if start is not None:
            held += text[start:]
        offset += len(text)
        depth, inside = depth + int(steps.sum()), ends_inside
        if size >= BATCH_BYTES:
            yield made()
    if key is not None and depth > ARRAY and (held or going):
        put(held, held_at, int(going), 1)
    if out:
        yield made()


def feature_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The objects of the ``features`` array of every collection: path, value, broken.

    A file whose root has no such array has none. An object that the end of its file cuts off is
    ``broken``. The last brace of a file may be missing.
    """
    texts = _texts(spark, path, glob)
    states = materialize(block_states(texts), "collection-blocks")
    if states.count() <= BROADCAST_BLOCKS:
        # a broadcast join keeps a block's texts in order
        placed = texts.join(F.broadcast(states), ["path", "block"])
    else:
        numbered = texts.mapInArrow(_numbered, "path string, block long, value binary, n long")
        placed = numbered.join(states, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "n")
    rows = placed.select("path", "block", "value", "inside", "depth").mapInArrow(_objects, "path string, block long, n long, kind int, value string, before int, behind int")
    rows = materialize(rows, "collection-objects")
    # where the features' array begins, and where the root's next value does: one row a file
    place = F.struct("block", "n")
    order = Window.partitionBy("path").orderBy("block", "n")
    roots = rows.where("kind > 0").select("path", "kind", place.alias("start"), F.lead(place).over(order).alias("end")).where("kind = 2")
    spans = roots.groupBy("path").agg(F.min(F.struct("start", "end")).alias("s")).select("path", "s.start", "s.end")
    objects = rows.where("kind = 0")
    whole = objects.where("before = 0 AND behind = 0").select("path", "block", "n", "value", F.lit(False).alias("broken"))
    every = whole.unionByName(join_torn(objects, ""))
    inside = (place > F.col("start")) & (F.col("end").isNull() | (place < F.col("end")))
    return every.join(spans, "path").where(inside).select("path", "value", "broken")


def _numbered(batches):
    at, n = None, 0
    for batch in batches:
        numbers = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, n = key, (n + 1 if key == at else 0)
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=["path", "block", "value", "n"])
