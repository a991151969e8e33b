"""Benchmark decontamination by a prefix-filtered set join.

An item's passages are its windows of ``window`` consecutive words. A document holds
a window only if it holds all of its words (containment 1), so by the prefix
principle one word per window is enough to find it: words are ordered by rarity over
all documents, and the rarest word of a window is its necessary prefix. A document
position with that word is a candidate for the window at one aligned place, which must
lie inside the document (positional and length bound); then the words are compared.

The benchmark side is taken in blocks of at most ``BLOCK_WINDOWS`` windows, each
sent to the tasks after that count; every block meets all documents, so any
benchmark is covered in full. The documents never move.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.llm.textops import alnum_words

WINDOW = 13
BLOCK_WINDOWS = 200_000


def item_windows(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of an item; an item with fewer words is one window, without words none."""
    if not words:
        return []
    width = min(window, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> Iterator[dict[tuple[bytes, ...], set]]:
    """The benchmark's windows with their items, at most about ``limit`` at a time."""
    block: dict[tuple[bytes, ...], set] = defaultdict(set)
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator()
    for row in rows:
        if row.i is None:
            continue
        for w in item_windows(alnum_words(bytes(row.t) if row.t is not None else None), window):
            block[w].add(row.i)
            if len(block) >= limit:
                yield dict(block)
                block = defaultdict(set)
    if block:
        yield dict(block)


def _word_counts(docs: DataFrame, text_col: str, vocabulary) -> dict[bytes, int]:
    """In how many documents each word of the block's vocabulary occurs; counted in the tasks first."""

    def count(batches):
        own, known = defaultdict(int), vocabulary.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in known.intersection(alnum_words(text)):
                    own[w] += 1
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(own), pa.binary()), "n": pa.array(list(own.values()), pa.int64())})

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(count, "w binary, n long")
    return {bytes(r.w): r.n for r in rows.groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator()}


def _index(block: dict[tuple[bytes, ...], set], counts: dict[bytes, int]):
    """Rarest word -> places of it in windows, and window text -> items. Windows with an unseen word can't occur."""
    places, windows = defaultdict(set), {}
    for words, items in block.items():
        if any(w not in counts for w in words):
            continue
        at = min(range(len(words)), key=lambda i: (counts[words[i]], words[i], i))
        places[words[at]].add((at, len(words)))
        windows[b" ".join(words)] = sorted(items, key=str)
    return {w: sorted(p) for w, p in places.items()}, windows


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(words: list[bytes], places: dict, windows: dict) -> tuple[list[tuple[int, int]], set]:
    """Word spans [start, end) covered by windows, and the items they belong to."""
    spans, items, n = [], set(), len(words)
    for i, w in enumerate(words):
        if w in places:
            for at, width in places[w]:
                start = i - at
                if start >= 0 and start + width <= n:  # positional and length bound
                    found = windows.get(b" ".join(words[start : start + width]))
                    if found is not None:
                        spans.append((start, start + width))
                        items.update(found)
    return _merge(spans), items


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Per document row: id, n_words, spans (merged word ranges inside windows), items (sorted as text).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Null
    texts have no words; items without words or id match nothing; repeated rows give
    repeated results; other columns are not read. Empty tables give empty or unmatched results.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("_t", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("spans", span_type), T.StructField("items", T.ArrayType(item_type))]
    )
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("binary").alias("_t"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(span_type).alias("spans"),
        F.array().cast(T.ArrayType(item_type)).alias("items"),
    )

    def add_block(shared, last: bool):
        def run(batches):
            places, windows = shared.value
            for batch in batches:
                n_words, spans, items = [], [], []
                for text, old_spans, old_items in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    words = alnum_words(text)
                    hit, found = find_hits(words, places, windows)
                    n_words.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in _merge(hit + [(s["start"], s["end"]) for s in old_spans])])
                    items.append(sorted(found.union(old_items), key=str))
                new = {2: n_words, 3: spans, 4: items}
                keep = [0, 2, 3, 4] if last else [0, 1, 2, 3, 4]
                fields = [batch.schema.field(i) for i in keep]
                columns = [pa.array(new[i], f.type) if i in new else batch.column(i) for i, f in zip(keep, fields)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

        return run

    blocks = iter(_blocks(benchmark, item_col, item_text_col, window, block_windows))
    block = next(blocks, {})
    while block is not None:
        following = next(blocks, None)
        counts: dict[bytes, int] = {}
        if block:
            vocabulary = spark.sparkContext.broadcast(frozenset(w for words in block for w in words))
            counts = _word_counts(docs, text_col, vocabulary)
        last = following is None
        target = T.StructType([f for f in schema.fields if not (last and f.name == "_t")])
        out = out.mapInArrow(add_block(spark.sparkContext.broadcast(_index(block, counts)), last), target)
        block = following
    return out


def with_verdict(found: DataFrame) -> DataFrame:
    """n_hit, n_items and ``contaminated``: at least a twentieth of the words lies inside windows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, all columns kept."""
    bad = with_verdict(contamination(docs, benchmark, id_col, text_col)).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
