"""Self-join on the Jaccard similarity of word shingles, with several global token orders.

Two sets of similarity t or more share a token within their first n - ceil(t n) + 1 tokens
under any global order. Three orders are used, all rare tokens first, with ties broken by
different hashes: a pair is a candidate only if it shares a prefix token under each.
Tokens' frequencies are exact over all documents for the tokens below a hash bound,
the only ones counted; the others come last in every order. The bound is the same for all
documents, so each order is global and no pair is lost.

Equal sets are one node. Groups of near copies are not paired one by one: within each
prefix token's bucket all are compared with its most typical member first, links join
them to components, and then only members of different components still meet, in blocks
of bounded size. What is left out are pairs inside one component, whose outcome
can't change a component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terraprofile.llm.graph import components
from terraprofile.llm.textops import plain_words, shingle_set, slices
from terraprofile.session import materialize, passing

SMALL_BUCKET = 64
TILE_BYTES = 4_000_000
BROADCAST_IDS = 1_000_000
LAST = 1 << 40  # the frequency that stands for "not counted"


def counted_share(percent: int) -> float:
    """Share of the hash range whose tokens are counted: a quarter more than a prefix has, and some."""
    return min(1.25 * (1 - percent / 100) + 0.04, 0.49)


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Per row: doc, n, the set's digest, how many tokens are counted, and the tokens a prefix can need."""
    bound = np.uint64(int(counted_share(percent) * 2**64))

    def run(batches):
        for batch in slices(batches):
            sizes, digests, counted, tokens = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(plain_words(text.as_py()), k)
                n = len(found)
                s = int(np.searchsorted(found, bound))
                prefix = n - (percent * n + 99) // 100 + 1 if n else 0
                sizes.append(n)
                counted.append(s)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                tokens.append(found[: max(s, prefix)].view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
            values = pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(counted, pa.int32()), pa.ListArray.from_arrays(offsets, values)],
                names=["doc", "n", "digest", "counted", "tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc long, n int, digest binary, counted int, tokens array<long>")


def _prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """Prefix tokens that can be shared: doc, n, alone (counted tokens no other set has), token, and its orders."""
    bound = int(counted_share(percent) * 2**64)
    rows = nodes.select("doc", F.explode("tokens").alias("token"))
    low = (F.col("token") >= 0) & (F.col("token") < bound)
    shared = rows.where(low).select("token").groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = rows.where(low).join(shared, "token").unionByName(rows.where(~low).withColumn("df", F.lit(LAST)))
    known = known.join(nodes.select("doc", "n", "counted"), "doc")
    per_doc = Window.partitionBy("doc")
    alone = F.col("counted") - F.sum((F.col("df") < LAST).cast("int")).over(per_doc)
    level = F.floor(F.log2("df"))
    # uncounted tokens keep the order of their hash (as unsigned), which decided how many were kept
    by_hash = F.when(low, F.lit(0)).otherwise(F.col("token").bitwiseXOR(F.lit(-(1 << 63))))
    orders = [
        [F.col("df"), by_hash, F.col("token")],
        [level, by_hash, F.xxhash64(F.lit(2), "token"), F.col("token")],
        [level, by_hash, F.xxhash64(F.lit(3), "token"), F.col("token")],
    ]
    ranked = known.withColumn("alone", alone)
    for i, order in enumerate(orders, 1):
        ranked = ranked.withColumn(f"r{i}", F.row_number().over(per_doc.orderBy(*order)))
    room = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1 - F.col("alone")
    marked = ranked.select("doc", "n", "alone", "token", *((F.col(f"r{i}") <= room).alias(f"o{i}") for i in (1, 2, 3)))
    return marked.where("o1 or o2 or o3")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _linked(n_a: int, n_b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n_a + n_b - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_linked(len(p), len(q), _overlap(p, q), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _possible(n_a, alone_a, n_b, alone_b, percent: int):
    """Whether two sets of these sizes, so many of whose tokens no other set has, can be similar."""
    both = F.least(F.col(n_a) - F.col(alone_a), F.col(n_b) - F.col(alone_b))
    return 100 * both >= percent * (F.col(n_a) + F.col(n_b) - both)


def _share_orders(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """Pairs that also share a prefix token under each of the other orders."""
    first = orders.select(F.col("doc").alias("a"), "p2", "p3")
    second = orders.select(F.col("doc").alias("b"), F.col("p2").alias("q2"), F.col("p3").alias("q3"))
    return pairs.join(first, "a").join(second, "b").where(F.arrays_overlap("p2", "q2") & F.arrays_overlap("p3", "q3")).select("a", "b")


def _across_small(posts: DataFrame, sets: DataFrame, orders: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components that share a bucket of at most ``SMALL_BUCKET``."""
    one = posts.where(F.col("m") <= SMALL_BUCKET).select("token", "doc", "n", "alone", "component")
    other = one.select("token", *(F.col(c).alias(f"{c}_b") for c in ("doc", "n", "alone", "component")))
    met = one.join(other, "token").where((F.col("doc") < F.col("doc_b")) & (F.col("component") != F.col("component_b")) & _possible("n", "alone", "n_b", "alone_b", percent))
    pairs = met.select(F.col("doc").alias("a"), F.col("doc_b").alias("b")).distinct()
    return _verify(_share_orders(pairs, orders), sets, percent)


def _across_large(posts: DataFrame, sets: DataFrame, orders: DataFrame, percent: int) -> DataFrame:
    """The same for larger buckets, without a row per pair.

    A bucket is cut into tiles of bounded size by hash, and each pair of tiles is one group of rows.
    """
    posts = posts.where(F.col("m") > SMALL_BUCKET).select("token", "doc", "component")
    sized = posts.join(sets.select("doc", F.octet_length("tokens").alias("bytes")), "doc")
    buckets = sized.groupBy("token").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("doc")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "doc")).alias("h2"),
    ).where("c1 <> c2")
    # tokens with the same documents are one bucket
    once = buckets.groupBy("m", "h1", "h2").agg(F.min("token").alias("token"), F.first("bytes").alias("bytes"))
    tiles = F.ceil(F.col("bytes") / TILE_BYTES).cast("int")
    rows = posts.join(once.select("token", tiles.alias("tiles")), "token")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(F.lit(5), "doc"), F.col("tiles")).cast("int"))
    rows = rows.select("token", "doc", "component", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "doc", "component")
    full = rows.join(sets, "doc").join(orders, "doc").select("token", "i", "j", "tile", "doc", "component", "tokens", "p2", "p3")

    def compare(group: pa.Table) -> pa.Table:
        docs, comps, tiles = (group.column(c).to_pylist() for c in ("doc", "component", "tile"))
        same_tile = group.column("i")[0] == group.column("j")[0]
        sets = [np.frombuffer(b, np.uint64) for b in group.column("tokens").to_pylist()]
        p2, p3 = ([frozenset(p) for p in group.column(c).to_pylist()] for c in ("p2", "p3"))
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        # links within one local component change nothing, so a group gives fewer links than it has rows
        _, comps = np.unique(np.array(comps), return_inverse=True)
        tiles = np.array(tiles)
        mark, a, b = np.zeros(int(ids.max()) + 1, bool), [], []
        for x in range(len(docs)):
            able = (comps != comps[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
            able[: x + 1] = False
            if not same_tile:
                able &= tiles != tiles[x]
            able = [y for y in np.flatnonzero(able) if not p2[x].isdisjoint(p2[y]) and not p3[x].isdisjoint(p3[y])]
            if not able:
                continue
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            both = np.add.reduceat(mark[ids], starts)
            mark[own] = False
            for y in able:
                if comps[x] != comps[y] and _linked(int(sizes[x]), int(sizes[y]), int(both[y]), percent):
                    a.append(docs[x])
                    b.append(docs[y])
                    comps[comps == comps[y]] = comps[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id it reaches by links.

    Words are what lies between ASCII white space, A-Z lower-cased. A set has the distinct ``k``-word
    shingles, or the whole sequence if there are fewer words. Sets link at a Jaccard similarity of
    ``percent`` hundredths or more. Null or empty texts link with nothing and are their own component.
    Rows that repeat an id are one node, linked if any of them is. A null id gets the component of its
    set, if another row has that. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # the tokens are needed for the prefixes only, and would take more disk than what comes after
    with passing(_sets(docs, id_col, text_col, k, percent), "shingle-samples") as samples:
        rows = materialize(samples.select("doc", "n", "digest"), "set-sizes")
        # one node per distinct set; counted in the tasks first, so copies of one text are no burden
        nodes = rows.where("n > 0").groupBy("digest").agg(F.min("doc").alias("node"))
        nodes = materialize(nodes.where("node is not null"), "set-nodes")
        firsts = samples.join(nodes.select(F.col("node").alias("doc"), "digest"), ["doc", "digest"]).dropDuplicates(["doc", "digest"])
        prefixes = materialize(_prefixes(firsts.select("doc", "n", "counted", "tokens"), percent), "prefixes")

    useful = prefixes.where("o1").groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("alone", "doc", "n")).alias("typical")).where("m > 1")
    posts = prefixes.where("o1").join(useful, "token")
    posts = materialize(posts.select("token", "doc", "n", "alone", "m", F.col("typical.doc").alias("typical"), F.col("typical.n").alias("typical_n"), F.col("typical.alone").alias("typical_alone")), "buckets")
    candidates = posts.select("doc").distinct()
    orders = prefixes.join(candidates, "doc", "left_semi").groupBy("doc").agg(
        F.collect_set(F.when(F.col("o2"), F.col("token"))).alias("p2"), F.collect_set(F.when(F.col("o3"), F.col("token"))).alias("p3")
    )
    orders = materialize(orders, "other-orders")

    # the whole sets of documents that have any candidate
    few = candidates.count() <= BROADCAST_IDS
    chosen = F.broadcast(candidates) if few else candidates
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("t")).join(chosen, "doc", "left_semi")

    def whole(batches):
        for batch in slices(batches):
            found = [shingle_set(plain_words(t.as_py()), k).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc", "tokens"])

    sets = materialize(texts.mapInArrow(whole, "doc long, tokens binary").where("octet_length(tokens) > 0"), "whole-sets")

    pairs = posts.where(F.col("doc") != F.col("typical")).where(_possible("n", "alone", "typical_n", "typical_alone", percent))
    pairs = pairs.select(F.col("doc").alias("a"), F.col("typical").alias("b")).distinct()
    links = materialize(_verify(_share_orders(pairs, orders), sets, percent), "typical-links")
    groups = materialize(components(links), "components")

    placed = posts.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("token")
    placed = materialize(placed.join(mixed, "token").select("token", "doc", "n", "alone", "m", "component"), "mixed-buckets")
    more = _across_small(placed, sets, orders, percent).unionByName(_across_large(placed, sets, orders, percent))
    more = materialize(more.distinct(), "other-links")
    if not more.isEmpty():
        groups = materialize(components(links.unionByName(more)), "components")

    out = rows.join(nodes, "digest", "left").join(groups, "node", "left")
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("component", "node", "doc")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns kept."""
    kept = similar_groups(docs, k, percent, id_col, text_col).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_keep"]), "left_semi")
