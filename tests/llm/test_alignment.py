"""Token alignment against a walk over single bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terraprofile.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", "thing", " ", "  ", "\n", "é", "日本", "🙂", "<|endoftext|>", "</s>", "▁", "\x00", "42", "ing's", " ", "ﬁ"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


def direct(pair, text):
    """Ids of both, and per group its ids, by marking each byte's tokens."""
    a = pair.a.library.encode(" " + text, add_special_tokens=False).ids if text else []
    b = pair.b.library.encode(text) if text else []
    whole = b" " + (text or "").encode()
    if not text or b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
        return [], [], [], []
    of = [[k for k, i in enumerate(ids) for _ in table[i]] for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes))]
    links = sorted(set(zip(*of)))
    groups, start = [], 0
    for end in range(1, len(whole) + 1):
        if all(end == len(whole) or t[end] != t[end - 1] for t in of):
            groups.append([[ids[k] for k in sorted(set(t[start:end]))] for ids, t in zip((a, b), of)])
            start = end
    return a, b, [(a[x], b[y]) for x, y in links], groups


def odd_texts():
    chance = random.Random(11)
    return [None, "", " ", "<s>", "▁", "word " * 500, "x" * 900, *("".join(chance.choices(PARTS, k=chance.randint(1, 25))) for _ in range(120))]


def notation(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)


@pytest.mark.parametrize("steps, block", [(1, 1), (7, 40), (alignment.PIECE_STEPS, alignment.BLOCK_LINKS)])
def test_alignment_is_the_direct_one(spark, pair, steps, block):
    texts = odd_texts()
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(2, "the thing", "x"), (None, "no id", "x")]
    found, pairs = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, pairs string"), A, B, with_groups=True, steps=steps, block_links=block)
    known = [direct(pair, t) for _, t, _ in rows]
    counts = Counter(link for _, _, links, _ in known for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    assert {(r.a_id, r.b_id): (r.links, r.best) for r in pairs.collect()} == {k: (n, n == most[k[1]]) for k, n in counts.items()}
    expected = []
    for (k, _, _), (a, b, links, groups) in zip(rows, known):
        text = notation(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        expected.append((k, len(a), len(b), len(groups), len(links), digest, text, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)))
    key = lambda r: [str(x) for x in r]
    assert sorted([tuple(r) for r in found.collect()], key=key) == sorted(expected, key=key)
    assert sum(len(x[0]) > 0 for x in known) > 60


def test_diagonals_cut_equal_work_and_no_common_end():
    chance = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(np.append(chance.integers(1, 200, n), 200)) for n in chance.integers(1, 120, 2))
        i, j = alignment.diagonals(a, b, 9)
        work = np.diff(i + j)
        assert (work[:-1] <= 10).all() and (work[:-1] >= 8).all() and work.sum() == len(a) + len(b)
        whole, cut = alignment.overlaps(a, b), alignment.overlaps(a, b, 9)
        assert all((x == y).all() for x, y in zip(whole, cut))


def test_an_empty_table_and_empty_texts(spark):
    frame = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    found, pairs = alignment.align(frame, A, B)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)] and pairs.count() == 0
    found, pairs = alignment.align(frame.where("false"), A, B)
    assert found.count() == 0 and pairs.count() == 0


def test_a_long_text_is_many_pieces(spark, pair):
    text = "strange things are aligned here, piece by piece; " * 9000
    frame = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    found, _ = alignment.align(frame, A, B)
    row = found.first()
    a, b, links, groups = direct(pair, text)
    assert (row.n_a, row.n_b, row.n_links, row.n_groups) == (len(a), len(b), len(links), len(groups))
    assert row.groups_sha256 == hashlib.sha256(notation(groups).encode()).hexdigest() and row.n_a + row.n_b > 2 * alignment.PIECE_STEPS


def test_documents_refer_to_pairs_in_few_bytes_and_lists_are_read_alone(spark, tmp_path):
    texts = [*odd_texts(), "".join(map(chr, range(0x4E00, 0x5200)))]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    alignment.aligned_blocks(frame, A, B, "doc_id", "text", False, 1 << 16, 1 << 20).write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    listed = alignment._block_pairs(blocks)
    assert 256 < listed.count() < 1 << 16
    read = listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(x.split(":")[0] for x in read.split(",")) == ["block", "head", "links", "pairs"]
    known = Counter({(r.block, r.pair): r.n for r in listed.collect()})
    pairs = {b: sorted(p for c, p in known if c == b) for b, _ in known}
    found, wide = Counter(), 0
    for r in blocks.where("NOT head").collect():
        places, counts = alignment.referred(r.places, r.counts, len(pairs[r.block]))
        found.update({(r.block, pairs[r.block][p]): n for p, n in zip(places.tolist(), counts.tolist())})
        assert len(r.places) == 2 * len(places) and len(r.counts) <= 2 * len(places) and counts.sum() == r.n_links
        wide += len(r.counts) > len(places)
    assert found == known and wide > 0


@pytest.mark.parametrize("listed", [0, 1, 256, 257, 1 << 16, (1 << 16) + 1])
@pytest.mark.parametrize("most", [1, 255, 256, (1 << 16) - 1, 1 << 16, (1 << 32) - 1, 1 << 32])
def test_places_and_counts_come_back(listed, most):
    places = np.unique(np.array([0, listed // 2, listed - 1])) if listed else np.empty(0, np.int64)
    counts = np.full(len(places), 1, np.int64)
    counts[-1:] = most
    x, y = alignment.referred(*alignment.references(places, counts, listed), listed)
    assert x.tolist() == places.tolist() and y.tolist() == counts.tolist()


def test_the_query_deals_its_rows_anew_before_they_are_written(spark, tmp_path):
    rows = [(1, "the thing"), (None, "a thing"), (None, ""), (1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op12_align_tokens"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("RebalancePartitions")
    assert sorted((r.doc_id or 0, r.n_a > 0) for r in found.collect()) == [(0, False), (0, True), (1, False), (1, True)]
