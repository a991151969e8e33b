"""Token operators against the library itself, and exact round trips."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F
from terraprofile.llm import packing, token_counts, token_files
from terraprofile.llm.tokens import Encoder
from terraprofile.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "th", "the", " ", "  ", "\n", "'s", "'re", "'", "!", "12", "é", "ß", "日本", "　", "\x1c", "\xa0", "<|endoftext|>", "<|endo", "I'll", "\t", "..", "🙂", "ing", "A", "´", "x'"]


@pytest.fixture(scope="module")
def library():
    return Encoder(PATH).library


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n):
    chance = random.Random(5)
    return ["".join(chance.choice(PARTS) for _ in range(chance.randint(1, 9))) for _ in range(n)]


ODD = [None, "", " ", "a" * 3000, "word " * 4000, "a  b \n c", *odd_texts(60)]


def odd_docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, t string")


def test_encoder_and_prefixes_equal_the_library(library):
    coder, counter = Encoder(PATH), token_counts.PrefixCounter(PATH)
    for text in odd_texts(300):
        assert array("I", coder.encode(text)).tolist() == [] or np.frombuffer(coder.encode(text), "<u4").tolist() == ids(library, text)
        assert counter.prefixes(text).tolist() == [len(ids(library, text[:i])) for i in range(1, len(text) + 1)]


def test_prefixes_of_long_runs_take_no_long(library):
    counter = token_counts.PrefixCounter(PATH)
    for text in ("'" * 100_000, "x" + "'" * 50_000 + "s", "it's " * 20_000, "'!?" * 30_000):
        found = counter.prefixes(text)
        for k in (1, 2, 3, 77, len(text) // 2, len(text) - 1, len(text)):
            assert found[k - 1] == len(ids(library, text[:k]))


def test_counts_answer_cuts_and_budgets(spark, library):
    out = token_counts.prefix_token_counts(odd_docs(spark))
    p = F.col("prefix_tokens")
    rows = out.select("doc_id", "text", "ids", token_counts.n_tokens(p).alias("n"), token_counts.longest_prefix(p, 5).alias("cut"), token_counts.tokens_of_prefix(p, F.lit(2)).alias("two")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = r.text or ""
        assert r.n == len(ids(library, text))
        if len(text) < 100:
            assert r.cut == max((i for i in range(len(text) + 1) if len(ids(library, text[:i])) <= 5), default=0)
        if text:
            assert r.two == len(ids(library, text[:2]))


def test_token_files_round_trip(spark, library):
    docs = odd_docs(spark).unionByName(odd_docs(spark).where("doc_id = 3"))
    folder = token_files.write_token_files(docs, scratch_path(spark, "t"), PATH, 0)
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    expected = [(d, [*ids(library, t), 0]) for d, t in sorted([*enumerate(ODD), (3, ODD[3])], key=lambda x: x[0])]
    assert [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows] == expected
    assert [r.start for r in rows] == np.cumsum([0, *(len(x) for _, x in expected)])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)


def test_token_files_of_an_empty_table(spark):
    folder = token_files.write_token_files(odd_docs(spark).where("false"), scratch_path(spark, "t"), PATH, 0)
    assert folder.parts == () and token_files.read_token_files(spark, folder).count() == 0


def test_packing_keeps_every_id_once_and_pads_nothing(spark, library):
    docs = odd_docs(spark).unionByName(spark.range(500, 540).select(F.col("id").alias("doc_id"), F.lit("some words again and again").alias("text"), F.lit("").alias("ids"), F.lit("").alias("t")))
    rows = packing.pack(docs, PATH, end_id=1, window=64, shard_docs=20).collect()
    texts, got, sequences = dict(enumerate(ODD)), {}, {}
    for r in sorted(rows, key=lambda r: r.start):
        assert len(got.setdefault(r.doc_id, [])) == r.start
        got[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, found in got.items():
        assert found == [*ids(library, texts.get(d, "some words again and again") or ""), 1]
    assert len(got) == len(ODD) + 40
    for pieces in sequences.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total <= 64 and total & (total - 1) == 0
    assert packing.pack(docs.where("false"), PATH, end_id=1).count() == 0


def test_neighbours_come_best_first():
    docs = [np.array(x, "<u2") for x in ([1, 2, 3], [7, 8, 9], [1, 2, 3, 4], [3, 9, 9])]
    index = packing.ShardIndex(docs, np.ones(10, np.float32), 3.0)
    unused = np.ones(4, bool)
    assert [d for d in index.neighbours(0, unused) if d != 0] == [2, 3]
    unused[2] = False
    assert [d for d in index.neighbours(0, unused) if d != 0] == [3]


def test_neighbours_equal_a_plain_sum_of_weights(monkeypatch):
    monkeypatch.setattr(packing, "FIRST", 5)
    chance = np.random.default_rng(2)
    docs = [chance.zipf(1.3, chance.integers(1, 60)) % 300 for _ in range(80)]
    docs[7] = docs[3]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=300)
    idf, mean = np.log1p((80 - df + 0.5) / (df + 0.5)).astype(np.float32), float(np.mean([len(d) for d in docs]))
    index = packing.ShardIndex(docs, idf, mean)
    for seed in range(80):
        unused = chance.random(80) < 0.7
        plain = np.zeros(80)
        for k, d in enumerate(docs):
            for t in set(docs[seed].tolist()) & set(d.tolist()):
                tf = int((d == t).sum())
                plain[k] += idf[t] * (tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)))
        got = list(index.neighbours(seed, unused))
        assert sorted(got) == np.flatnonzero((plain > 0) & unused).tolist()
        assert all(plain[a] >= plain[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_rarest_shared_ids():
    chance = np.random.default_rng(4)
    df = chance.integers(0, 6, 400)
    for n in (1, 3, 60, 500):
        for ids in (chance.integers(0, 400, n), np.full(n, 7), np.repeat(chance.integers(0, 400, 3), n)):
            own = [t for t in np.unique(ids).tolist() if df[t] > 1]
            assert packing.rarest_shared(ids.astype("<u2"), df).tolist() == sorted(own, key=lambda t: (df[t], t))[: packing.SIGNATURE]


def test_ranks_are_the_library_on_every_character(library):
    # the split into pieces is the same for each code point, behind and before letters, digits and marks
    coder = Encoder(PATH)
    assert coder.ranked is not None
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        text = "".join(f"a{c}1{c}!{c} {c}a" for c in points[k : k + 4000])
        assert coder.ids(text).tolist() == ids(library, text)


def test_long_runs_take_no_long(library):
    for text in ("'" * 200_000, "a" * 200_000, " " * 200_000, "x" + "\n" * 200_000 + "y"):
        assert Encoder(PATH).ids(text).tolist() == ids(library, text)


def test_packing_finds_neighbours_of_other_partitions(spark):
    filler = lambda i: " ".join(f"f{i}x{k}" for k in range(30))
    docs = [(i, filler(i)) for i in range(60)]
    docs[1], docs[58] = ((i, "zebra quagga okapi " * 20) for i in (1, 58))
    frame = spark.createDataFrame(spark.sparkContext.parallelize(docs, 6), "doc_id long, text string")
    rows = packing.pack(frame, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, shard_docs=8, window=512).collect()
    held = {i: {r.sequence_id >> 32 for r in rows if r.doc_id == i} for i in (1, 58)}
    assert held[1] == held[58] and {r.doc_id for r in rows} == set(range(60))
    near = {i: {r.sequence_id for r in rows if r.doc_id == i} for i in (1, 58)}
    assert min(abs(a - b) for a in near[1] for b in near[58]) <= 1
