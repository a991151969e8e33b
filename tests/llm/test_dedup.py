"""Exact and near copies, components and decontamination against brute force."""

import hashlib
import os
import random
import string

import pytest

from pyspark.sql import functions as F
from terraprofile import session
from terraprofile.llm import decontaminate, exact_dedup, graph, jaccard_join

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text, k):
    w = (text or "").translate(FOLD).encode().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute_groups(rows, k, percent):
    sets = {d: words_of(t, k) for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a != b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return {d: (len(sets[d]), label[d]) for d in sets}


def corpus(seed, n_groups, copies):
    chance, rows, at = random.Random(seed), [], 0
    vocabulary = [f"w{i}" for i in range(400)]
    common = [chance.choice(vocabulary) for _ in range(30)]
    for g in range(n_groups):
        base = [chance.choice(vocabulary) for _ in range(chance.randint(1, 120))]
        for _ in range(chance.randint(1, copies)):
            own = list(base)
            for _ in range(chance.randint(0, 4)):
                own[chance.randrange(len(own))] = chance.choice(vocabulary)
            if chance.random() < 0.3:
                own += common
            rows.append((at, " ".join(own)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "One"), (at + 4, "one"), (at + 5, "x y " * 5000), (at + 6, "x y " * 5000)]
    return rows


@pytest.mark.parametrize("k,percent,copies", [(3, 90, 6), (5, 80, 40)])
def test_groups_equal_brute_force(spark, monkeypatch, k, percent, copies):
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 8)  # both ways to meet are taken
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 4000)
    rows = corpus(k, 12, copies)
    docs = spark.createDataFrame([(d, t, d, "z") for d, t in rows], "doc_id long, text string, n long, token string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs, k, percent).collect()}
    assert found == brute_groups(rows, k, percent)


def test_groups_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.similar_groups(spark.createDataFrame([], schema)).count() == 0
    found = jaccard_join.similar_groups(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in found) == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300), (300, 200)], "a long, b long")
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert found == {**{i: 0 for i in range(101)}, 200: 200, 300: 200}


TEXTS = [None, "", "", "Abc", "aBC", "É x", "é x", "long " * 9000, "LONG " * 9000, "long " * 8999, "no cut here" * 5, "日本" * 9000]


@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups(spark, monkeypatch, clash):
    if clash:  # every chunk's identifier is shared: the way for clashes is taken
        whole = exact_dedup._clashes
        monkeypatch.setattr(exact_dedup, "_clashes", lambda t: t.select(F.explode("_chunks").alias("c")).select(F.xxhash64("c").alias("h")).distinct())
        assert whole is not exact_dedup._clashes
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, keep_id string, kept int")
    found = {r.doc_id: r for r in exact_dedup.exact_groups(docs, low=16, high=64).collect()}
    folded = [(t or "").translate(FOLD) for t in TEXTS]
    for i, t in enumerate(folded):
        same = [j for j, u in enumerate(folded) if u == t]
        r = found[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(folded))


def test_chunk_clashes_are_found(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert exact_dedup._clashes(exact_dedup._recipes(docs, "doc_id", "text", 16, 64)).count() == 0


def test_decontamination_of_small_cases(spark):
    item = " ".join(f"i{k}" for k in range(15))
    items = spark.createDataFrame([(1, item), (2, "Short Item"), (3, None), (4, ""), (5, item), (None, "zz")], "item_id long, text string")
    docs = [(1, f"x {item} y"), (2, "a short, ITEM b"), (3, None), (4, ""), (5, " ".join(f"i{k}" for k in range(12))), (6, "short item " + "w " * 60), (7, f"{item.upper()} {item}"), (7, "zz")]
    frame = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, items string")
    for block in (100, 2):
        found = decontaminate.with_verdict(decontaminate.contamination(frame, items, block_windows=block)).collect()
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in found)
        assert got == [(1, 17, 15, [1, 5], True), (2, 4, 2, [2], True), (3, 0, 0, [], False), (4, 0, 0, [], False), (5, 12, 0, [], False), (6, 62, 2, [2], False), (7, 1, 0, [], False), (7, 30, 30, [1, 5], True)]
    assert decontaminate.contamination(frame, items.where("false")).where("size(spans) > 0").count() == 0
    assert decontaminate.drop_contaminated(frame.where("doc_id < 7"), items).count() == 4


def test_repeated_ids_bring_no_copy_back(spark):
    rows = [(1, "a", 0), (1, "b", 0), (2, "A", 0), (5, "x", 0), (5, "x", 1), (None, "x", 0), (None, None, 0), (None, "", 1)]
    left = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string, _keep int")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == [("1", "b"), ("2", "A"), ("5", "x"), ("None", "")]
    assert left[0].asDict().keys() == {"doc_id", "text", "_keep"}


def test_tokens_for_prefixes_are_deleted_when_prefixes_are_written(spark, monkeypatch):
    written = []
    real = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *a: written.append(real(*a)) or written[-1])
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z"), (4, None)]
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_groups(rows, 2, 80)
    kept = {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: os.path.exists(p.removeprefix("file:")) for p in written}
    assert not kept["shingle-samples"] and kept["prefixes"]
