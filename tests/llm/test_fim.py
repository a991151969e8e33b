"""Fill-in-middle against a direct form of the same rule."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from terraprofile.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["a", "word", " ", "  ", "\n", "é", "日本", "🙂", "\x1c", " ", "<P", ">", "\t"]


def direct(doc_id, text, spm=80, percent=50):
    """doc_id, n, form, prefix and middle length, and the output, by Python's own means."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    chance = random.Random(3)
    texts = [None, "", " ", "  x", "x  ", "a <P> b", "<M>", "w" * 500, "é" * 333, "🙂 " * 200, *("".join(chance.choices(PARTS, k=chance.randint(1, 60))) for _ in range(150))]
    return [(k, t, "p", 7) for k, t in enumerate(texts)] + [(3, "  x", "p", 7), (3, "other text", "p", 7), (None, "no id", "p", 7), (None, "no id", "p", 7)]


def run(frame, **options):
    return fim.digests(fim.restored(fim.with_digests(fim.assembled(fim.pieces(frame, **options)))))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [4, 50, fim.PIECE_BYTES])
def test_pieces_of_any_size_give_the_direct_result(spark, size):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, position int")
    key = lambda r: [str(x) for x in r]
    expected = sorted([(*direct(k, t)[:5], sha(direct(k, t)[5]), sha(t or "")) for k, t, *_ in rows], key=key)
    assert sorted([tuple(r) for r in run(frame, piece_bytes=size).collect()], key=key) == expected


def test_pieces_in_order_are_the_output(spark):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, position int")
    outputs, forms = {}, set()
    for r in fim.assembled(fim.pieces(frame, piece_bytes=16)).collect():
        assert (r.position == 0) == (r.row not in outputs) and len(r.piece.encode()) <= 19
        outputs[r.row] = outputs.get(r.row, "") + r.piece
        forms.add(r.form)
    assert sorted(outputs.values()) == sorted(direct(k, t)[5] for k, t, *_ in rows)
    assert forms == {"plain", "spm", "psm"}


def test_one_long_unit_and_an_empty_table(spark):
    frame = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("ü" * 300_000).alias("text"))
    assert all(r.restored_sha256 == sha("ü" * 300_000) and r.n == 1 for r in run(frame).collect())
    assert run(frame.where("false")).count() == 0


def test_a_null_column_is_empty_text(spark):
    frame = spark.createDataFrame([(1, None)], "doc_id long, text void")
    assert run(frame).first().n == 0
