"""Fill-in-middle by secondary-sort assembly.

A text's units (a word with the white space before it) are cut into prefix, middle and
suffix at places that follow from a hash of its id. Each segment leaves as pieces of whole
units and bounded size, keyed by document and position in the output. One shuffle brings a
document's pieces together, sorted by position, so that the output streams past and no task
ever holds one; its digest grows piece by piece. To restore the text the pieces are sorted
again, in place, by the segment that the output's marks name and then by position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 1 << 15
BATCH_BYTES = 1 << 22
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
# where a segment stands in the text
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offsets behind the units: a word with the white space before it, or white space at the end."""
    if not text:
        return np.empty(0, np.int64)
    b = np.frombuffer(text, np.uint8)
    word = (b != 0x20) & ((b < 0x09) | (b > 0x0D))
    return np.append(np.flatnonzero(word[:-1] & ~word[1:]) + 1, len(b))


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that depend on the id alone (null is written as ``null``)."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def segments(text: bytes, ends: np.ndarray, h: tuple[int, int, int, int], fim_percent: int, spm_percent: int) -> tuple[str, list[tuple[bytes, int, int]]]:
    """The form of a text and its segments in output order, as mark, start and end."""
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= fim_percent:
        return "plain", [(b"", 0, len(text))]
    n = len(ends)
    low, high = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = (PREFIX, 0, low), (MIDDLE, low, high), (SUFFIX, high, len(text))
    return ("spm", [suffix, prefix, middle]) if h[3] % 100 < spm_percent else ("psm", [prefix, suffix, middle])


def cuts(text: bytes, ends: np.ndarray, start: int, end: int, size: int) -> list[int]:
    """Ends of a segment's pieces: behind whole units where these fit, else between two characters."""
    out = []
    while end - start > size:
        k = int(np.searchsorted(ends, start + size, "right")) - 1
        cut = int(ends[k]) if k >= 0 else 0
        if cut <= start:
            cut = start + size
            while cut > start + 1 and text[cut] & 0xC0 == 0x80:
                cut -= 1
        out.append(cut)
        start = cut
    return [*out, end]


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Pieces of every document's output: row, doc_id, n, form, prefix_chars, middle_chars, position, last, piece.

    ``row`` tells apart repeated rows. Null counts as empty, and an empty text has one empty piece
    and form plain, as has a text that holds a mark. ``n`` counts units; ids may be null; other
    columns are not read. An empty table gives no pieces.
    """
    if piece_bytes < 4:
        raise ValueError("a piece must hold any one character")
    names = ["row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "position", "last", "piece"]

    def run(batches):
        for batch in batches:
            kinds = [pa.int64(), batch.schema.field(1).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            out, held = [], 0
            for row, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or b""
                ends = unit_ends(text)
                form, parts = segments(text, ends, draws(key, seed), fim_percent, spm_percent)
                sizes = {mark: len(text[a:b].decode()) for mark, a, b in parts if mark in (PREFIX, MIDDLE)}
                own = []
                for mark, a, b in parts:
                    for cut in cuts(text, ends, a, b, piece_bytes):
                        own.append(mark + text[a:cut])
                        mark, a = b"", cut
                head = (row, key, len(ends), form, sizes.get(PREFIX), sizes.get(MIDDLE))
                out += [(*head, k, k + 1 == len(own), piece) for k, piece in enumerate(own)]
                held += len(text)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    types = [T.LongType(), docs.schema[id_col].dataType, T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.LongType(), T.BooleanType(), T.StringType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, schema)


def assembled(found: DataFrame) -> DataFrame:
    """The pieces by document in output order: joined one after the other they are the outputs."""
    return found.repartition("row").sortWithinPartitions("row", "position")


def with_digests(sorted_pieces: DataFrame) -> DataFrame:
    """Pieces of :func:`assembled` with the digest of the output (on its last piece) and their place in the text.

    The output alone decides: a piece that begins with a mark opens that mark's segment, and the
    mark is taken off. A form plain has no marks.
    """
    kept = ["row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "position"]

    def run(batches):
        digest, place = hashlib.sha256(), 0
        for batch in batches:
            place_of, bodies, digests = [], [], []
            for form, position, last, piece in zip(batch.column("form").to_pylist(), batch.column("position").to_pylist(), batch.column("last").to_pylist(), batch.column("piece").to_pylist()):
                if position == 0:
                    digest, place = hashlib.sha256(), 0
                digest.update(piece)
                if form != "plain" and piece[:3] in PLACE:
                    place, piece = PLACE[piece[:3]], piece[3:]
                place_of.append(place)
                bodies.append(piece)
                digests.append(digest.hexdigest() if last else None)
            columns = [*(batch.column(k) for k in kept), pa.array(place_of, pa.int32()), pa.array(bodies, pa.binary()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "place", "body", "output_sha256"])

    schema = T.StructType([*(sorted_pieces.schema[k] for k in kept), T.StructField("place", T.IntegerType()), T.StructField("body", T.BinaryType()), T.StructField("output_sha256", T.StringType())])
    return sorted_pieces.withColumn("piece", F.col("piece").cast("binary")).mapInArrow(run, schema)


def restored(found: DataFrame) -> DataFrame:
    """The pieces of :func:`with_digests` in the order of the text; a document's pieces are in one partition already."""
    return found.sortWithinPartitions("row", "place", "position")


def digests(sorted_pieces: DataFrame) -> DataFrame:
    """Per document of :func:`restored`: its columns, output_sha256, and restored_sha256 of the text put together again."""
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def run(batches):
        row = head = output = digest = kinds = None

        def close(out):
            if row is not None:
                out.append((*head, output, digest.hexdigest()))

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in kept] + [pa.string(), pa.string()]
            out = []
            heads = zip(*(batch.column(k).to_pylist() for k in kept))
            for own, key, body, whole in zip(batch.column("row").to_pylist(), heads, batch.column("body").to_pylist(), batch.column("output_sha256").to_pylist()):
                if own != row:
                    close(out)
                    row, head, output, digest = own, key, None, hashlib.sha256()
                digest.update(body)
                output = whole or output
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if row is not None:
            out = []
            close(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = [*kept, "output_sha256", "restored_sha256"]
    schema = T.StructType([*(sorted_pieces.schema[k] for k in kept), T.StructField(names[-2], T.StringType()), T.StructField(names[-1], T.StringType())])
    return sorted_pieces.mapInArrow(run, schema)
