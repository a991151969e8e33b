"""Alignment of the tokens of two tokenizers by merge-path partitioning.

Both tokenizers cut the same bytes, so a text's tokens are two rising lists of end offsets.
Merging them visits each byte range that belongs to one token of A and one of B: every range
is a link, and where both lists end a group closes. The texts of a slice lie one behind the
other in one merge, whose path is cut by diagonals into pieces of equal work, however long
the single texts are; a piece needs no other piece and emits its overlaps, and groups that
lie across pieces are stitched from the ends that the pieces found closed.

Links are counted over the corpus by blocks: a block of bounded size lists its distinct id
pairs with their counts, only these lists are shuffled, summed and answered, and a document
refers to its pairs by their place in its block's list. Places and counts are as wide as they
need to be, and the lists have columns of their own, so reading them leaves the documents'
columns alone. Nothing is broadcast or collected.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.llm.tokens import Encoder, process_wide
from terraprofile.session import materialize

PIECE_STEPS = 1 << 16
SLICE_CHARS = 1 << 20
BLOCK_LINKS = 1 << 20


class PieceEncoder:
    """Ids of a sentencepiece model, which puts a space before a text, and the bytes of each id."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()

    def token_bytes(self) -> list[bytes]:
        sp = self.library
        return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers with the byte length of each id, and the texts of ids in a group's notation."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = Encoder(a_file, False), PieceEncoder(b_file)
        self.a_bytes, self.b_bytes = self.a.token_bytes(), self.b.token_bytes()
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # id and what follows it: inside its side of a group, or behind its last token
        self.written = [b"%d%c" % (i, c) for ends, n in ((b",|", len(self.a_bytes)), (b",;", len(self.b_bytes))) for i in range(n) for c in ends]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B per text; none for both where either's bytes are not the text's behind a space."""
        out = []
        none = np.empty(0, np.uint32)
        for text, b in zip(texts, self.b.encode(texts)):
            whole = b" " + text.encode()
            same = text and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            a = self.a.ids(" " + text) if same else none
            # a vocabulary of ranked byte strings joins a text's own bytes
            same = same and (self.a.ranked is not None or b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole)
            out.append((a, np.array(b, np.uint32)) if same else (none, none))
        return out


def diagonals(a_ends: np.ndarray, b_ends: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of ``steps`` merge steps begin and end in both lists.

    One binary search per diagonal, all of them at once. An end in both lists stays in one piece.
    """
    n, m = len(a_ends), len(b_ends)
    d = np.arange(0, n + m, steps)[1:]
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = a_ends[np.minimum(middle, n - 1)] <= b_ends[np.clip(d - middle - 1, 0, m - 1)]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i, j = low, d - low
    torn = (i > 0) & (j < m)
    torn[torn] = a_ends[i[torn] - 1] == b_ends[j[torn]]
    return np.concatenate([[0], i, [n]]), np.concatenate([[0], j + torn, [m]])


def merge_piece(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps of a piece in order: places of A's and B's token, and whether both end with it.

    A place behind the piece's last token means the token that goes on in the next piece.
    """
    both = np.concatenate([a_ends, b_ends])
    both.sort(kind="stable")  # two rising runs, which a merge sort takes in one pass
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    ends = both[new]
    # a token's place is the number of its list's ends before
    stops = np.zeros((2, len(ends)), bool)
    for k, own in enumerate((a_ends, b_ends)):
        stops[k, np.searchsorted(ends, own)] = True
    before = np.cumsum(stops, axis=1) - stops
    return before[0], before[1], stops[0] & stops[1]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two lists of ends with the same last end, from independent pieces."""
    if not len(a_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    i, j = diagonals(a_ends, b_ends, steps)
    found = []
    for k in range(len(i) - 1):
        a, b, closed = merge_piece(a_ends[i[k] : i[k + 1]], b_ends[j[k] : j[k + 1]])
        found.append((a + i[k], b + j[k], closed))
    return tuple(np.concatenate(c) for c in zip(*found))


def stitched(a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, n_a_ids: int) -> np.ndarray:
    """Codes of all tokens in the order of the groups' notation, groups closing at the given places.

    A code is twice the id (B's behind all of A's) plus one for the last token of its side.
    """
    a_group, b_group = np.searchsorted(a_last, np.arange(len(a_ids))), np.searchsorted(b_last, np.arange(len(b_ids)))
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    for ids, last, group, other, base in ((a_ids, a_last, a_group, np.concatenate([[0], b_last + 1]), 0), (b_ids, b_last, b_group, a_last + 1, n_a_ids)):
        code = (ids.astype(np.int64) + base) * 2
        code[last] += 1
        codes[np.arange(len(ids)) + other[group]] = code
    return codes


def _whole_type(largest: int) -> np.dtype:
    """The narrowest type of whole numbers up to ``largest``."""
    return np.min_scalar_type(largest).newbyteorder("<")


def references(places: np.ndarray, counts: np.ndarray, listed: int) -> list[bytes]:
    """Places in a list of ``listed`` pairs and their counts, each as wide as its largest needs."""
    return [x.astype(_whole_type(largest)).tobytes() for x, largest in ((places, max(listed - 1, 0)), (counts, int(counts.max(initial=0))))]


def referred(places: bytes, counts: bytes, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts as :func:`references` wrote them."""
    places = np.frombuffer(places, _whole_type(max(listed - 1, 0)))
    return places, np.frombuffer(counts, f"<u{len(counts) // max(len(places), 1) or 1}").astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]):
    """Ids and texts (null as empty) of few rows at a time."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(key)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def aligned_blocks(docs: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str, with_groups: bool, steps: int, block_links: int) -> DataFrame:
    """Rows of two kinds: documents with their pairs' places and counts in the block, and (``head``) each block's pairs and links."""

    def run(batches):
        pair = process_wide(Pair, a_file, b_file)
        n_a_ids = len(pair.a_bytes)
        block = TaskContext.get().partitionId() << 32
        rows, links, held = [], [], 0

        def flush():
            nonlocal block, rows, links, held
            keys, places, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(x) for x in links])
            for row, end, own in zip(rows, ends, links):
                own, n = np.unique(places[end - len(own) : end], return_counts=True)
                row += [*references(own, n, len(keys)), None, None]
            head = [None, 0, 0, 0, 0, "", None, True, None, None, keys.astype("<i8").tobytes(), counts.astype("<i8").tobytes()]
            columns = list(zip(*rows, head))
            batch = pa.RecordBatch.from_arrays([pa.array([block] * len(columns[0]), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)
            block, rows, links, held = block + 1, [], [], 0
            return batch

        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.string(), pa.string(), pa.bool_(), *[pa.binary()] * 4]
            for keys, texts in _slices([batch]):
                ids = pair.encode(texts)
                a_ids, b_ids = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
                a, b, closed = overlaps(np.cumsum(pair.a_size[a_ids]), np.cumsum(pair.b_size[b_ids]), steps)
                found = b_ids[b].astype(np.int64) * n_a_ids + a_ids[a]
                a_last, b_last = a[closed], b[closed]
                codes = stitched(a_ids, b_ids, a_last, b_last, n_a_ids)
                # a text's last tokens close a group, so its links, groups and codes are runs
                n_a, n_b = (np.array([len(x[k]) for x in ids]) for k in (0, 1))
                a_to = np.cumsum(n_a)
                to = np.cumsum(n_a + n_b)
                link_to, group_to = np.searchsorted(a, a_to), np.searchsorted(a_last, a_to)
                at = l0 = g0 = 0
                for key, x, y, end, l1, g1 in zip(keys, n_a.tolist(), n_b.tolist(), to.tolist(), link_to.tolist(), group_to.tolist()):
                    text = b"".join(map(pair.written.__getitem__, codes[at:end].tolist()))[:-1]
                    digest = hashlib.sha256(text).hexdigest() if x else ""
                    rows.append([key, x, y, g1 - g0, l1 - l0, digest, text.decode() if with_groups else None, False])
                    links.append(found[l0:l1])
                    held += l1 - l0
                    at, l0, g0 = end, l1, g1
                    if held >= block_links:
                        yield flush()
        if rows:
            yield flush()

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "head", "places", "counts", "pairs", "links"]
    types = [T.LongType(), docs.schema[id_col].dataType, *[T.LongType()] * 4, T.StringType(), T.StringType(), T.BooleanType(), *[T.BinaryType()] * 4]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n) for the distinct pairs of every block."""

    def run(batches):
        for batch in batches:
            for block, pairs, links in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(np.frombuffer(links, "<i8"))], names=["block", "pair", "n"])

    return blocks.where("head").select("block", "pairs", "links").mapInArrow(run, "block long, pair long, n long")


def _pair_links(listed: DataFrame, n_a_ids: int) -> DataFrame:
    """Per id pair: its links over the corpus, and whether no pair of its B id has more."""
    counts = listed.groupBy("pair").agg(F.sum("n").alias("links")).withColumn("b_id", F.expr(f"pair div {n_a_ids}"))
    most = counts.groupBy("b_id").agg(F.max("links").alias("most"))
    return counts.join(most, "b_id").select("pair", (F.col("pair") % n_a_ids).alias("a_id"), "b_id", "links", (F.col("links") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
    steps: int = PIECE_STEPS, block_links: int = BLOCK_LINKS,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the links of id pairs over the corpus.

    The first frame has doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair
    is the commonest of its B id, ties included) and count_sum (links of each link's pair, summed),
    and with ``with_groups`` the groups themselves (``a1,a2|b1;a3|b2``). The second has a_id, b_id,
    links and best. Null and empty texts, and texts that either tokenizer does not keep byte by byte
    behind one space, have no tokens: zeros and an empty digest. Rows stay, repeated ones and those
    without id too; columns other than id and text are not read. An empty table gives no rows.
    """
    n_a_ids = _ids_of(a_file)
    blocks = materialize(aligned_blocks(docs, a_file, b_file, id_col, text_col, with_groups, steps, block_links), "aligned")
    listed = _block_pairs(blocks)
    pairs = materialize(_pair_links(listed, n_a_ids), "pair-links")
    answers = listed.select("block", "pair").join(pairs.select("pair", "links", "best"), "pair")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
    own = blocks.where("NOT head").select("block", *kept, "places", "counts")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        links, best = right.column("links").to_numpy(), right.column("best").to_numpy()
        n_best, total = [], []
        for places, counts in zip(left.column("places"), left.column("counts")):
            places, counts = referred(places.as_buffer() or b"", counts.as_buffer() or b"", len(links))
            n_best.append(int(counts[best[places]].sum()))
            total.append(int((counts * links[places]).sum()))
        return pa.table([*(left.column(k) for k in kept), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_best", "count_sum"])

    schema = T.StructType([*(own.schema[k] for k in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    found = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema)
    return found, pairs.select("a_id", "b_id", "links", "best")


def _ids_of(a_file: str) -> int:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(a_file).get_vocab_size()
