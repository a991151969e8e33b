"""Packing of documents into windows by lexical retrieval.

Texts become token ids once and are kept as a table. Document frequencies of all
token ids are summed over all documents. Documents are brought together by the rarest
ids that they share with others, over the whole corpus, and taken in this order in
shards of bounded size; each shard has an inverted index with BM25 weights. A seed
document opens a window, and its best unused neighbours fill the rest. The document
that overflows a window goes on in the next and is its seed, so every window but a
shard's last is full; the last is cut at powers of two, which need no padding.
Documents move once, and no shard holds more than its bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.llm.tokens import Encoder, process_wide
from terraprofile.session import materialize

WINDOW = 2048
SHARD_DOCS, SHARD_TOKENS = 1024, 2_000_000
SIGNATURE = 4
SIGNED = 24  # smallest keys looked at first
DENSE_SHARE = 16  # a term of a 16th of a shard's documents has a row of weights
FIRST = 48
K1, B = 1.2, 0.75


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and ids (16-bit where the vocabulary fits, else 32-bit) with ``end_id`` behind every text."""

    def run(batches):
        coder = process_wide(Encoder, tokenizer)
        kind = "<u2" if coder.size <= 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = [coder.ids(t.as_py()).astype(kind).tobytes() + end for t in batch.column(1)]
            width = pa.array([int(kind[2])] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), width, pa.array(ids, pa.binary())], names=["doc_id", "width", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def _statistics(table: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents, tokens, and documents per token id, over all rows; at most a number per id of the vocabulary."""

    def count(batches):
        df, docs, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, f"<u{width}")
                own = np.unique(ids)
                if own[-1] >= len(df):
                    df = np.pad(df, (0, int(own[-1]) + 1 - len(df)))
                df[own] += 1
                docs, tokens = docs + 1, tokens + len(ids)
        terms = np.flatnonzero(df)
        keys, values = [-1, -2, *terms.tolist()], [docs, tokens, *df[terms].tolist()]
        yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.int64()), "n": pa.array(values, pa.int64())})

    rows = table.select("width", "ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in rows.toLocalIterator()}
    return found.pop(-1, 0), found.pop(-2, 0), found


def rarest_shared(ids: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The ``SIGNATURE`` rarest distinct ids that another document has, ties by id."""
    n = df[ids]
    keys = (n << 32 | ids)[n > 1]
    few = np.unique(np.partition(keys, SIGNED)[:SIGNED]) if len(keys) > 2 * SIGNED else np.unique(keys)
    if len(few) < SIGNATURE and len(keys) > 2 * SIGNED:  # one id may fill the few
        few = np.unique(keys)
    return (few[:SIGNATURE] & 0xFFFFFFFF).astype(np.int64)


def _together(table: DataFrame, shared, shard_docs: int) -> DataFrame:
    """The documents, dealt and sorted by the rarest ids that each shares with another document.

    No more documents have an id as their rarest than contain it; ids in more than a shard's documents
    are dealt in as many groups as that makes shards.
    """

    def sign(batches):
        df = shared.value[2]
        at = TaskContext.get().partitionId()
        for batch in batches:
            signs, groups = [], []
            for width, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
                own = rarest_shared(np.frombuffer(raw.as_py(), f"<u{width}"), df)
                at += 1
                signs.append(own.tolist())
                groups.append(at % -(-int(df[own[0]]) // shard_docs) if len(own) else at)
            columns = [*batch.columns, pa.array(signs, pa.list_(pa.int64())), pa.array(groups, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "width", "ids", "sign", "part"])

    schema = T.StructType([*table.schema.fields, T.StructField("sign", T.ArrayType(T.LongType())), T.StructField("part", T.LongType())])
    first = F.get("sign", F.lit(0))
    signed = table.mapInArrow(sign, schema).withColumn("first", first)
    return signed.repartition("first", "part").sortWithinPartitions("sign", "part").select("doc_id", "width", "ids", "first")


class ShardIndex:
    """BM25 inverted index over the documents of one shard, with the corpus's statistics.

    Terms of many of the shard's documents have a row of weights, and one product of matrices sums
    them for all seeds; the others have posting lists, which are summed when a seed asks.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, owners, weights = [], [], []
        for k, ids in enumerate(docs):
            own, tf = np.unique(ids, return_counts=True)
            norm = K1 * (1 - B + B * len(ids) / mean_length)
            terms.append(own)
            owners.append(np.full(len(own), k))
            weights.append(idf[own] * (tf * (K1 + 1) / (tf + norm)))
        sizes = [len(t) for t in terms]
        terms, owners, weights = np.concatenate(terms), np.concatenate(owners), np.concatenate(weights).astype(np.float64)
        self.size = n = len(docs)
        found, number, count = np.unique(terms, return_inverse=True, return_counts=True)
        common = count * DENSE_SHARE >= n
        row = np.cumsum(common) - 1
        dense = common[number]
        table = np.zeros((int(common.sum()), n))
        table[row[number[dense]], owners[dense]] = weights[dense]
        held = np.zeros((n, len(table)))
        held[owners[dense], row[number[dense]]] = 1
        self.scores = held @ table
        rare = ~dense
        order = np.argsort(number[rare], kind="stable")
        self.owners, self.weights = owners[rare][order], weights[rare][order]
        self.starts = np.searchsorted(number[rare][order], np.arange(len(found) + 1))
        ends = np.cumsum(sizes)
        self.queries = [q[~common[q]] for q in np.split(number, ends[:-1])]

    def neighbours(self, doc: int, unused: np.ndarray):
        """The unused documents that share terms with the seed, best first; ties by position."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.queries[doc]]
        scores = self.scores[doc]
        if spans:
            scores = scores + np.bincount(np.concatenate([self.owners[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.size)
        scores = np.where(unused, scores, 0)
        least, first = 0.0, np.empty(0, np.int64)
        if self.size > FIRST:
            least = np.partition(scores, -FIRST)[-FIRST]
            first = np.flatnonzero((scores >= least) & (scores > 0))
            yield from first[np.argsort(-scores[first], kind="stable")].tolist()
        # a window that these don't fill sees the rest
        rest = np.flatnonzero((scores > 0) & (scores < least)) if len(first) or least > 0 else np.flatnonzero(scores > 0)
        yield from rest[np.argsort(-scores[rest], kind="stable")].tolist()


def fill_windows(lengths: list[int], index: ShardIndex, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    pieces, unused, sequence, offset, n = [], np.ones(len(lengths), bool), 0, 0, len(lengths)
    following = 0

    def place(doc: int) -> None:
        nonlocal sequence, offset
        start = 0
        while start < lengths[doc]:
            take = min(window - offset, lengths[doc] - start)
            pieces.append((doc, start, take, sequence, offset))
            start, offset = start + take, offset + take
            if offset == window:
                sequence, offset = sequence + 1, 0

    while True:
        while following < n and not unused[following]:
            following += 1
        if following == n:
            break
        seed = following if not pieces or offset == 0 else pieces[-1][0]
        if unused[seed]:
            unused[seed] = False
            place(seed)
        opened = sequence
        if offset:
            for other in index.neighbours(seed, unused):
                unused[other] = False
                place(other)
                if sequence != opened or offset == 0:
                    break
        if sequence == opened and offset:  # no neighbour is left: the next document goes on
            while following < n and not unused[following]:
                following += 1
            if following < n:
                unused[following] = False
                place(following)
    return _cut_last(pieces, sequence, offset)


def _cut_last(pieces: list, sequence: int, length: int) -> list:
    """Cut a last window of ``length`` ids into sequences whose lengths are powers of two."""
    if not length:
        return pieces
    done, last = [p for p in pieces if p[3] != sequence], [p for p in pieces if p[3] == sequence]
    sizes = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    room, at = sizes[0], 0
    for doc, start, take, _, _ in last:
        while take:
            part = min(take, room)
            done.append((doc, start, part, sequence, at))
            start, take, room, at = start + part, take - part, room - part, at + part
            if not room:
                sizes.pop(0)
                sequence, at, room = sequence + 1, 0, sizes[0] if sizes else 0
    return done


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit little-endian).

    Each id of each document lies in exactly one piece, and a sequence's pieces fill it from offset
    0 without gaps. Null and empty texts have the end id only. Repeated rows are packed each;
    ids may be null; other columns are not read. An empty table gives no pieces.
    """
    table = materialize(token_table(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    n_docs, n_tokens, df = _statistics(table)
    idf = np.zeros(max(df, default=0) + 1, np.float32)
    counts = np.zeros(len(idf), np.int64)
    for term, n in df.items():
        idf[term], counts[term] = np.log1p((n_docs - n + 0.5) / (n + 0.5)), n
    shared = docs.sparkSession.sparkContext.broadcast((idf, n_tokens / max(n_docs, 1), counts))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        idf, mean, _ = shared.value
        last = None
        base = TaskContext.get().partitionId() << 32
        keys, texts, held = [], [], 0

        def shard():
            nonlocal base
            pieces = fill_windows([len(t) for t in texts], ShardIndex(texts, idf, mean), window)
            columns = [
                pa.array([keys[p[0]] for p in pieces], key_type),
                *(pa.array(c, pa.int64()) for c in ([p[1] for p in pieces], [p[2] for p in pieces], [len(texts[p[0]]) for p in pieces], [base + p[3] for p in pieces], [p[4] for p in pieces])),
                pa.array([texts[d][a : a + n].astype("<u4").tobytes() for d, a, n, _, _ in pieces], pa.binary()),
            ]
            base += max(p[3] for p in pieces) + 1
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, width, raw, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                # a shard that is nearly full ends where another group begins
                if first != last and (4 * len(keys) >= 3 * shard_docs or 4 * held >= 3 * shard_tokens):
                    yield shard()
                    keys, texts, held = [], [], 0
                last = first
                keys.append(key)
                texts.append(np.frombuffer(raw.as_py(), f"<u{width}"))
                held += len(texts[-1])
                if len(keys) >= shard_docs or held >= shard_tokens:
                    yield shard()
                    keys, texts, held = [], [], 0
        if keys:
            yield shard()

    schema = T.StructType([table.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names[1:6]), T.StructField("ids", T.BinaryType())])
    return _together(table, shared, shard_docs).mapInArrow(run, schema)
