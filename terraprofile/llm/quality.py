"""Document quality from lines labelled by a linear-chain conditional random field.

Every line gets features of its own and of its neighbours. The field weighs them and
the change between good and bad from line to line; forward and backward passes give
each line's chance of being good, and their mean weighted by line length is the
document's score. The field is fitted in the driver on a bounded sample of labelled
documents, whose lines all carry the document's label; scoring covers every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_DOCS = 4_000  # labelled documents the field is fitted on, by hash of their id
TRAIN_LINES = 300  # a longer document is not used for fitting
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
BATCH_DOCS = 400

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = b"0123456789"
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_ENDS = b".,;:'\"?-()"
_ODD_MARKS = bytes(b for b in _MARKS if b not in _ENDS)


def line_features(line: bytes, repeats: float) -> list[float]:
    """Figures of one line: length, words, letters, marks, repetition."""
    n = len(line)
    words = line.split()
    m = len(words)
    size = max(n, 1)
    many = max(m, 1)
    same = sum(a == b for a, b in zip(words, words[1:]))
    upper, lower = n - len(line.translate(None, _UPPER)), n - len(line.translate(None, _LOWER))
    odd = n - len(line.translate(None, _ODD_MARKS))
    return [
        1.0,
        np.log1p(n) / 8,
        np.log1p(m) / 6,
        min(n / many, 40) / 10,
        upper / (upper + lower + 1),
        (n - len(line.translate(None, _DIGIT))) / size,
        min(odd / many, 4.0) / 2,
        min((n - len(line.translate(None, _ENDS))) / many, 4.0),
        same / many,
        1 - len(set(words)) / many,
        np.log1p(m) * (1 - len(set(words)) / many) / 6,
        repeats,
        float(line[-1:] in (b".", b"!", b"?", b'"')),
        float(n == 0),
        float(line.count(b"!!") > 0),
        float(odd == 0),
    ]


WIDTH = 16


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines with those of both neighbours, and the lines' lengths. No text is one empty line."""
    lines = (text or b"").split(b"\n")
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    n = len(lines)
    own = np.array([line_features(x, np.log(seen[x]) / 4) for x in lines], np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.hstack([own, before, after]), np.array([len(x) + 1 for x in lines], np.float64)[:n]


@dataclass(frozen=True)
class Field:
    """Weights of the good label over the bad, 2 x 2 changes between lines, and the curve of the score."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float


def _chains(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over documents laid end to end: line marginals, expected moves, log sums.

    Documents advance together, longest first, so a step handles all that are that long.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, ordered = starts[order], sizes[order]
    total, longest = int(sizes.sum()), int(ordered[0]) if len(ordered) else 0
    emit = np.zeros((total, 2))
    emit[:, 1] = scores
    forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
    active = [int(np.searchsorted(-ordered, -t, side="left")) for t in range(longest)]  # documents with more than t lines
    join = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    forward[starts] = emit[starts]
    for t in range(1, longest):
        at = starts[: active[t]] + t
        forward[at] = emit[at] + join((forward[at - 1][:, :, None] + moves[None]).transpose(0, 2, 1))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        backward[at] = join(moves[None] + (emit[at + 1] + backward[at + 1])[:, None, :])
    ends = starts + ordered - 1
    logs = np.empty(len(sizes))
    logs[order] = join(forward[ends])
    owner = np.repeat(logs, sizes)
    marginal = np.exp(forward[:, 1] + backward[:, 1] - owner)
    inner = np.ones(total, bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + moves[None] + (emit[at] + backward[at])[:, None, :] - owner[at][:, None, None]
    return marginal, np.exp(pair).sum(0), logs


def _raw_scores(features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Length-weighted mean chance of good lines per document."""
    good, _, _ = _chains(features @ weights, sizes, moves)
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)


def fit_field(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Field:
    """Fit by gradient steps on the likelihood of all lines carrying their document's label."""
    sizes = np.array([len(f) for f, _ in documents])
    features, lengths = np.vstack([f for f, _ in documents]).astype(np.float64), np.concatenate([n for _, n in documents])
    lines = np.repeat(labels, sizes).astype(np.float64)
    n = len(documents)
    # documents count alike, whatever their number of lines
    weights, moves = np.zeros(features.shape[1]), np.zeros((2, 2))
    starts = np.cumsum(sizes) - sizes
    given = np.zeros((2, 2))
    inner = np.maximum(sizes - 1, 0)
    given[1, 1], given[0, 0] = inner[labels == 1].sum(), inner[labels == 0].sum()
    theta = np.concatenate([weights, moves.ravel()])
    m = v = np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        marginal, pairs, _ = _chains(features @ weights, sizes, moves)
        gradient = np.concatenate([features.T @ (lines - marginal), (given - pairs).ravel()]) / n - RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
    raw = _raw_scores(features, lengths, sizes, weights, moves)
    slope, shift = _curve(_logit(raw), labels)
    return Field(weights.astype(np.float64), moves, slope, shift)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _curve(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve from raw scores to chances, both labels weighing alike; it never falls."""
    weight = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((labels - p) * weight * x).sum() - 0.01 * (a - 1), ((labels - p) * weight).sum() - 0.01 * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        a, b = max(a + da, 0.05), b + db
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_DOCS) -> Field | None:
    """The field from at most ``limit`` labelled documents of not more than ``TRAIN_LINES`` lines; None without both labels.

    Documents whose crc32 of the id modulo 4 is 2 are held out. Rows without id, text or label are not used;
    rows that repeat an id count towards the limit each.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)").dropDuplicates(["_id"])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(~held_out(F.col("_id")) & F.col("_text").isNotNull())
    short = F.regexp_count("_text", F.lit("\n")) < TRAIN_LINES
    order = F.xxhash64(F.col("_id").cast("string"))
    # labels and ids first: only the chosen documents' texts are read for features
    chosen = rows.where(short).select("_id").join(known, "_id").distinct().orderBy(order, "_id").limit(limit)
    kind = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("id", T.StringType())])

    def run(batches):
        for batch in batches:
            made = [document_features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.tobytes() for f, _ in made], pa.binary()), pa.array([n.tobytes() for _, n in made], pa.binary()), batch.column(2)], names=["label", "features", "lengths", "id"]
            )

    texts = rows.where(short).join(F.broadcast(chosen), "_id").select("_label", F.col("_text").cast("binary").alias("_text"), F.col("_id").cast("string").alias("_key"))
    found = texts.mapInArrow(run, kind).orderBy("id", "features").limit(limit).collect()
    made = [(np.frombuffer(bytes(r.features), np.float32).reshape(-1, 3 * WIDTH), np.frombuffer(bytes(r.lengths), np.float64)) for r in found]
    marks = np.array([r.label for r in found], np.int64)
    return fit_field(made, marks) if len(set(marks.tolist())) == 2 else None


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 from 0.7 on).

    Only the text decides. Null counts as empty, and empty texts as one empty line. Without a field
    (no labels of both kinds) every score is 0.5. Rows repeat as given; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts, out = batch.column(2), []
            for start in range(0, len(texts), BATCH_DOCS):
                part = texts.slice(start, BATCH_DOCS).to_pylist()
                if field is None:
                    out.append(np.full(len(part), 0.5))
                    continue
                made = [document_features(t) for t in part]
                raw = _raw_scores(np.vstack([f for f, _ in made]), np.concatenate([n for _, n in made]), np.array([len(f) for f, _ in made]), field.weights, field.moves)
                out.append(1 / (1 + np.exp(-(field.slope * _logit(raw) + field.shift))))
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns kept."""
    bad = score(docs, train(docs, labels, id_col, text_col), id_col, text_col).where("predicted = 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
