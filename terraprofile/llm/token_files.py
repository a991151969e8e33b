"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Layout of a folder: ``part-N.ids`` holds the ids of the part's documents one after
another (little-endian, 16 bits each if the vocabulary fits, else 32), ``part-N.off``
the n+1 offsets of its documents as 64-bit integers, and ``part-N.doc`` their ids.
Parts are in ascending order of document id. A part's base, the ids in all parts
before it, is a prefix sum over the parts' totals, so no file is rewritten. Readers
map the files into memory and touch only the documents asked for.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraprofile.llm.files import open_store, whole_file
from terraprofile.llm.tokens import Encoder, process_wide

READ_DOCS = 20_000
BATCH_BYTES = 16_000_000


@dataclass(frozen=True)
class TokenFolder:
    """Where the files are, the width of an id in bytes, and (part, documents, ids, base) per part."""

    uri: str
    width: int
    parts: tuple[tuple[int, int, int, int], ...]


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> TokenFolder:
    """Encode every text, append ``end_id`` and write the files in ascending id order.

    Null texts are empty (only the end id). Rows without id can't be addressed and raise; rows
    that repeat an id are documents of their own, ordered by text. An empty table gives no part.
    """

    def write(batches):
        store, root = open_store(uri)
        coder = process_wide(Encoder, tokenizer)
        width = 2 if coder.size <= 1 << 16 else 4
        part, offsets, ids = TaskContext.get().partitionId(), [0], []
        name = f"{root}/part-{part:06d}"
        with whole_file(store, f"{name}.ids") as out:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if doc is None:
                        raise ValueError("a document without id has no place in the files")
                    found = np.frombuffer(coder.encode(text.as_py()), "<u4")
                    out.write((found if width == 4 else found.astype("<u2")).tobytes())
                    out.write(int(end_id).to_bytes(width, "little"))
                    offsets.append(offsets[-1] + len(found) + 1)
                    ids.append(doc)
        for ending, values in (("off", offsets), ("doc", ids)):
            with whole_file(store, f"{name}.{ending}") as out:
                out.write(np.array(values, "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(ids)], "ids": [offsets[-1]], "width": [width]})

    ordered = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).repartitionByRange("i").sortWithinPartitions("i", "t")
    # one row of four numbers per part comes back
    rows = sorted(ordered.mapInArrow(write, "part long, docs long, ids long, width long").collect())
    bases = np.cumsum([0, *(r.ids for r in rows)])
    parts = tuple((r.part, r.docs, r.ids, int(b)) for r, b in zip(rows, bases) if r.docs)
    return TokenFolder(uri, max((r.width for r in rows), default=2), parts)


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where the store is a mounted folder, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.empty(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, folder: TokenFolder, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids before it in the whole corpus), n_tokens, ids_crc32, and ids as 32-bit integers."""
    tasks = [(p, base, a, min(a + READ_DOCS, n)) for p, n, _, base in folder.parts for a in range(0, n, READ_DOCS)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def read(batches):
        store, root = open_store(folder.uri)
        for batch in batches:
            for part, base, first, end in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"{root}/part-{part:06d}"
                ids = _mapped(store, f"{name}.ids", f"<u{folder.width}")
                offsets, docs = _mapped(store, f"{name}.off", "<i8"), _mapped(store, f"{name}.doc", "<i8")
                rows, held = [], 0
                for k in range(first, end):
                    own = ids[offsets[k] : offsets[k + 1]].astype("<u4").tobytes()
                    rows.append((int(docs[k]), base + int(offsets[k]), len(own) // 4, zlib.crc32(own), own))
                    held += len(own) if with_ids else 40
                    if held >= BATCH_BYTES or k + 1 == end:
                        columns = list(zip(*rows))
                        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]
                        kinds = [pa.int64()] * 4 + [pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(names)], kinds)], names=names)
                        rows, held = [], 0

    plan = spark.createDataFrame(tasks, "part long, base long, first long, last long")
    return plan.mapInArrow(read, schema)
