"""WARC archives: writer, and a Python data source that reads them back.

Records are gzip members of their own (one after the other in ``part-N.warc.gz``).
The source plans one partition per archive, takes predicates on record type and on
headers at planning time, decodes a record's headers first, and decompresses a
payload only when the record is wanted and payloads are asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from terraprofile.llm.files import open_store, whole_file

READ_BYTES = 1 << 18
BATCH_BYTES = 8_000_000
LEVEL = 1
# headers that are columns of their own, in the file's spelling (fixed values of the format)
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
}
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """One record as a gzip member; line ends inside header values become spaces."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(str(v).split())}" for k, v in headers.items()), f"Content-Length: {len(payload)}", "", ""]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode()) + squeeze.compress(payload) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 1000) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, record_type and refers_to.

    Payloads are equal when length, SHA-1 and SHA-256 are. Of equal payloads of ``least`` bytes or
    more the largest id is the response; the others, and smaller ones never, revisit it. Null html is
    the empty payload. Rows that repeat the largest id are responses each; a row without id revisits
    a group's response, or is one if its group has no id. Only digests are grouped, never payloads.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    size, large = F.octet_length(payload).cast("long"), F.octet_length(payload) >= least
    own = pages.select(
        F.col(id_col).alias("page_id"), F.col("url"), payload.alias("payload"), size.alias("payload_bytes"), F.sha1(payload).alias("payload_digest"), F.when(large, F.sha2(payload, 256)).alias("_key")
    )
    groups = own.where("_key is not null").groupBy("payload_bytes", "payload_digest", "_key").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = own.join(groups, ["payload_bytes", "payload_digest", "_key"], "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def write_warc(records: DataFrame, uri: str) -> int:
    """Write records (as from ``with_revisits``) below ``uri``; returns their number.

    A revisit has no payload. Each task writes one archive, which appears when complete.
    """

    def write(batches):
        store, root = open_store(uri)
        n = 0
        with whole_file(store, f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz") as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(batch.num_columns - 1)):
                    page_id, url, size, digest, kind, refers, payload = row
                    headers = {"WARC-Type": kind, "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": size}
                    headers |= {"WARC-Record-ID": page_id} if page_id is not None else {}
                    headers |= {"WARC-Target-URI": url} if url is not None else {}
                    headers |= {"WARC-Refers-To": refers, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if refers is not None else {}
                    out.write(record(headers, payload.as_py() if kind == "response" else b""))
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    columns = records.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))
    return columns.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


class _Members:
    """The gzip members of an archive, read in bounded steps."""

    def __init__(self, stream):
        self.stream, self.rest, self.unzip, self.text = stream, b"", None, bytearray()

    def begin(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
        if not self.rest:
            return False
        self.unzip, self.text = zlib.decompressobj(31), bytearray()
        return True

    def more(self, limit: int = READ_BYTES) -> bool:
        """Decompress up to ``limit`` further bytes of the member; False if it has ended."""
        while not self.unzip.eof:
            data = self.unzip.unconsumed_tail or self.rest or self.stream.read(READ_BYTES)
            if not data:
                raise ValueError("an archive ends inside a record")
            self.rest = b""
            found = self.unzip.decompress(data, limit)
            if self.unzip.eof:
                self.rest = self.unzip.unused_data
            if found:
                self.text += found
                return True
        return False

    def skip(self) -> None:
        """Find the end of the member without keeping what is in it."""
        while self.more():
            self.text.clear()


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)


def read_archive(stream, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records whose headers satisfy ``wanted``, with their payloads if asked for."""
    members = _Members(stream)
    while members.begin():
        while (end := members.text.find(b"\r\n\r\n")) < 0 and members.more(2048):
            pass
        if end < 0:
            raise ValueError("a record without header")
        headers = parse_headers(bytes(members.text[:end]))
        if not wanted(headers):
            members.skip()
            continue
        payload = None
        if payloads:
            while members.more():
                pass
            size = int(headers["Content-Length"])
            payload = bytes(members.text[end + 4 : end + 4 + size])
            if len(payload) < size:
                raise ValueError("a payload is shorter than its header says")
        else:
            members.skip()
        yield headers, payload


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.payloads = options.get("payloads", "true").lower() != "false"
        self.equal: dict[str, set[str]] = {}
        if "record_type" in options:
            self.equal["record_type"] = set(options["record_type"].split(","))

    def pushFilters(self, filters):
        """Equality and membership on header columns are checked before a payload is touched."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_bytes":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if None not in values:
                    self.equal[name] = self.equal.get(name, values) & values
                    continue
            yield f

    def partitions(self) -> list[Archive]:
        store, root = open_store(self.uri)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".warc.gz")]

    def read(self, partition: Archive | None):
        if partition is None:
            return
        store, _ = open_store(self.uri)
        equal = {HEADERS[k]: v for k, v in self.equal.items()}
        if "WARC-Payload-Digest" in equal:
            equal["WARC-Payload-Digest"] = {f"sha1:{v}" for v in equal["WARC-Payload-Digest"]}

        def wanted(headers):
            return all(headers.get(k) in v for k, v in equal.items())

        names, rows, held = [*HEADERS, "payload"], [], 0
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        with store.open_input_stream(partition.path, compression=None) as stream:
            for headers, payload in read_archive(stream, wanted, self.payloads):
                values = [headers.get(h) for h in HEADERS.values()]
                values[4] = values[4].removeprefix("sha1:") if values[4] else None
                values[5] = int(values[5]) if values[5] is not None else int(headers["Content-Length"])
                rows.append((*values, payload))
                held += 200 + len(payload or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options ``record_type`` (comma-separated) and ``payloads``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    """The records of all archives below ``uri``.

    Filters on the result reach the reader; the session setting that allows it is switched on here.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(uri)
