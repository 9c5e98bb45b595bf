"""WARC archives: a writer with one gzip member a record, and a sequential reader.

Writing: payloads are hashed; of records with equal payloads of at least `least_bytes` bytes the one with the
smallest id is a response, the others are revisits of it, without payload. Each task writes archives of bounded size
to the shared folder and hands on their names; archives of attempts that failed are never named and never read.

Reading: an archive is a stream that is inflated piece by piece (`records`): a gzip member is a record; its header
block gives the length of its content, which is framed by it; digests of block and payload are verified. Memory holds
one record.

Defined results
* null payloads count as empty. Payloads below `least_bytes` are always responses.
* null ids come after all others; of rows that repeat id and payload each is a response if its id is the smallest.
* null addresses are written as an empty target. Line breaks in an address are percent-encoded.
* an empty table writes no archives and gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import shared_dir, written

#: Bytes of compressed records after which a task begins another archive, and that a reader takes in at once.
ARCHIVE, PIECE = 64 << 20, 1 << 16
#: Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _block(first: str, pairs: list[tuple[str, str]]) -> bytes:
    return "".join([first, *(f"{k}: {v}\r\n" for k, v in pairs), "\r\n"]).encode()


def record_bytes(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "2024-01-01T00:00:00Z", refers_url: str | None = None, copy: int = 0) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, with the length of the payload it leaves out.

    A record is named by id, address and payload; `copy` numbers rows that repeat all three.
    """
    http = _block("HTTP/1.1 200 OK\r\n", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    content = http if revisit else http + payload
    address = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    named = lambda i, u, c=0: f"<urn:x-page:{'null' if i is None else i}:{hashlib.sha256(f'{u} {digest}'.encode()).hexdigest()[:32]}{f':{c}' if c else ''}>"
    pairs = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", named(id_, url, copy)), ("WARC-Date", date), ("WARC-Target-URI", address(url)),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(content).hexdigest()}"),
    ]
    if revisit:
        pairs += [("WARC-Refers-To", named(refers_to, refers_url)), ("WARC-Refers-To-Target-URI", address(refers_url)), ("WARC-Profile", PROFILE)]
    head = _block(VERSION.decode(), [*pairs, ("Content-Length", str(len(content)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + content + END) + packer.flush()


class _Stream:
    """The inflated bytes of one gzip member after another; only what a record asks for is inflated and held."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.rest, self.member, self.held = raw, b"", None, bytearray()

    def begin(self) -> bool:
        """Start the next member; False at the end of the archive."""
        if not self.rest:
            self.rest = self.raw.read(PIECE)
        self.member = zlib.decompressobj(31) if self.rest else None
        self.held.clear()
        return self.member is not None

    def _more(self) -> bool:
        if self.member.eof:
            return False
        if not self.rest and not self.member.unconsumed_tail:
            self.rest = self.raw.read(PIECE)
            if not self.rest:
                raise ValueError("the archive ends within a record")
        self.held += self.member.decompress(self.member.unconsumed_tail or self.rest, PIECE)
        if self.member.eof:
            self.rest = self.member.unused_data
        elif not self.member.unconsumed_tail:
            self.rest = b""
        return True

    def upto(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                raise ValueError("a header block isn't ended")
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("content is shorter than its stated length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def end(self) -> bytes:
        while self._more():
            pass
        return bytes(self.held)


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def records(raw: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order. Wrong framing or digests raise ValueError."""
    stream = _Stream(raw)
    while stream.begin():
        block = stream.upto(END)
        if not block.startswith(b"WARC/1."):
            raise ValueError("no record begins here")
        headers = _fields(block)
        content = stream.take(int(headers["content-length"]))
        if stream.end() != END:
            raise ValueError("a record isn't ended where its length says")
        digest = headers.get("warc-block-digest")
        if digest and digest != f"sha256:{hashlib.sha256(content).hexdigest()}":
            raise ValueError(f"block digest of {headers.get('warc-record-id')} is wrong")
        http, payload = {}, content
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = content.partition(END)
            http = _fields(head)
        digest = headers.get("warc-payload-digest")
        if digest and headers["warc-type"] == "response":
            if digest != f"sha256:{hashlib.sha256(payload).hexdigest()}" or len(payload) != int(http.get("content-length", len(payload))):
                raise ValueError(f"payload of {headers.get('warc-record-id')} is wrong")
        yield Record(headers, http, payload)


#: Names that Spark's paths have for stores which Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs", "wasbs": "abfs"}


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the place in it; DBFS paths are looked for under their mount."""
    scheme, mark, rest = folder.partition("://")
    if mark and scheme in SCHEMES:
        folder = f"{SCHEMES[scheme]}://{rest}"
    elif folder.startswith("dbfs:/"):
        folder = "/dbfs/" + folder[6:].lstrip("/")
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows; one row an archive: path, records, bytes. Payloads are moved once, by digest, to meet their response's id."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n"))
    lead = F.min_by(F.struct("id", "url"), F.struct(F.col("id").isNull(), "id", "url")).alias("lead")
    firsts = slim.where(F.col("n") >= least_bytes).groupBy("digest").agg(lead, F.count(F.lit(1)).alias("k")).where("k > 1")
    firsts = firsts.select(F.upper("digest").alias("key"), F.col("lead.id").alias("first"), F.col("lead.url").alias("first_url"))
    slim = _numbered(slim)
    rows = slim.join(firsts.hint("merge"), F.upper("digest") == F.col("key"), "left").select("id", "url", "payload", "digest", "copy", "first", "first_url", (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))
    _place(folder)[0].create_dir(_place(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        out, name, n, size = None, "", 0, 0

        def told() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for id_, url, text, digest, copy, first, first_url, revisit in zip(*batch.columns):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                data = record_bytes(id_.as_py(), url.as_py(), text.as_py().encode(), digest.as_py(), first.as_py(), revisit.as_py(), refers_url=first_url.as_py(), copy=copy.as_py())
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE:
                    yield told()
                    out = None
        if out is not None:
            yield told()

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def _numbered(slim: DataFrame) -> DataFrame:
    """Rows (id, url, payload, digest, n) with `copy`, the number of a row among those that repeat id, address and payload.

    Rows that repeat are counted, and so many are made from one of them: no order within a task is relied on.
    """
    key = F.concat_ws("\x01", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("="), "url"), F.lit("null")), "digest")
    several = written(slim.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key"), "repeated-pages")
    if several.isEmpty():
        return slim.withColumn("copy", F.lit(0))
    keyed = slim.withColumn("key", key)
    held = keyed.join(several, "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in slim.columns], F.count(F.lit(1)).cast("int").alias("copies"))
    held = held.select(*slim.columns, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return keyed.join(several, "key", "left_anti").select(*slim.columns, F.lit(0).alias("copy")).unionByName(held)


def read_archives(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """One row a record of the archives named in `path`: id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    payload_bytes and payload_digest are of the full payload; payload is null in revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        number = lambda x: None if x is None or x.startswith("<urn:x-page:null:") else int(x.split(":")[2])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _place(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as raw:
                    for r in records(raw):
                        h, revisit = r.headers, r.headers["warc-type"] == "revisit"
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), int(r.http["content-length"]), h["warc-payload-digest"].partition(":")[2], None if revisit else r.payload.decode()))
                        held += len(r.payload)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
    return archives.select(F.col(path_col).alias("path")).repartition(tasks).mapInArrow(run, schema)


def read_bytes(data: bytes) -> list[Record]:
    return list(records(io.BytesIO(data)))
