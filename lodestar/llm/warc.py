"""WARC archives as a Spark sink and source: one gzip member a record, read in sequence.

The sink writes the pages of a task to archives of its own, under names that no other attempt uses,
and lists the archives of the attempts that counted in a manifest when all tasks are done; what a lost
executor left behind is never read. The source gives each archive to one task, which reads it front to
back: members are inflated piece by piece, a record's block is framed by its Content-Length, and the
digests of block and payload are taken on the way and held against the record's own. Neither side
holds more than one record, and the source not even that unless its payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.session import BROADCAST_ROWS, cut

#: Bytes read or inflated at once, bytes after which a task begins another archive, bytes of a header at most.
PIECE, ARCHIVE, HEADER = 1 << 16, 1 << 30, 1 << 20
MANIFEST, SUFFIX = "_SUCCESS", ".warc.gz"
#: Fixed values of the format.
VERSION, REVISIT, EMPTY_LINE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n\r\n"

RECORD = (
    "archive string, offset bigint, record_type string, record_id string, date string, target_uri string, content_length bigint, page_id bigint, "
    "refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, problem string"
)


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1 of data."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def file_system(path: str):
    """(file system, path in it) of a folder's address, as any executor reaches it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


# ---- records --------------------------------------------------------------------------------------
def record_id(page_id: int | None, payload_digest: str, kind: str) -> str:
    """The same for the same page in every attempt."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, date: str) -> bytes:
    """A response with the page, or the revisit of the response that refers_to has, as one gzip member."""
    payload = (html or "").encode()
    own, kind = digest(payload), "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id, own, kind), "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        fields |= {"WARC-Refers-To": record_id(refers_to, own, "response"), "WARC-Profile": REVISIT, "X-Refers-To-Page": str(refers_to)}
    if page_id is not None:
        fields["X-Page"] = str(page_id)
    fields |= {"WARC-Payload-Digest": f"sha1:{own}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields.items())])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + EMPTY_LINE) + packer.compress(block) + packer.compress(EMPTY_LINE) + packer.flush()


class Broken(Exception):
    """The archive does not hold what the format or a record's own header says."""


class Members:
    """The gzip members of a stream, one after the other, inflated as they are read."""

    def __init__(self, stream):
        self.stream, self.raw, self.out, self.taken, self.inflate = stream, b"", b"", 0, None

    def open(self) -> int | None:
        """Begins the next member and gives its place in the stream; None at the end."""
        self.raw = self.raw or self.stream.read(PIECE)
        if not self.raw:
            return None
        self.inflate, self.out = zlib.decompressobj(31), b""
        return self.taken

    def piece(self) -> bytes:
        """Some more of the member; empty at its end."""
        while not self.out and not self.inflate.eof:
            self.raw = self.raw or self.stream.read(PIECE)
            if not self.raw:
                raise Broken("truncated")
            before = len(self.raw)
            try:
                self.out = self.inflate.decompress(self.raw, PIECE)
            except zlib.error as error:
                raise Broken("not gzip") from error
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.taken += before - len(self.raw)
        out, self.out = self.out, b""
        return out

    def until(self, mark: bytes) -> bytes:
        """What stands before mark, which is passed."""
        held = b""
        while (at := held.find(mark)) < 0:
            more = self.piece()
            if not more or len(held) > HEADER:
                raise Broken("header")
            held += more
        self.out = held[at + len(mark) :]
        return held[:at]

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes, piece by piece."""
        while n:
            more = self.piece()
            if not more:
                raise Broken("content length")
            self.out, more = more[n:], more[:n]
            n -= len(more)
            yield more

    def skip(self) -> None:
        """Passes over the rest of the member."""
        while self.piece():
            pass


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d+", value) else None


def _record(members: Members, keep: bool, out: dict) -> None:
    """Fills out from the member at hand; Broken if it is not as it should be."""
    head = members.until(EMPTY_LINE)
    if not head.startswith(b"WARC/1."):
        raise Broken("version")
    fields = _fields(head)
    out |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "date": fields.get("warc-date"), "target_uri": fields.get("warc-target-uri"), "page_id": _number(fields.get("x-page")), "refers_to": _number(fields.get("x-refers-to-page"))}
    length = _number(fields.get("content-length"))
    if length is None or length < 0:
        raise Broken("content length")
    out["content_length"] = length
    block, payload, size, kept, held = hashlib.sha1(usedforsecurity=False), hashlib.sha1(usedforsecurity=False), 0, [], b""
    http = fields.get("content-type", "").startswith("application/http")
    inside = not http
    for piece in members.exactly(length):
        block.update(piece)
        if not inside:
            held += piece
            at = held.find(EMPTY_LINE)
            if at < 0:
                if len(held) > HEADER:
                    raise Broken("http header")
                continue
            inside, piece, held = True, held[at + 4 :], held[: at + 4]
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if b"".join(members.exactly(4)) != EMPTY_LINE or members.piece():
        raise Broken("framing")
    base32 = lambda h: base64.b32encode(h.digest()).decode()
    said_block, said = fields.get("warc-block-digest"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    revisit = out["record_type"] == "revisit"
    if revisit:  # what its payload was is told by the headers alone
        size = _number(_fields(held).get("content-length")) if http else None
    out |= {"payload_bytes": size, "payload_digest": said if revisit else base32(payload), "payload": b"".join(kept) if keep and not revisit else None}
    if said_block not in (None, f"sha1:{base32(block)}"):
        raise Broken("block digest")
    if not revisit and said not in (None, base32(payload)):
        raise Broken("payload digest")


def records(stream, archive: str, keep: bool = True) -> Iterator[dict]:
    """The records of an archive in order, as dicts of RECORD's columns.

    problem is null, or says what is wrong with a record; the next member is read after it. After
    bytes that cannot be inflated the archive ends with that row. keep: whether payloads are given.
    """
    members, columns = Members(stream), [x.split()[0] for x in RECORD.split(", ")]
    while True:
        offset = members.open()
        if offset is None:
            return
        out = dict.fromkeys(columns) | {"archive": archive, "offset": offset}
        try:
            try:
                _record(members, keep, out)
            except Broken as error:
                out["problem"] = str(error)
                if out["problem"] not in ("truncated", "not gzip"):
                    members.skip()
        except Broken as error:
            out["problem"] = str(error)
        yield out
        if out["problem"] in ("truncated", "not gzip"):
            return


# ---- sink and source ------------------------------------------------------------------------------
@dataclass
class _Archives(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date, self.most = options["path"], options.get("date", "1970-01-01T00:00:00Z"), int(options.get("archivebytes", ARCHIVE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        done, out, written = _Archives(), None, 0
        try:
            for batch in iterator:
                for at in range(batch.num_rows):
                    page = {c: batch.column(c)[at].as_py() for c in ("page_id", "url", "html", "refers_to")}
                    if out is None or written > self.most:
                        if out is not None:
                            out.close()
                        done.names.append(f"pages-{uuid.uuid4().hex}{SUFFIX}")
                        out, written = system.open_output_stream(f"{folder}/{done.names[-1]}", compression=None), 0
                    member = record(**page, date=self.date)
                    written += len(member)
                    out.write(member)
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list) -> None:
        system, folder = file_system(self.path)
        with system.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write("".join(f"{n}\n" for m in messages if m for n in m.names).encode())

    def abort(self, messages: list) -> None:
        system, folder = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{folder}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.schema, self.strict = options["path"], schema, options.get("mode", "permissive").lower() == "failfast"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = file_system(self.path)
        listed = [i.base_name for i in system.get_file_info(fs.FileSelector(folder))]
        if MANIFEST in listed:
            with system.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as file:
                listed = file.read().decode().split()
        return [InputPartition(n) for n in sorted(listed) if n.endswith(SUFFIX)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, folder = file_system(self.path)
        types, rows, size = to_arrow_schema(self.schema), [], 0
        keep = "payload" in types.names
        with system.open_input_stream(f"{folder}/{partition.value}", compression=None) as stream:
            for row in records(stream, partition.value, keep):
                if self.strict and row["problem"]:
                    raise Broken(f"{row['problem']} at {row['offset']} of {partition.value}")
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) == 1_000 or size > 4 * PIECE:
                    yield pa.RecordBatch.from_pydict({f.name: [r[f.name] for r in rows] for f in types}, schema=types)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({f.name: [r[f.name] for r in rows] for f in types}, schema=types)


class WarcSource(DataSource):
    """spark.read.format("lodestar_warc").load(folder); write with the columns of `with_revisits`.

    Options: mode (permissive: column problem says what is wrong; failfast: an error), date and
    archiveBytes of what is written. A schema without payload reads no payload into memory.
    """

    @classmethod
    def name(cls) -> str:
        return "lodestar_warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


# ---- operators ------------------------------------------------------------------------------------
def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of pages with equal html of at least min_bytes bytes, all but
    that with the smallest page_id refer to it.

    pages: page_id (integer), url, html; other columns are ignored. A null html is empty. A page
    without a page_id refers to the others' smallest, if there is one; rows that repeat the smallest
    page_id refer to none. Equal is told by SHA-256. An empty table gives an empty one.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2("html", 256))))
    firsts = cut(rows.where("same is not null").groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1 and first is not null").select("same", "first"))
    if firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.join(firsts, "same", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the archives of pages to folder, an address that all executors reach."""
    pages.sparkSession.dataSource.register(WarcSource)
    with_revisits(pages, min_bytes).write.format("lodestar_warc").mode("append").option("date", date).save(folder)


def read_archives(spark: SparkSession, folder: str, payload: bool = True, mode: str = "permissive") -> DataFrame:
    """The records of all archives of folder; without payload that column is left out and never held."""
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("lodestar_warc").option("mode", mode)
    if not payload:
        reader = reader.schema(RECORD.replace(", payload binary", ""))
    return reader.load(folder)


def dangling(found: DataFrame) -> DataFrame:
    """(refers_to, payload_digest) of revisits without a response of that page and digest."""
    asked = found.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    told = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    return asked.join(told, ["refers_to", "payload_digest"], "left_anti")
