"""WARC archives from a table of payload chunks.

A payload becomes rows (record, chunk, data) of at most CHUNK bytes, each with the SHA-1 of the payload up to and
with that chunk, so that no step after the first holds more than one chunk of a record. Digests come from the last
chunks. Rows of a record stream in the order of their chunks into a compressed archive member of its own; archives
are read back by pieces, too, with the digest run along and checked.

Null pages count as empty payloads. Of equal payloads the one of the smallest page_id (null last, then the smallest
record number) is the response, the others revisit it; payloads below revisit_from bytes are all responses.
Repeated rows are records of their own. A null url leaves the target out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import hot_keys, lookup, stage, table, whole
from textpulse.llm.store import new_folder, new_name, opened

#: Bytes of a chunk, and of what is read from an archive at once.
CHUNK = 1 << 18
#: Rows are handed on when they hold so many bytes.
_FLUSH = 1 << 23
_SPACE = uuid.UUID("6f1d6c3e-6a55-4c2b-9a50-0d7f7f2f3a61")
_DATE = "2024-01-01T00:00:00Z"

_CHUNKS = "place long, page_id long, url string, chunk int, last boolean, bytes_so_far long, sha1_so_far binary, data binary"
_NAMES = [part.split()[0] for part in _CHUNKS.split(", ")]


def _split(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Chunk rows of (page_id, url, html). place numbers the records of a task."""
    task, place = TaskContext.get().partitionId() << 40, 0
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        pages, urls, texts = batch.columns
        for k in range(batch.num_rows):
            body = texts[k].as_buffer()
            view = memoryview(body) if body is not None else memoryview(b"")
            run, page, url = hashlib.sha1(), pages[k].as_py(), urls[k].as_py()
            for chunk, at in enumerate(range(0, max(len(view), 1), size)):
                data = view[at : at + size]
                run.update(data)
                end = at + len(data)
                rows.append((task + place, page, url, chunk, end == len(view), end, run.digest(), bytes(data)))
                held += len(data) + 64
                if held >= _FLUSH:
                    yield _rows(rows)
                    rows, held = [], 0
            place += 1
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def chunk_table(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html", size: int = CHUNK) -> DataFrame:
    """The chunked record table, staged: record, page_id, url, chunk, last, bytes_so_far, sha1_so_far, data."""
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), whole(body).alias("body"))
    return stage(rows.mapInArrow(partial(_split, size=size), _CHUNKS).withColumnRenamed("place", "record"), "chunks")


def plan_records(chunks: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Per record, staged: payload_bytes, payload_sha1, record_type, and for revisits the response's record and page."""
    ends = stage(
        chunks.filter("last").select("record", "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_sha1")),
        "payloads",
    )
    # Null pages sort last.
    first = F.min(F.struct(F.col("page_id").isNull().alias("absent"), F.col("page_id").alias("page"), F.col("record").alias("record")))
    long = F.col("payload_bytes") >= revisit_from
    groups = stage(ends.filter(long).groupBy("payload_sha1").agg(first.alias("first"), F.count("*").alias("n")), "payload-groups")
    several = groups.filter("n > 1").select("payload_sha1", "first")
    hot = hot_keys(groups, "payload_sha1", "n")
    joined = lookup(ends, "payload_sha1", several, hot, "record")
    revisit = F.col("first").isNotNull() & (F.col("first.record") != F.col("record")) & long
    return stage(
        joined.select(
            "record", "payload_bytes", "payload_sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            F.when(revisit, F.col("first.page")).alias("refers_to"), F.when(revisit, F.col("first.record")).alias("refers_record"),
        ),
        "records",
    )


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(record))}>"


def _clean(url: str) -> str:
    """A header holds one line: controls and blanks are written as escapes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def header(row: dict) -> tuple[bytes, bytes]:
    """The WARC header of a record and the HTTP header that begins its block."""
    size, revisit = row["payload_bytes"], row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _record_id(row["record"])),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", None if row["url"] is None else _clean(row["url"])),
        ("WARC-Payload-Digest", "sha1:" + base32(row["payload_sha1"])),
        ("X-Page-Id", row["page_id"]),
        ("X-Payload-Length", size),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(row["refers_record"])),
            ("X-Refers-To-Page-Id", row["refers_to"]),
        ]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + (0 if revisit else size))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode(), http


_PLANNED = ["payload_bytes", "payload_sha1", "record_type", "refers_to", "refers_record"]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One archive per task that has rows; a compressed member per record, fed chunk by chunk. The row before the
    chunks of a record holds its plan."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    system, path = opened(folder)
    name, records = new_name("pages", TaskContext.get().partitionId(), ".warc.gz"), 0
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        member, plan = None, {}
        for batch in chain([first], batches):
            for row in batch.to_pylist():
                if row["chunk"] < 0:
                    plan = {n: row[n] for n in _PLANNED}
                    continue
                response = plan["record_type"] == "response"
                if row["chunk"] == 0:
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    for part in header(row | plan):
                        out.write(member.compress(part))
                if response:
                    out.write(member.compress(row["data"]))
                if row["last"] if response else row["chunk"] == 0:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])


def write_archives(chunks: DataFrame, records: DataFrame, folder: str) -> DataFrame:
    """Write all records; returns the table of archives, staged: (file, records). Only archives that it names count."""
    # Plans and chunks are dealt together, by a number of parts that adaptive execution keeps. The partitions of a
    # join could be split where they are large, and with them the chunks of a record.
    plans = records.select("record", F.lit(-1).alias("chunk"), *_PLANNED)
    rows = chunks.select("record", "page_id", "url", "chunk", "last", "data").unionByName(plans, allowMissingColumns=True)
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "record").sortWithinPartitions("record", "chunk")
    return stage(dealt.mapInArrow(partial(_write, folder=folder), "file string, records long"), "archives")


class _Member:
    """Plain bytes of a file of compressed members, read by pieces."""

    def __init__(self, file: pa.NativeFile, piece: int = CHUNK):
        self.file, self.piece, self.held, self.packed = file, piece, b"", b""
        self.plain = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.plain.eof:
            self.packed, self.plain = self.plain.unused_data, zlib.decompressobj(31)
        elif self.plain.unconsumed_tail:
            self.packed = self.plain.unconsumed_tail
        else:
            self.packed = b""
        if not self.packed:
            self.packed = self.file.read(self.piece)
        if not self.packed:
            return False
        self.held += self.plain.decompress(self.packed, self.piece)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is taken off as well; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        got, self.held = self.held[:at], self.held[at + len(mark) :]
        return got

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.more():
                raise ValueError("an archive ends within a record")
            got, self.held = self.held[:size], self.held[size:]
            size -= len(got)
            if got:
                yield got


def read_records(file: pa.NativeFile) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(headers, payload bytes, payload SHA-1) of each record; a response's payload is hashed as it streams by."""
    source = _Member(file)
    while (head := source.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not the head of a record: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        http = source.until(b"\r\n\r\n")
        run, size = hashlib.sha1(), 0
        for part in source.take(int(fields["Content-Length"]) - len(http) - 4):
            run.update(part)
            size += len(part)
        if b"".join(source.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, size, run.digest()


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, path = opened(folder)

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows = []
            with system.open_input_stream(f"{path}/{name}", compression=None) as file:
                for fields, size, digest in read_records(file):
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (base32(digest) != told or size != int(fields["X-Payload-Length"])):
                        raise ValueError(f"payload of page {fields.get('X-Page-Id')} differs from its digest")
                    rows.append((number(fields.get("X-Page-Id")), int(fields["X-Payload-Length"]), told, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id"))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[p.split()[0] for p in _READ.split(", ")])


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Per record of the named archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    # One task per archive: a number is kept as it is, where rows of names alone would be gathered in one task.
    spread = archives.select("file").repartition(max(1, archives.count()))
    return spread.mapInArrow(partial(_read, folder=folder), _READ)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "warc")
    chunks = chunk_table(table(spark, folder, "pages"))
    return read_archives(write_archives(chunks, plan_records(chunks), target), target)


