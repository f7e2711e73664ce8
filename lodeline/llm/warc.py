"""WARC archives: written by tasks, read back by tasks over byte ranges.

Every record is a gzip member of its own. A reader needs no index: it gets a range of bytes, scans
it for the gzip magic, accepts a place only if a WARC header can be decoded there, and owns the
records that start inside its range, reading past its end to finish the last one. So a large
archive is read by as many tasks as it has ranges, and every record exactly once.

Archives live on storage that all executors share. Tasks open them through ``pyarrow.fs``, which
knows local and mounted folders, HDFS and object stores by their URI. A writing task names its
files by its attempt and reports them as rows; only files in the stored list of the attempts that
counted are read, so lost or repeated tasks leave nothing behind that is seen.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import map_arrow
from lodeline.session import stored, work_dir

MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT = 100
FILE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
READ = 1 << 20
STEP = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _clean(value: str) -> str:
    """A header value: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return pack.compress(raw) + pack.flush()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http_length(self) -> int:
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else 0


def _headers(data: bytes) -> dict[str, str] | None:
    """The fields of a whole WARC header at the start of ``data``; None if there is none."""
    head, end, _ = data.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogatepass")
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


class _Window:
    """Reads of a file through one buffer, so that stepping from record to record reads each byte once."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; fewer where the buffer ends, none only at the end of the file."""
        if not self.at <= at < self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(READ)
        return self.data[at - self.at : at - self.at + n]

    def find(self, at: int, end: int) -> int:
        """The first magic that starts in bytes ``at`` to ``end``, or -1."""
        while at < end:
            part = self.get(at, READ)
            while len(part) < len(MAGIC) and (more := self.get(at + len(part), len(MAGIC) - len(part))):
                part += more
            hit = part.find(MAGIC)
            if hit >= 0:
                return at + hit if at + hit < end else -1
            if len(part) < len(MAGIC):
                return -1
            at += len(part) - len(MAGIC) + 1  # the magic may cross the end of the buffer
        return -1


def _unpack(window: _Window, at: int, enough) -> tuple[bytes, int] | None:
    """A gzip member from ``at`` on, unpacked until ``enough`` says so or it ends, and where it ends; None if it is none."""
    unpack, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not unpack.eof and not enough(out):
            data = window.get(pos, STEP)
            if not data:
                break
            out += unpack.decompress(data)
            pos += len(data)
    except zlib.error:
        return None
    return bytes(out), pos - len(unpack.unused_data) if unpack.eof else -1


def _record_at(window: _Window, at: int) -> Record | None:
    """The whole record that starts at ``at``; None if no WARC header can be decoded there."""
    other = lambda out: not b"WARC/1.".startswith(out[:7])
    seen = 0

    def enough(out: bytearray) -> bool:
        nonlocal seen
        since, seen = max(0, seen - 3), len(out)  # the end of the header may cross two pieces
        return other(out) or out.find(b"\r\n\r\n", since) >= 0

    head = _unpack(window, at, enough)
    fields = head and _headers(head[0])
    if not fields:
        if head and head[1] < 0 and head[0].startswith(b"WARC/1.") and b"\r\n\r\n" not in head[0]:
            raise EOFError(f"the header of the record at byte {at} has no end")
        return None
    raw, end = _unpack(window, at, lambda out: False) or (b"", -1)
    if end < 0:
        raise EOFError(f"the record at byte {at} has no end")
    body = raw.index(b"\r\n\r\n") + 4
    return Record(at, end, fields, raw[body : body + int(fields["content-length"])])


def records_in(file, start: int, end: int):
    """The records of an open archive that start in bytes ``start`` to ``end``, exclusive."""
    window = _Window(file)
    at = window.find(start, end)
    while at >= 0:
        found = _record_at(window, at)
        if found:
            yield found
        at = window.find(found.end if found else at + 1, end)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) under ``folder``; the stored list (path, bytes, records, starts).

    Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, those with the smallest page_id
    are responses and the others revisits of it; a null html is an empty payload. Rows without a
    page_id are written too and are always responses.
    """
    html = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    owner = (
        slim.where((F.col("n") >= MIN_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("owner"), F.max("page_id").alias("last"))
        .where("owner <> last")
    )
    owner = stored(owner.select(F.col("digest").alias("_digest"), "owner"), "owners")
    base = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    refers = F.when(F.col("page_id") != F.col("owner"), F.col("owner")).alias("refers_to")
    rows = base.join(owner, base["digest"] == owner["_digest"], "left").select("page_id", "url", "html", refers)

    def run(parts):
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, path, size, at_byte, k, done = None, "", 0, [], 0, []
        try:
            for part in parts:
                for page, url, text, ref in zip(*(part[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    if out is None:
                        path = f"{name}-{k}.warc.gz"
                        files, at = _open(path)
                        files.create_dir(at.rpartition("/")[0], recursive=True)
                        out, size, at_byte, k = files.open_output_stream(at, compression=None), 0, [], k + 1
                    data = record(page, url, text.encode("utf-8", "surrogatepass"), ref, date)
                    out.write(data)
                    at_byte.append(size)
                    size += len(data)
                    if size >= file_bytes:
                        out.close()
                        out = None
                        done.append((path, size, len(at_byte), at_byte))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((path, size, len(at_byte), at_byte))
        cols = [list(c) for c in zip(*done)] or [[], [], [], []]
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "bytes", "records", "starts"])

    return stored(rows.mapInArrow(run, "path string, bytes long, records long, starts array<long>"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of ``archives`` (path, bytes; starts if known), read by byte ranges.

    With ``starts``, the bytes at which records start, a range that holds more or fewer records
    than start in it fails the job.

    (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload). The digest of a
    response is computed from the payload read and must equal its header's; of a revisit, which has
    no payload (null), length and digest are those its headers give. Other record types are passed over.
    """
    total = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    begins = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    known = F.col("starts") if "starts" in archives.columns else F.lit(None).cast("array<long>")

    def one(begin):
        end = F.least(begin + split_bytes, F.col("bytes"))
        held = F.size(F.filter(known, lambda x: (x >= begin) & (x < end)))
        return F.struct(begin.alias("start"), end.alias("end"), F.when(known.isNotNull(), held).alias("records"))

    ranges = archives.where("bytes > 0").select("path", F.explode(F.transform(begins, one)).alias("r")).select("path", "r.*")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def page_of(value: str) -> int | None:
        found = value.strip("<>").removeprefix(URN)
        return int(found) if found else None

    def run(part: pa.RecordBatch):
        for path, start, end, records in zip(*(part[c].to_pylist() for c in ("path", "start", "end", "records"))):
            files, at = _open(path)
            rows, held, n = [], 0, 0
            with files.open_input_file(at) as file:
                for r in records_in(file, start, end):
                    h, n = r.headers, n + 1
                    kind, said = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha256:")
                    if kind == "response":
                        payload = r.payload
                        if (got := hashlib.sha256(payload).hexdigest()) != said:
                            raise ValueError(f"{path}: the payload at byte {r.start} has digest {got}, its header says {said}")
                    elif kind == "revisit":
                        payload = None
                    else:
                        continue
                    refers = page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None
                    rows.append((page_of(h["warc-record-id"]), h.get("warc-target-uri"), kind, refers, r.http_length, said, payload))
                    held += len(payload or b"")
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
            if records is not None and n != records:
                raise ValueError(f"{path}: {n} records start in bytes {start} to {end}, {records} were written there")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return map_arrow(ranges.repartition(max(1, min(int(total), 20_000))), run, ddl)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, work_dir(spark, "warc")), split_bytes)
