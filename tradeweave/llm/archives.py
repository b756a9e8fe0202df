"""Web pages in WARC records, packaged in ZIP archives that are read in place.

An archive is a ZIP file of stored (not compressed) members: ``archive/data.warc.gz``, a gzip
member per record, and ``indexes/index.cdxj``, a line per record with its place. The reader
parses the ZIP directory at the file's end (the ZIP64 one too), finds the two members, and reads
each record's range of bytes from the file; nothing is unpacked to disk and no archive is read
whole.

Of pages with equal payloads one is written in full (response), the rest refer to it (revisit).
The choice is an aggregate by payload digest and a join, so a payload that a third of all pages
share is neither gathered nor sent to one task: Spark splits its rows.

Files lie in a folder that all executors share, by default below spark.checkpoint.dir. A task's
files carry its attempt in their names, and only those of attempts that succeeded are listed, so
a lost executor leaves at most files that nobody reads.

Cases: a null html is an empty payload; a null or repeated page_id is kept, and rows that repeat
the response's page_id are responses too; null urls are written as empty; an empty table gives no
archive and an empty result; other columns are not read.
"""

import base64
import binascii
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.plans.ordering import checkpoint_folder, durable

ARCHIVE_BYTES = 8 << 20  # an archive is closed when its records pass this
READ_BYTES = 4 << 20  # neighbouring records are read together up to this
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"  # WARC-Date of pages whose time of capture is unknown
PAGE = "urn:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by WARC 1.1

# signatures and sizes fixed by the ZIP format
END, END_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
COMMENT_MOST = 65_535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header_at: int


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder or file that all executors share, and its path there."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(("s3" if scheme == "s3a" else scheme) + ":" + rest)


# --- the ZIP directory


def _at(file: BinaryIO, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) < size:
        raise ValueError("the archive is cut short")
    return data


def directory(file: BinaryIO, size: int) -> list[Member]:
    """The members of a ZIP file, from its central directory."""
    tail_at = max(0, size - END_SIZE - COMMENT_MOST)
    tail = _at(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0:  # the signature may also stand in the comment
        if len(tail) >= at + END_SIZE and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP directory at the end of the file")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == FULL16 or FULL32 in (length, start):
        locator_at = tail_at + at - LOCATOR_SIZE
        locator = _at(file, locator_at, LOCATOR_SIZE) if locator_at >= 0 else b""
        if locator[:4] == LOCATOR:
            record = _at(file, struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
            if record[:4] != END64:
                raise ValueError("the ZIP64 directory is not where it should be")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    data, members, at = _at(file, start, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("the ZIP directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full, named, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
        header_at = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + ENTRY_SIZE : at + ENTRY_SIZE + named]
        more = data[at + ENTRY_SIZE + named : at + ENTRY_SIZE + named + extra]
        full, packed, header_at = _wide(more, full, packed, header_at)
        members.append(
            Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, full, header_at)
        )
        at += ENTRY_SIZE + named + extra + comment
    return members


def _wide(extra: bytes, full: int, packed: int, header_at: int) -> list[int]:
    """The numbers of an entry, those that do not fit from its ZIP64 field."""
    values, at = [full, packed, header_at], 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for k, value in enumerate(values):
                if value == FULL32:
                    values[k] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + length
    return values


def data_start(file: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin in the file."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; ranges of it cannot be read")
    header = _at(file, member.header_at, LOCAL_SIZE)
    if header[:4] != LOCAL:
        raise ValueError(f"{member.name} is not where the directory says")
    return member.header_at + LOCAL_SIZE + sum(struct.unpack_from("<HH", header, 26))


# --- records


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(lines: dict[str, str]) -> bytes:
    return "".join(f"{name}: {value}\r\n" for name, value in lines.items()).encode() + b"\r\n"


def record(page: int | None, url: str, payload: bytes | None, size: int, digest: str, first: int | None) -> bytes:
    """A response with its payload, or (payload None) a revisit of the page ``first``."""
    head = b"HTTP/1.1 200 OK\r\n" + _headers(
        {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(size)}
    )
    block = head if payload is None else head + payload
    lines = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": f"<{PAGE}{'' if page is None else page}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if payload is None:
        lines |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{PAGE}{'' if first is None else first}>"}
    return b"WARC/1.1\r\n" + _headers(lines) + block + b"\r\n\r\n"


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the rest of a message after its first line."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}, data[end + 4 :]


def _page_of(uri: str) -> int | None:
    number = uri.strip("<>").removeprefix(PAGE)
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """A record's page, url, kind, payload and so on; a damaged payload raises."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head, rest = _parsed(data)
    block = rest[: int(head["content-length"])]
    http, payload = _parsed(block)
    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    size = int(http["content-length"])
    if kind == "response" and (len(payload) != size or bare_digest(payload) != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    return {
        "page_id": _page_of(head["warc-record-id"]),
        "url": head["warc-target-uri"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_of(head["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


# --- writing


class _Archive:
    def __init__(self) -> None:
        self.data, self.index, self.count = io.BytesIO(), [], 0

    def add(self, page: int | None, url: str, digest: str, kind: str, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member
        packed = packer.compress(data) + packer.flush()
        line = {"url": url, "digest": digest, "type": kind, "offset": self.data.tell(), "length": len(packed), "filename": DATA}
        self.index.append(f"{PAGE}{'' if page is None else page} {json.dumps(line)}\n")
        self.data.write(packed)
        self.count += 1

    def packaged(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            # the ZIP64 form, as archives may be larger than the plain one can say
            for name, data in ((DATA, self.data.getvalue()), (INDEX, "".join(self.index).encode())):
                with package.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                    member.write(data)
        return out.getvalue()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and lists the archives: (path, records, bytes).

    Of records with equal payloads of ``least`` bytes or more, the one with the largest page_id
    is a response and the others revisit it; smaller ones are all responses.
    """
    folder = folder or f"{checkpoint_folder(pages.sparkSession)}/archives-{uuid.uuid4()}"
    rows = pages.select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    chosen = rows.groupBy("digest").agg(F.max("page_id").alias("first"))
    own = (F.octet_length("payload") < least) | F.col("page_id").eqNullSafe(F.col("first"))
    told = rows.join(chosen, "digest").select(
        "page_id",
        "url",
        "digest",
        F.octet_length("payload").cast("long").alias("size"),
        F.when(own, F.col("payload")).alias("payload"),  # a revisit needs none
        "first",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        archive, number = _Archive(), 0

        def close() -> pa.RecordBatch:
            nonlocal archive, number
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.zip"
            data = archive.packaged()
            with files.open_output_stream(f"{root}/{name}") as file:
                file.write(data)
            row = [{"path": f"{folder}/{name}", "records": archive.count, "bytes": len(data)}]
            archive, number = _Archive(), number + 1
            return pa.RecordBatch.from_pylist(row)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "digest", "size", "payload", "first")]
            for k in range(batch.num_rows):
                page, url, sha, size, payload, first = (c[k].as_py() for c in columns)
                digest = base64.b32encode(binascii.unhexlify(sha)).decode()
                kind = "revisit" if payload is None else "response"
                archive.add(page, url, digest, kind, record(page, url, payload, size, digest, first))
                if archive.data.tell() >= ARCHIVE_BYTES:
                    yield close()
        if archive.count:
            yield close()

    return durable(told.mapInArrow(run, "path string, records long, bytes long"))


# --- reading

RECORD_TYPES = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def records(path: str) -> Iterator[dict]:
    """The records of one archive, in the order of its index."""
    files, place = filesystem(path)
    size = files.get_file_info(place).size
    with files.open_input_file(place) as file:
        members = {m.name: m for m in directory(file, size)}
        starts: dict[str, int] = {}
        for name in sorted(n for n in members if n.startswith("indexes/") and n.endswith(".cdxj")):
            lines = _at(file, data_start(file, members[name]), members[name].size).decode().splitlines()
            places = [json.loads(line.split(" ", 1)[1]) for line in lines if line]
            for run in _neighbours(places):
                member = run[0]["filename"]
                if member not in starts:
                    starts[member] = data_start(file, members[member])
                begin = run[0]["offset"]
                length = run[-1]["offset"] + run[-1]["length"] - begin
                data = memoryview(_at(file, starts[member] + begin, length))
                for x in run:
                    at = x["offset"] - begin
                    yield parse_record(zlib.decompress(data[at : at + x["length"]], 31))


def _neighbours(places: list[dict]) -> Iterator[list[dict]]:
    """Records that lie side by side, up to READ_BYTES together."""
    run: list[dict] = []
    for x in places:
        if run and (
            x["filename"] != run[-1]["filename"]
            or x["offset"] != run[-1]["offset"] + run[-1]["length"]
            or x["offset"] + x["length"] - run[0]["offset"] > READ_BYTES
        ):
            yield run
            run = []
        run.append(x)
    if run:
        yield run


def read_archives(listed: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of the archives whose ``path`` is listed, checked against their digests."""
    names = [x.split()[0] for x in RECORD_TYPES.split(", ")]
    types = RECORD_TYPES if payloads else RECORD_TYPES.rsplit(", ", 1)[0]
    kept = names if payloads else names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in kept])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for x in records(path):
                    held.append({n: x[n] for n in kept})
                    size += len(x["payload"] or b"") if payloads else 100
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return listed.select("path").mapInArrow(run, types)
