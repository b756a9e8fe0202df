"""WARC records in ZIP archives: round trips, ZIP64 directories, damage."""

import base64
import hashlib
import io
import struct
import zipfile

import pytest

from tests.llm.cases import FOLDER, sample
from tradeweave.llm import archives
from tradeweave.llm.queries import op4_zip_warc

TYPES = "page_id long, url string, html string"


def expected(pages, least=0):
    best = {}
    for i, html in pages:
        body = (html or "").encode()
        best[body] = max(best.get(body, i), i)
    out = {}
    for i, html in pages:
        body = (html or "").encode()
        own = best[body] == i or len(body) < least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out[i] = (len(body), digest, "response" if own else "revisit", None if own else best[body])
    return out


def got(df):
    columns = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    return {r["page_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_whole_table(spark):
    assert got(op4_zip_warc(spark, FOLDER)) == expected(sample("pages", "page_id, html"))


@pytest.mark.parametrize("least", [0, 5])
def test_copies_and_awkward_pages(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 2000)  # several archives to a task
    bodies = [None, "", "same", "same", "long " * 500, "long " * 500, "é\r\n\r\nWARC/1.1", "same"] * 20
    pages = list(enumerate(bodies))
    rows = [(i, None if i % 3 else f"http://h/{i} x", html, "clash") for i, html in pages]
    df = spark.createDataFrame(rows, TYPES + ", digest string").repartition(5)
    listed = archives.write_archives(df, f"file://{tmp_path}/pages", least)
    assert listed.agg({"records": "sum"}).first()[0] == len(pages)
    back = archives.read_archives(listed)
    assert got(back) == expected(pages, least)
    for r in back.where("record_type = 'response'").collect():
        assert bytes(r["payload"]) == (bodies[r["page_id"]] or "").encode()


def test_empty_table(spark, tmp_path):
    listed = archives.write_archives(spark.createDataFrame([], TYPES), str(tmp_path))
    assert listed.collect() == [] and archives.read_archives(listed).collect() == []


def members_of(data):
    return archives.directory(io.BytesIO(data), len(data))


def test_directory_of_other_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "first")
        z.writestr("ä.txt", "second" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it"
    data = out.getvalue()
    first, second = members_of(data)
    assert (first.name, second.name, second.size) == ("a.txt", "ä.txt", 600)
    start = archives.data_start(io.BytesIO(data), first)
    assert data[start : start + first.size] == b"first"
    with pytest.raises(ValueError, match="compressed"):
        archives.data_start(io.BytesIO(data), second)


def test_zip64_directory():
    """A directory whose numbers stand in the ZIP64 records only."""
    name, body = b"m", b"stored"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(body), len(body), 1, 0) + name
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    full = 0xFFFFFFFF
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, full, full, 1,
                        len(extra), 0, 0, 0, 0, full) + name + extra
    at = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, full, full, 0)
    data = local + body + entry + end64 + locator + end
    (member,) = members_of(data)
    assert member == archives.Member("m", 0, 6, 6, 0)
    start = archives.data_start(io.BytesIO(data), member)
    assert data[start : start + 6] == body


def test_damage_is_noticed():
    with pytest.raises(ValueError, match="no ZIP directory"):
        members_of(b"not an archive at all, only text")
    good = archives.record(1, "u", b"payload", 7, archives.bare_digest(b"payload"), None)
    assert archives.parse_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        archives.parse_record(good.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))
