"""WARC records in ZIP-packaged archives: written from rows, read back by ranges without extraction.

An archive is a ZIP file with two stored members: a WARC file, in which each record is its own gzip member, and an index of
its records (id, offset, length). A reader finds the end-of-central-directory record (and ZIP64's, where numbers don't fit), the
central directory, the members' places, then the index, and reads the records' ranges.

Of rows with equal payloads of at least MIN_REVISIT bytes the one with the largest id is a response and the others revisit it;
rows of that same id are all responses. Payloads are equal if their lengths, their SHA-1 and another hash of 64 bits are. Smaller
payloads are all responses. Null payloads count as empty. A row without an id revisits, if its payload has a response. Archives
are written to the shared folder under names of their own, so a task that runs twice leaves an unused file and no wrong one; the
written manifest names the files that count. Very long payloads are written whole. An empty table gives no archives and an empty
result; columns other than the id, the URL and the payload are not read, and may have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, remove, shared_dir, slices, stored

MIN_REVISIT = 1_000
#: Bytes of records after which an archive is closed; bytes that a reader asks for at once.
ARCHIVE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
#: Archives that a task reads at most, on the average.
ARCHIVES = 8
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def record(id_: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record: a response, or a revisit if it refers to another."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{quote(id_)}>", f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{quote(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's named fields (in lower case), the head of its HTTP message, and the payload."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    http, _, payload = body[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """A ZIP file of stored members, in parts. zip64: with ZIP64's fields even where numbers are small."""
    at, central = 0, []
    for name, data in members:
        n, crc = name.encode(), zlib.crc32(data)
        wide = zip64 or len(data) >= _FULL32
        size = _FULL32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        yield struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(n), len(extra)) + n + extra
        yield data
        far = zip64 or at >= _FULL32
        more = (struct.pack("<QQ", len(data), len(data)) if wide else b"") + (struct.pack("<Q", at) if far else b"")
        more = struct.pack("<HH", 1, len(more)) + more if more else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(n), len(more), 0, 0, 0, 0, _FULL32 if far else at) + n + more)
        at += 30 + len(n) + len(extra) + len(data)
    directory = b"".join(central)
    yield directory
    wide = zip64 or at >= _FULL32 or len(members) >= _FULL16
    if wide:
        yield struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at)
        yield struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    n = _FULL16 if wide else len(members)
    yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, _FULL32 if wide else len(directory), _FULL32 if wide else at, 0)


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (start of data, length) of an archive's stored members, by its central directory."""
    tail_at = max(0, size - 22 - _FULL16)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature may occur in a comment
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<10xHII2x", tail, at)
    if n == _FULL16 or length == _FULL32 or start == _FULL32:
        locator = file.read_at(20, tail_at + at - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = file.read_at(56, struct.unpack_from("<8xQ", locator)[0])
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<32xQQQ", end)
    directory, at, found = file.read_at(length, start), 0, {}
    for _ in range(n):
        sig, method, packed, full, n_name, n_extra, n_comment, offset = struct.unpack_from("<I6xH8xIIHHH8xI", directory, at)
        if sig != 0x02014B50:
            raise ValueError("broken central directory")
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, held = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{held // 8}Q", extra, k + 4))
                full = next(wide) if full == _FULL32 else full
                packed = next(wide) if packed == _FULL32 else packed
                offset = next(wide) if offset == _FULL32 else offset
            k += 4 + held
        if method == 0:  # what is deflated can't be read by ranges
            local = file.read_at(30, offset)
            found[name] = (offset + 30 + sum(struct.unpack_from("<26xHH", local)), packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def records(file, size: int) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The parsed records of an archive, by its index; neighbouring ranges are read together."""
    where = members(file, size)
    (data, _), (index, n) = where[DATA], where[INDEX]
    entries = [json.loads(x) for x in file.read_at(n, index).splitlines()]
    k = 0
    while k < len(entries):
        first, end, j = entries[k]["offset"], entries[k]["offset"] + entries[k]["length"], k + 1
        while j < len(entries) and entries[j]["offset"] == end and end + entries[j]["length"] - first <= RANGE_BYTES:
            end += entries[j]["length"]
            j += 1
        held = file.read_at(end - first, data + first)
        for e in entries[k:j]:
            yield parse(gzip.decompress(held[e["offset"] - first : e["offset"] - first + e["length"]]))
        k = j


def open_input(path: str):
    system, at = pa.fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes a record a row to archives in folder (a URI that all executors share). Returns the stored manifest: path, records."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), text(url_col).alias("url"), text(payload_col).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= MIN_REVISIT
    same = ["digest", "size", "other"]
    rows = rows.withColumn("size", F.length("payload")).withColumn("other", F.xxhash64("payload"))
    seen = rows.where(large).groupBy(*same).agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL")
    rows = rows.join(seen.drop("n"), same, "left")
    other = F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response")).cast("string")
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", other.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        data, index, at = [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{base}/{name}") as out:
                for part in zip_bytes([(DATA, b"".join(data)), (INDEX, b"\n".join(index))], zip64):
                    out.write(part)
            return pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "records": pa.array([len(index)], pa.int64())})

        for batch in batches:
            for part in slices(batch):
                for id_, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    packed = gzip.compress(record("" if id_ is None else id_, url, payload, digest, refers_to), 1, mtime=0)
                    index.append(json.dumps({"id": id_, "offset": at, "length": len(packed)}).encode())
                    data.append(packed)
                    at += len(packed)
                    if at >= archive_bytes:
                        yield close()
                        data, index, at = [], [], 0
        if index:
            yield close()

    return stored(rows.mapInArrow(write, "path string, records bigint"))


def read_archives(manifest: DataFrame, *, id_col: str = "page_id", id_type: str = "bigint", payloads: bool = True, archives: int = ARCHIVES) -> DataFrame:
    """A row a record of the manifest's archives (about `archives` of them a task): id, url, record_type, payload_bytes and payload_digest of the full payload,
    refers_to, and with payloads the payload (null for a revisit). A response's digest is made anew and has to fit its header."""
    from urllib.parse import unquote

    page = lambda field: (unquote(field[len("<urn:page:") : -1]) or None) if field else None

    def read(columns: list) -> Iterator[tuple]:
        for path in columns[0]:
            with open_input(path) as file:
                for fields, http, payload in records(file, file.size()):
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    n = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    if fields["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a record of {path} doesn't fit its digest")
                    held = [payload if fields["warc-type"] == "response" else None] if payloads else []
                    yield page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], n, digest, page(fields.get("warc-refers-to")), *held

    n = max(manifest.sparkSession.sparkContext.defaultParallelism * 2, -(-manifest.count() // archives))
    schema = "id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string" + ", payload binary" * payloads
    out = map_batches(manifest.select("path").repartition(n), read, schema)
    of = lambda c, name: F.col(c).cast(id_type).alias(name)
    more = ["payload"] if payloads else []
    return out.select(of("id", id_col), "url", "record_type", "payload_bytes", "payload_digest", of("refers_to", "refers_to"), *more)


def new_folder(spark) -> str:
    """A fresh folder for archives in the shared one; it goes when the driver ends."""
    import atexit

    folder = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    atexit.register(remove, spark, folder)
    return folder
