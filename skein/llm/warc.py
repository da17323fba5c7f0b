"""WARC records in ZIP packages: writing, directory parsing and range reads without extraction.

A package is a ZIP archive of stored members: archive/data.warc.gz (one gzip member for each record) and
indexes/index.tsv (offset, length and target of each record in it). Packages are written by the tasks that hold
the pages. To read, the end-of-directory record, a ZIP64 locator and directory where there is one, and the
central directory are parsed from the package's tail; a stored member's bytes are then addressed in place, so the
index is one range read and each record another, and nothing is extracted. Paths are opened with pyarrow.fs, so a
package may lie in any store that Arrow reads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, materialise, scratch_path

#: Payloads of fewer bytes are stored whole each time.
LEAST_REVISIT = 1000
#: Bytes of records after which a task begins a new package, and bytes of records one range read takes.
PACKAGE_BYTES = 256 << 20
READ_BYTES = 1 << 20
_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.tsv"
_MAX32 = 0xFFFFFFFF


def store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# -- ZIP packages ------------------------------------------------------------------------------------------------


class PackageWriter:
    """Stored members one after another; sizes are known when a member ends, so they follow it in a descriptor."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # bit 3: sizes follow; ZIP64 extra field, so that the descriptor has 64-bit sizes
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 33, 0, _MAX32, _MAX32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> int:
        """Append to the open member; the data's offset in the member."""
        member = self.members[-1]
        at = member[2]
        member[2], member[3] = at + len(data), zlib.crc32(data, member[3])
        self._put(data)
        return at

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        begin = self.at
        for raw, at, size, crc in self.members:
            big = self.zip64 or max(at, size) >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            n, where = (_MAX32, _MAX32) if big else (size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 33, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra)
        size, count = self.at - begin, len(self.members)
        if self.zip64 or max(begin, size) >= _MAX32 or count >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, begin))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _MAX32, _MAX32, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, begin, 0))


def _at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    return file.read(size)


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (compression method, offset of its data, bytes) of a ZIP archive's members, by range reads."""
    tail_at = max(0, size - 22 - 65535)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature inside a comment
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, begin = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == _MAX32 or begin == _MAX32:
        locator = _at(file, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, begin = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = _at(file, begin, length), 0, {}
    for _ in range(count):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", raw, at + 20)
        local, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46:at + 46 + name_n].decode()
        extra, e = raw[at + 46 + name_n:at + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == _MAX32 else plain
                packed = wide.pop(0) if packed == _MAX32 else packed
                local = wide.pop(0) if local == _MAX32 else local
            e += 4 + n
        head = _at(file, local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        out[name] = (method, local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        at += 46 + name_n + extra_n + note_n
    return out


# -- WARC records ------------------------------------------------------------------------------------------------


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without the payload; digests in base 32, as WARC has them."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Page, payload size and digest, type and referred page of a record; a whole payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its digest")
    page = lambda x: int(x[10:-1]) if x else None
    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To"))}


def _packed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _clean(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "%20" for c in url or "") or "about:blank"


def _write(folder: str, date: str):
    """Packages of a task's pages under names no other attempt has; only finished attempts report theirs."""
    def run(batches: Iterator[pa.RecordBatch]):
        files, base = store(folder)
        out = package = None
        index: list[str] = []

        def finish():
            package.end()
            package.begin(_INDEX)
            package.add("".join(index).encode())
            package.end()
            package.close()
            out.close()
            index.clear()

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                if package is None or package.members[-1][2] > PACKAGE_BYTES:
                    if package is not None:
                        finish()
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = files.open_output_stream(f"{base}/{name}")
                    package = PackageWriter(out)
                    package.begin(_DATA)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])
                payload = (html.as_py() or "").encode()
                raw = _packed(record(page.as_py(), _clean(url.as_py()), payload, digest.as_py(), refers.as_py(), date))
                index.append(f"{package.add(raw)}\t{len(raw)}\t{page.as_py()}\n")
        if package is not None:
            finish()
    return run


def _locate(batches):
    """Runs of neighbouring records (path, offset in the package, bytes, lengths of the records) of each package."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, name = store(path)
            with files.open_input_file(name) as file:
                members = directory(file, file.size())
                method, at, size = members[_INDEX]
                lines = _at(file, at, size).decode().splitlines()
                data_method, base, _ = members[_DATA]
                if method or data_method:
                    raise ValueError(f"{path}: a member is compressed, not stored")
            rows, lengths, begin = [], [], 0
            for line in lines:
                offset, n, _ = map(int, line.split("\t"))
                if lengths and offset + n - begin > READ_BYTES:
                    rows.append((path, base + begin, lengths))
                    lengths = []
                begin = begin if lengths else offset
                lengths.append(n)
            if lengths:
                rows.append((path, base + begin, lengths))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["path", "at", "lengths"])


_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches):
    for batch in batches:
        for path, at, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            files, name = store(path)
            with files.open_input_file(name) as file:
                raw = _at(file, at, sum(lengths))
            out, done = [], 0
            for n in lengths:
                out.append(parse(zlib.decompress(raw[done:done + n], 31)))
                done += n
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def write_packages(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page with an id; (path) of the packages.

    Null html is an empty payload. Of pages with equal payloads of LEAST_REVISIT bytes or more the one of largest
    id is the response, the others revisit it; rows of an equal id and payload are all responses of themselves.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "packages")
    files, base = store(folder)
    files.create_dir(base, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    frame = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long = materialise(frame.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest"), "digests")
    last = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = materialise(long.join(last, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    rows = frame.join(bounded(revisits), ["page_id", "digest"], "left")
    return materialise(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(folder, date), "path string"), "package-list")


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the packages (path).

    An empty list has no records. Runs of records are dealt out over all tasks, whatever the size of a package.
    """
    runs = packages.select("path").mapInArrow(_locate, "path string, at long, lengths array<long>")
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
