"""WARC records in ZIP packages: written, found again through the packages' directories, range-read.

A package is a ZIP file with a stored (not deflated) member archive/data.warc.gz, each record a
gzip member of its own, and a stored index indexes/index.cdx with a line for each record: page_id,
offset and length in the archive. The reader takes a package as a range of bytes: it looks
for the end of the central directory in the tail, follows the ZIP64 locator and record where
the sizes do not fit, walks the central directory, goes over each stored member's local header
to the data, reads the index, and then reads each record by offset. Nothing is extracted
and no file is read whole.

Packages are written to the shared folder by Arrow's file systems (file, hdfs, s3 ... by the
folder's scheme), under a name of the task attempt's own; only the names that a finished attempt
returned are read, so retries and lost executors leave strays but no doubles. A package holds at most
PACKAGE_BYTES of payload or one larger record.

Who refers to whom is found from digests alone; a digest that many pages share meets its response by
broadcast. Payloads move only where there are more than SEND_REVISITS revisits.

Edge cases: null html is an empty payload; of equal payloads (empty ones, too) the largest page_id
is the response, rows with a null page_id refer to it (where all are null, each is a response);
rows of equal page_id have a record each, and of repeated rows the others refer to one; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow, join_groups, shared_dir, stored, unlink

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGE_BYTES = 64 << 20
#: Index lines of one range-reading task; neighbours are read with one open file.
TASK_RECORDS = 5_000
#: So many revisits may be broadcast to the pages (150 bytes each, 38 MB); beyond it pages and revisits meet by shuffle.
SEND_REVISITS = 250_000


# ZIP format: signatures and record layouts are fixed values of the format
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members. zip64: with ZIP64 records even where sizes fit, as tests want."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        at, crc, raw = len(out), zlib.crc32(data), name.encode("utf-8")
        wide = zip64 or len(data) >= FULL32 or at >= FULL32
        size = FULL32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        need = 45 if wide else 20
        out += LOCAL + struct.pack("<HHHHHIIIHH", need, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", need, need, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + raw + extra
    start, n = len(out), len(members)
    out += directory
    wide = zip64 or start >= FULL32 or len(directory) >= FULL32 or n >= FULL16
    if wide:
        end64 = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), start)
        out += LOCATOR64 + struct.pack("<IQI", 0, end64, 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, FULL16 if wide else n, FULL16 if wide else n, FULL32 if wide else len(directory), FULL32 if wide else start, 0)
    return bytes(out)


Read = Callable[[int, int], bytes]


def directory(read: Read, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the local header, stored size) of each member; read(offset, length) gives bytes."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 in (n,) or FULL32 in (length, start):
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of the central directory")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, out, p = read(start, length), [], 0
    for _ in range(n):
        if raw[p : p + 4] != CENTRAL:
            raise ValueError("a broken central directory")
        method = struct.unpack_from("<H", raw, p + 10)[0]
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", raw, p + 20)
        offset = struct.unpack_from("<I", raw, p + 42)[0]
        name = raw[p + 46 : p + 46 + name_n].decode("utf-8")
        extra, q = raw[p + 46 + name_n : p + 46 + name_n + extra_n], 0
        while q + 4 <= len(extra):
            tag, k = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, q + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            q += 4 + k
        out.append((name, method, offset, packed))
        p += 46 + name_n + extra_n + comment_n
    return out


def member_at(read: Read, entry: tuple[str, int, int, int]) -> tuple[int, int]:
    """Offset and size of a stored member's data."""
    name, method, offset, size = entry
    if method:
        raise ValueError(f"{name} is not stored")
    head = read(offset, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{name} has no local header")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return offset + 30 + name_n + extra_n, size


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with the WARC record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_uri(page_id)}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    return gzip.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(lines)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http.decode("ascii").split("\r\n")[1:]), payload


def _page(uri: str) -> int | None:
    n = uri.strip("<>").rpartition(":")[2]
    return int(n) if n else None


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """(path, size) of each package; pages has page_id, url, html, digest, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        held: list[bytes] = []
        lines: list[str] = []
        at = payload = 0

        def close() -> pa.RecordBatch:
            package = zip_package([(ARCHIVE, b"".join(held)), (INDEX, "".join(lines).encode("ascii"))])
            name = f"{root}/{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(name) as f:
                f.write(package)
            held.clear()
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([len(package)], pa.int64())], ["path", "size"])

        files.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                body = (html or "").encode("utf-8")
                raw = record(page_id, url or "", body, sha1_base32(body), refers_to)
                lines.append(f"{'' if page_id is None else page_id} {at} {len(raw)}\n")
                held.append(raw)
                at, payload = at + len(raw), payload + len(body)
                if payload >= PACKAGE_BYTES:
                    yield close()
                    at = payload = 0
        if held:
            yield close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, size long")


def _reader(files, path: str) -> tuple[Read, object]:
    f = files.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read, f


def list_records(packages: DataFrame, folder: str) -> DataFrame:
    """(path, first, chunk) of the packages: where the archive's data begin, and index lines in chunks of TASK_RECORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read, f = _reader(files, path)
                with f:
                    found = {e[0]: e for e in directory(read, size)}
                    first, _ = member_at(read, found[ARCHIVE])
                    at, n = member_at(read, found[INDEX])
                    lines = read(at, n).splitlines()
                chunks = [b"\n".join(lines[k : k + TASK_RECORDS]) for k in range(0, len(lines), TASK_RECORDS)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(chunks)), pa.array([first] * len(chunks), pa.int64()), pa.array(chunks, pa.binary())], ["path", "first", "chunk"])

    return packages.mapInArrow(run, "path string, first long, chunk binary")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(chunks: DataFrame, folder: str) -> DataFrame:
    """A row (RECORDS) for each record, read by its offset and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        for batch in batches:
            for path, first, chunk in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = []
                read, f = _reader(files, path)
                with f:
                    for line in chunk.split(b"\n"):
                        _, at, n = line.split(b" ")
                        warc, http, payload = parse(read(first + int(at), int(n)))
                        digest = warc["warc-payload-digest"].partition(":")[2]
                        if warc["warc-type"] == "response" and sha1_base32(payload) != digest:
                            raise ValueError(f"{path}: a payload does not match its digest")
                        refers = warc.get("warc-refers-to")
                        size = len(payload) if refers is None else int(http["content-length"])
                        rows.append((_page(warc["warc-record-id"]), size, digest, warc["warc-type"], None if refers is None else _page(refers)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return chunks.mapInArrow(run, RECORDS)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write pages (page_id, url, html) as packages; (path, size) of each, and the folder."""
    spark = pages.sparkSession
    arrow(spark)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"))
    key = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    digests = stored(rows.select("page_id", key.alias("digest")), "digests")
    # one row per digest: who is its response; groups are summed before the shuffle
    best = stored(digests.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null"), "best", small=True)
    both = join_groups(digests, best, ["digest"]).groupBy(F.col("page_id").alias("revisit"), F.col("digest").alias("same"), "best").agg(F.count("*").alias("n"))
    # only revisits, and responses that stand in several rows, are told to the pages; all others keep no partner
    revisits = stored(both.where("revisit is null or revisit < best or n > 1").selectExpr("revisit", "same", "best", "revisit <=> best copies"), "revisits", small=True)
    told = F.broadcast(revisits) if revisits.count() <= SEND_REVISITS else revisits
    out = rows.withColumn("digest", key).join(told, F.col("page_id").eqNullSafe(F.col("revisit")) & (F.col("digest") == F.col("same")), "left")
    copied = F.coalesce(F.col("copies"), F.lit(False))
    gone = [digests, best, revisits]
    if revisits.where("copies").isEmpty():
        out = out.select("page_id", "url", "html", F.col("best").alias("refers_to"))
    else:  # of rows equal in page_id and payload the first as stored is the response
        held = stored(out.where(copied).select("page_id", "url", "html", "digest", F.monotonically_increasing_id().alias("row")), "copies")
        first = stored(held.groupBy("page_id", "digest").agg(F.min("row").alias("first"), F.count("*").alias("n")), "firsts", small=True)
        later = join_groups(held, first, ["page_id", "digest"]).select("page_id", "url", "html", F.when(F.col("row") != F.col("first"), F.col("page_id")).alias("refers_to"))
        out = out.where(~copied).select("page_id", "url", "html", F.col("best").alias("refers_to")).unionByName(later)
        gone += [held, first]
    packages = stored(write_packages(out, folder), "packages")
    unlink(*gone)
    return packages, folder


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages, folder = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    chunks = stored(list_records(packages, folder), "warc-index")
    n = chunks.count()
    return read_records(chunks.repartition(max(1, n)), folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS best FROM p),
b AS (SELECT *, list_reduce(list_prepend('', list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0'))), lambda a, x: a || x) AS bits FROM d)
SELECT page_id, payload_bytes,
  list_reduce(list_prepend('', list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_prepend(0, list_transform(range(1, 6), lambda k: instr('01', bits[i * 5 + k]) - 1)), lambda a, x: a * 2 + x)::INT, 1))), lambda a, x: a || x) AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b"""
