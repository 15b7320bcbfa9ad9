"""Web archives packed in ZIP files: a writer, and a reader that fetches single records by ranges.

An archive holds `archive/data.warc.gz`, one gzip member for each record, and `indexes/index.cdxj`, one line for each
record with its offset and length in that member; both are stored, so a record's place in the archive is known
without unpacking. ZIP64 forms are written and read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_group, shared_dir, shuffle_tasks, written

#: Records and packed bytes after which a task begins another archive, which bounds the index that it holds, and bytes
#: of an archive that a task reads.
MOST_RECORDS, MOST_BYTES, RANGE = 50_000, 1 << 30, 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: The profile of revisit records, signatures of the ZIP format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC files have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP header of its page but not the payload, whose size and digest it tells."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    address = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, directory: str, least: int = 0, date: str = "2020-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, one or more for each task; returns path and records of each.

    A null html is an empty payload. Among records with equal payloads of at least `least` bytes those with the
    smallest page_id are responses (rows that repeat that id too), the others revisit it; rows without an id always
    carry their payload. A task that runs again writes the same file anew; it shows under its name when whole.
    """
    html = F.coalesce("html", F.lit(""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8"))
    marked = known.withColumn("digest", digest)
    skinny = marked.where("page_id IS NOT NULL").select("page_id", "digest").distinct()
    firsts = attach_group(skinny, ["digest"], ["page_id"], first=(F.min("page_id"), F.min))
    firsts = firsts.where("first < page_id").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first")
    whole = marked.join(firsts, (F.col("page_id") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    first = F.when(F.octet_length("html") >= least, F.col("first"))
    rows = whole.select("page_id", "url", "html", first.alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filesystem, root = fs.FileSystem.from_uri(directory)
        filesystem.create_dir(root, recursive=True)
        task = TaskContext.get()

        def records() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for page, url, text, first in zip(*[c.to_pylist() for c in batch.columns]):
                    kind = "response" if first is None else "revisit"
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    yield page, packer.compress(record_bytes(kind, page, url, text.encode(), first, date)) + packer.flush()

        coming, number = records(), 0
        following = next(coming, None)
        while following:
            name = f"{root}/part-{task.partitionId():06d}-{number:05d}.wacz"
            temporary = f"{name}.{task.taskAttemptId()}.tmp"
            lines, at, number = [], 0, number + 1
            with filesystem.open_output_stream(temporary) as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                    with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                        while following and len(lines) < MOST_RECORDS and at < MOST_BYTES:
                            page, packed = following
                            data.write(packed)
                            lines.append(json.dumps({"page": page, "offset": at, "length": len(packed)}))
                            at += len(packed)
                            following = next(coming, None)
                    with archive.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                        for some in range(0, len(lines), 1000):
                            index.write("".join(line + "\n" for line in lines[some : some + 1000]).encode())
            filesystem.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{directory}/{name.rsplit('/', 1)[1]}"]), pa.array([len(lines)], pa.int64())], ["path", "records"])

    return rows.mapInArrow(write, "path string, records long")


def members(file) -> dict[str, tuple[int, int, int]]:
    """Name -> (method, offset of the data, packed size) of a ZIP file's members, from its central directory alone."""
    size = file.size()
    tail_at = max(0, size - 65557)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        end64 = file.read_at(56, struct.unpack_from("<Q", tail, at - 12)[0])
        if end64[:4] != END64:
            raise ValueError("ZIP64 end record not found")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, found, at = file.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra, k = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: what does not fit above, in this order
                wide, p = extra[k + 4 : k + 4 + n], 0
                if plain == 0xFFFFFFFF:
                    p += 8
                if packed == 0xFFFFFFFF:
                    packed, p = struct.unpack_from("<Q", wide, p)[0], p + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack_from("<Q", wide, p)[0]
            k += 4 + n
        head = file.read_at(30, offset)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        found[name] = method, offset + 30 + sum(struct.unpack_from("<HH", head, 26)), packed
        at += 46 + name_n + extra_n + note_n
    return found


def read_index(archives: DataFrame) -> DataFrame:
    """path, offset and length (in the archive file) of each record of the archives of a path column."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, name = fs.FileSystem.from_uri(path)
                with filesystem.open_input_file(name) as file:
                    parts = members(file)
                    if {DATA, INDEX} - set(parts) or parts[DATA][0] or parts[INDEX][0]:
                        raise ValueError(f"{path} has no stored {DATA} and {INDEX}")
                    lines = file.read_at(parts[INDEX][2], parts[INDEX][1]).splitlines()
                    for some in range(0, len(lines), 50_000):
                        rows = [json.loads(line) for line in lines[some : some + 50_000]]
                        columns = [pa.array([path] * len(rows)), pa.array([parts[DATA][1] + r["offset"] for r in rows], pa.int64()), pa.array([r["length"] for r in rows], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "length"])

    return archives.select("path").mapInArrow(index, "path string, offset long, length long")


def parse_record(raw: bytes) -> dict:
    """Header fields (lower-case names) and block of a WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields | {"block": rest[: int(fields["content-length"])]}


def read_records(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every record of an index, read by its range, in so many tasks (None: as the session sees fit): page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (both of the full payload, for revisits too) and payload (null for revisits).

    Payload digests are checked against the bytes read.
    """
    page = lambda s: None if s is None or s[10:-1] == "none" else int(s[10:-1])
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            paths, offsets, lengths = [c.to_pylist() for c in batch.columns]
            for some in range(0, len(paths), 256):
                rows = []
                for path, offset, length in zip(paths[some : some + 256], offsets[some : some + 256], lengths[some : some + 256]):
                    if path != name:
                        if file:
                            file.close()
                        filesystem, inner = fs.FileSystem.from_uri(path)
                        name, file = path, filesystem.open_input_file(inner)
                    record = parse_record(zlib.decompress(file.read_at(length, offset), 31))
                    head, _, payload = record["block"].partition(b"\r\n\r\n")
                    size = int(head.decode().lower().split("content-length:")[1].split("\r\n")[0])
                    digest = record["warc-payload-digest"].removeprefix("sha1:")
                    revisit = record["warc-type"] == "revisit"
                    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"{path} at {offset}: the payload does not fit its digest")
                    rows.append((page(record["warc-record-id"]), record["warc-target-uri"], record["warc-type"], page(record.get("warc-refers-to")), size, digest, None if revisit else payload))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in schema.split(", ")])
        if file:
            file.close()

    keys = "path", F.floor(F.col("offset") / RANGE)
    return (index.repartition(tasks, *keys) if tasks else index.repartition(*keys)).sortWithinPartitions("path", "offset").mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives of pages written in the shared folder, and their records read back."""
    directory = shared_dir(spark, "warc")
    paths = directory + "-paths"
    write_archives(pages, directory, least).write.parquet(paths)
    index = written(read_index(spark.read.schema("path string, records long").parquet(paths)), "index")
    # Rows of the index are small, what they stand for is not: the number of tasks follows the archives' bytes.
    size = index.agg(F.sum("length")).first()[0] or 0
    return read_records(index, max(-(-size // RANGE), shuffle_tasks(spark)))
