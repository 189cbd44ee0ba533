"""WARC records in ZIP packages: writer, and a reader that never unpacks an archive.

A package holds ``archive/*.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj``, both stored, with ZIP64 directories. The reader takes
the end of the file, the central directory and the index, and then reads
single records by byte range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respanel.llm.common import beside_keys, prepare, scratch_path, stored, text_bytes

LOCAL, CENTRAL, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x08074B50
END, END64, LOCATOR64 = 0x06054B50, 0x06064B50, 0x07064B50
BIG32, BIG16 = 0xFFFFFFFF, 0xFFFF
#: The end record and the longest comment that may follow it.
TAIL = 22 + 65535
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class PackageError(ValueError):
    """A package that cannot be read: cut off, not a ZIP, or a member that is not stored."""


class ZipWriter:
    """Stored members in one pass, sizes in data descriptors, directories as ZIP64."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x5821, 0, BIG32, BIG32, len(raw), len(extra)) + raw + extra)

    def put(self, data: bytes) -> int:
        """Append to the open member; returns the place of ``data`` in it."""
        member = self.members[-1]
        place, member[2], member[3] = member[3], zlib.crc32(data, member[2]), member[3] + len(data)
        self.write(data)
        return place

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self.write(struct.pack("<IIQQ", DESCRIPTOR, crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            fixed = struct.pack(
                "<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x5821, crc, BIG32, BIG32, len(raw), len(extra), 0, 0, 0, 0, BIG32
            )
            self.write(fixed + raw + extra)
        size, n, end64 = self.at - start, len(self.members), self.at
        self.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self.write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self.write(struct.pack("<IHHHHIIH", END, 0, 0, BIG16, BIG16, BIG32, BIG32, 0))


def _read(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) < size:
        raise PackageError(f"cut off: {size} bytes expected at {start}, {len(data)} found")
    return data


def directory(file, total: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, data offset, stored size) of every member, from the end of the file and the central directory."""
    tail_at = max(0, total - TAIL)
    tail = _read(file, tail_at, total - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise PackageError("no end of central directory")
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    if BIG16 == n or BIG32 in (size, start):
        sign, _, end64, _ = struct.unpack("<IIQI", _read(file, tail_at + at - 20, 20))
        if sign != LOCATOR64:
            raise PackageError("no ZIP64 locator")
        fixed = _read(file, end64, 56)
        if struct.unpack_from("<I", fixed)[0] != END64:
            raise PackageError("no ZIP64 end record")
        n, size, start = struct.unpack_from("<QQQ", fixed, 32)
    listing, at, out = _read(file, start, size), 0, {}
    for _ in range(n):
        head = struct.unpack_from("<IHHHHHHIIIHHHHHII", listing, at)
        if head[0] != CENTRAL:
            raise PackageError("bad central directory entry")
        method, packed, plain, n_name, n_extra, n_note, offset = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
        name = listing[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra, k = listing[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[k + 4 : k + 4 + length // 8 * 8])]
                plain = wide.pop(0) if plain == BIG32 and wide else plain
                packed = wide.pop(0) if packed == BIG32 and wide else packed
                offset = wide.pop(0) if offset == BIG32 and wide else offset
            k += 4 + length
        out[name] = (method, offset, packed)
        at += 46 + n_name + n_extra + n_note
    for name, (method, offset, packed) in out.items():
        sign, n_name, n_extra = struct.unpack("<I22xHH", _read(file, offset, 30))
        if sign != LOCAL:
            raise PackageError(f"no member at {offset}")
        out[name] = (method, offset + 30 + n_name + n_extra, packed)
    return out


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~-._')}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record and its payload (None for a revisit), digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise PackageError("no WARC record here")
    field = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    digest, kind = field["warc-payload-digest"].removeprefix("sha1:"), field["warc-type"]
    if kind == "response" and (len(payload) != length or b32(hashlib.sha1(payload).digest()) != digest):
        raise PackageError(f"payload of {field['warc-record-id']} differs from its digest")
    url = field.get("warc-target-uri")
    return {
        "page_id": number(field["warc-record-id"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(field.get("warc-refers-to")),
        "url": None if url is None else unquote(url),
        "payload": payload if kind == "response" else None,
    }


def write_packages(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a WARC record, one package a partition, and return (package, n_records).

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is
    the response, the others revisit it. Rows that share that smallest id
    and payload are all responses. A null html is an empty payload, a null
    url is left out, a row without an id is a record of its own (response).
    An empty table writes no package. ``path`` must be a place that all
    executors share. A task that runs again writes its package anew.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_bytes(html_col).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    least = rows.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"), F.first(F.length("html")).alias("size"))
    least = least.filter((F.col("n") > 1) & (F.col("size") >= min_bytes)).select(F.col("digest").alias("key"), "least", "n")
    joined = beside_keys(rows, least, "digest", "least")
    joined = joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("least"), F.col("least")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        part = TaskContext.get()
        name = f"{base}/part-{part.partitionId():06d}.zip"
        draft, out, zipped, lines, n = f"{base}/.draft-{part.partitionId()}-{part.taskAttemptId()}", None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if zipped is None:
                    out = store.open_output_stream(draft)
                    zipped = ZipWriter(out)
                    zipped.begin(MEMBER)
                whole = record(row["page_id"], row["url"], row["html"], b32(row["digest"]), row["refers_to"], row["refers_to"] is not None)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = squeeze.compress(whole) + squeeze.flush()
                place = zipped.put(packed)
                lines.append(json.dumps({"offset": str(place), "length": str(len(packed)), "filename": "data.warc.gz", "digest": "sha1:" + b32(row["digest"])}))
                n += 1
        if zipped is not None:
            zipped.end()
            zipped.begin(INDEX)
            for k in range(0, len(lines), 1000):
                zipped.put("".join(f"{DATE} {x}\n" for x in lines[k : k + 1000]).encode())
            zipped.end()
            zipped.close()
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["package", "n_records"])

    return joined.mapInArrow(write, "package string, n_records long")


def packages(path: str) -> list[str]:
    """The packages below ``path``; drafts of lost tasks don't count."""
    store, base = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.extension == "zip")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_packages(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the packages below ``path``, range-read by their indexes.

    Index entries are dealt over tasks before records are read, so one large
    package is read by many. Digests of responses are checked. A package
    that is cut off, has a packed member or no index raises ``PackageError``.
    """
    names = packages(path)
    listed = spark.createDataFrame([(x,) for x in names], "package string").repartition(max(1, min(len(names), 512)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(name) as file:
                    members = directory(file, file.size())
                    own = [x for x in members if x.startswith("indexes/")]
                    if not own:
                        raise PackageError(f"{name}: no index")
                    starts, sizes = [], []
                    for member in own:
                        method, at, size = members[member]
                        if method:
                            raise PackageError(f"{name}: {member} is packed")
                        for line in _read(file, at, size).splitlines():
                            entry = json.loads(line[line.index(b"{") :])
                            kind, data_at, data_size = members["archive/" + entry["filename"]]
                            offset, length = int(entry["offset"]), int(entry["length"])
                            if kind or offset + length > data_size:
                                raise PackageError(f"{name}: {entry['filename']} is packed or shorter than its index says")
                            starts.append(data_at + offset)
                            sizes.append(length)
                for k in range(0, len(starts), 10_000):
                    s, z = starts[k : k + 10_000], sizes[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(s, pa.int64()), pa.array(z, pa.int64())], names=["package", "start", "size"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        open_name, file = None, None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            out = []
            for name, start, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != open_name:
                    if file is not None:
                        file.close()
                    open_name, file = name, store.open_input_file(name)
                got = parse(zlib.decompress(_read(file, start, size), 31))
                out.append(got if with_payload else got | {"payload": None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if file is not None:
            file.close()

    entries = listed.mapInArrow(index, "package string, start long, size long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartitionByRange(parts, "package", "start").sortWithinPartitions("package", "start")
    return dealt.mapInArrow(fetch, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read all records back."""
    path = scratch_path(pages.sparkSession, "warc")
    stored(write_packages(pages, path), "warc-written")
    return read_packages(pages.sparkSession, path, with_payload=False)
