"""Web archives in ZIP packages: writing, and reading back without extraction.

A package is a ZIP file of two stored (uncompressed) members: `archive/data.warc.gz`, WARC 1.1 records of one gzip member
each, and `indexes/index.cdxj`, a sorted line for each record with its place. The reader gets a package's directory from its
tail (end record, ZIP64 end record and locator, central directory with ZIP64 extra fields), finds where the stored members'
bytes begin from their local headers, reads the index, and then only byte ranges of the archive.

Payloads that occur more than once, of MIN_BYTES bytes at least, are written once; the record with the largest id is the
response, the others are revisits that refer to it.

Packages lie in the shared folder and are opened through pyarrow's file systems, by URI. A task's package has a name of its
own for each attempt; a table of the finished packages, written by Spark, names those that count, so tasks may be repeated.

Defined cases: a null payload is empty; a null id is written as an empty one and read as null; repeated rows are records of
their own, and of repeated largest ids each is a response; no rows give no packages and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import scratch_path, written
from .common import BATCH_BYTES, column

MIN_BYTES = 1000
#: A package is closed when its archive has this many bytes.
PACKAGE_BYTES = 256 << 20
#: Tasks that read packages, at most.
READERS = 100_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: ZIP signatures (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
LIMIT32, LIMIT16 = 0xFFFFFFFF, 0xFFFF


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


class ZipWriter:
    """Stored members, one after the other, of sizes that are known only at their end; ZIP64 throughout."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc, self.size = name.encode(), self.at, 0, 0
        # Bit 3: sizes and checksum follow the member, as 64-bit numbers by its extra field.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, LIMIT32, LIMIT32, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._write(data)

    def end(self) -> None:
        self._write(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.header, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for name, header, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, LIMIT32, LIMIT32, len(name), len(extra), 0, 0, 0, 0, LIMIT32) + name + extra)
        size, end64 = self.at - start, self.at
        n = len(self.members)
        self._write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self._write(struct.pack("<IHHHHIIH", END, 0, 0, min(n, LIMIT16), min(n, LIMIT16), LIMIT32, LIMIT32, 0))
        self.out.close()


def read_range(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise ValueError("package ends early")
    return bytes(data)


def members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """For each member of a package: method, first byte of its data, and its size there."""
    tail_at = max(0, size - 22 - LIMIT16)
    tail = read_range(file, tail_at, size - tail_at)
    at = len(tail) - 22
    # The end record is the last one whose comment reaches just to the file's end.
    while at >= 0 and not (tail[at:at + 4] == struct.pack("<I", END) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    end = tail_at + at
    if count == LIMIT16 or LIMIT32 in (length, start):
        locator = read_range(file, end - 20, 20) if end >= 20 else b"\0" * 20
        kind, _, where, _ = struct.unpack("<IIQI", locator)
        if kind == LOCATOR64:
            kind, _, _, _, _, _, _, count, length, start = struct.unpack("<IQHHIIQQQQ", read_range(file, where, 56))
            if kind != END64:
                raise ValueError("no ZIP64 end of central directory")
    directory, out, at = read_range(file, start, length), {}, 0
    for _ in range(count):
        kind, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if kind != CENTRAL:
            raise ValueError("broken central directory")
        name = directory[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(values) if plain == LIMIT32 else plain
                packed = next(values) if packed == LIMIT32 else packed
                header = next(values) if header == LIMIT32 else header
            e += 4 + n
        out[name] = (method, header, packed)
        at += 46 + n_name + n_extra + n_comment
    for name, (method, header, packed) in out.items():
        kind, *_, n_name, n_extra = struct.unpack("<IHHHHHIIIHH", read_range(file, header, 30))
        if kind != LOCAL:
            raise ValueError("broken local header")
        out[name] = (method, header + 30 + n_name + n_extra, packed)
    return out


def named(page_id: str | None) -> str:
    """An id as part of a URN: null is nothing, an empty id a lone percent sign."""
    return "" if page_id is None else quote(page_id, safe="", errors="surrogatepass") or "%"


def unnamed(name: str) -> str | None:
    return None if not name else "" if name == "%" else unquote(name, errors="surrogatepass")


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record; a revisit has no payload of its own."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to: what each record is to be."""
    rows = pages.select(
        column(id_col).alias("page_id"), F.coalesce(column(url_col), F.lit("")).alias("url"),
        F.coalesce(column(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    firsts = (
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
        .filter("copies > 1").select("digest", "response")
    )
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("response"), F.col("response"))
        .when(F.col("page_id").isNull(), F.col("response")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, **columns) -> DataFrame:
    """Write the packages; a written table of them: uri, bytes, records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_fs(folder)
        files.create_dir(path, recursive=True)
        out, made = None, []

        def close():
            out.end()
            index.sort()
            out.begin(INDEX)
            out.write("".join(line + "\n" for line in index).encode())
            out.end()
            out.close()
            made.append((f"{folder}/{name}", out.at, len(index)))

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, index = f"{uuid.uuid4().hex}.wacz", []
                    out = ZipWriter(files.open_output_stream(f"{path}/{name}"))
                    out.begin(ARCHIVE)
                key = named(None if page_id is None else str(page_id))
                data = gzip.compress(record(key, url, payload, digest, None if refers_to is None else named(str(refers_to))), 1, mtime=0)
                index.append(f"{key} {out.size} {len(data)}")
                out.write(data)
                if out.size >= package_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*made) if made else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["uri", "bytes", "records"])

    return written(planned(pages, **columns).mapInArrow(run, "uri string, bytes bigint, records bigint"), "packages")


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each record: page_id (text), record_type, refers_to (text), payload_bytes and payload_digest as declared, url,
    and with `with_payload` the payload (null for revisits)."""
    schema = StructType.fromDDL("page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"
                                + ", payload binary" * with_payload)
    arrow = to_arrow_schema(schema)

    def rows(uri: str, size: int) -> Iterator[dict]:
        files, path = open_fs(uri)
        with files.open_input_file(path) as file:
            found = members(file, size)
            (how, first, _), (how_index, at, n) = found[ARCHIVE], found[INDEX]
            if how or how_index:
                raise ValueError("members must be stored")
            places = sorted(tuple(map(int, line.rsplit(b" ", 2)[1:])) for line in read_range(file, at, n).splitlines())
            i = 0
            while i < len(places):
                # Neighbouring records are read as one range.
                j = i + 1
                while j < len(places) and places[j][0] + places[j][1] - places[i][0] <= BATCH_BYTES:
                    j += 1
                start = places[i][0]
                data = read_range(file, first + start, places[j - 1][0] + places[j - 1][1] - start)
                for offset, length in places[i:j]:
                    headers, payload = parsed(gzip.decompress(data[offset - start:offset - start + length]))
                    revisit = headers["warc-type"] == "revisit"
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("payload does not match its digest")
                    name = lambda h: unnamed(h.removeprefix("<urn:page:").removesuffix(">"))
                    out = {"page_id": name(headers["warc-record-id"]), "url": headers["warc-target-uri"], "record_type": headers["warc-type"],
                           "refers_to": name(headers["warc-refers-to"]) if revisit else None,
                           "payload_bytes": int(headers["warc-payload-length"]), "payload_digest": digest}
                    yield out | ({"payload": None if revisit else payload} if with_payload else {})
                i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part, held = [], 0
                for row in rows(uri, size):
                    part.append(row)
                    held += len(row.get("payload") or b"") + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(part, schema=arrow)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema=arrow)

    # Packages are the units of work, of bounded size: a task for each, up to READERS.
    tasks = min(max(packages.count(), 1), READERS)
    return packages.select("uri", "bytes").repartition(tasks).mapInArrow(run, schema)


def round_trip(pages: DataFrame, spark: SparkSession, **columns) -> DataFrame:
    """Write every page to packages in the shared folder and read the records back."""
    return read_packages(write_packages(pages, scratch_path(spark, "warc"), **columns), with_payload=False)
