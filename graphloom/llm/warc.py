"""WARC records in ZIP-packaged archives (operator 7).

Writing: each task packs its records into archives, a ZIP file with two stored members,
``archive/data.warc.gz`` (records compressed one by one) and ``indexes/index.cdxj``, in
the shared folder. Reading: the end
of the file gives the central directory (ZIP64 where sizes ask for it), the directory
gives the places of all stored members under ``archive/`` and ``indexes/``, the indexes
(CDXJ) give the member and place of each record, and each record is one range read; a
member that no index names is read through. Nothing is extracted or read twice.

Of records with equal payloads of at least ``least_bytes`` bytes that with the smallest
page id is a response, the others revisit it.

Defined results: null html is an empty payload; shorter payloads are always responses;
rows that repeat the smallest page id are all responses; a null page id never comes first
unless all are null; a null URL has no target header; an empty table gives no archive and
no rows; other columns are ignored.

Scale: payload digests are computed in the scan and grouped with map-side combine; only
digests that occur twice meet the pages again: by broadcast if they are few (counted
first), else in a shuffle. Archives are bounded by ``archive_bytes``,
are named by task attempt, and only those listed by tasks that succeeded are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Repeated payloads (72 bytes each) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class RangeFile:
    """Reads byte ranges of a file in any store that Arrow can open."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.bytes_read = 0

    def read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, at)


class ZipDirectory:
    """Members of a ZIP file by name: (method, size, offset of the local header)."""

    END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

    def __init__(self, file: RangeFile) -> None:
        self.file = file
        tail_at = max(0, file.size - 22 - 0xFFFF - 20)
        tail = file.read(tail_at, file.size - tail_at)
        at = tail.rfind(self.END)
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == self.LOCATOR:
            (end64,) = struct.unpack_from("<Q", tail, at - 12)
            record = file.read(end64, 56)
            if record[:4] != self.END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, offset = struct.unpack_from("<QQQ", record, 32)
        raw, at = file.read(offset, size), 0
        self.members: dict[str, tuple[int, int, int]] = {}
        for _ in range(count):
            if raw[at : at + 4] != self.ENTRY:
                raise ValueError("a directory entry is damaged")
            method, packed, full, n_name, n_extra, n_comment, local = (*struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<IIHHH", raw, at + 20), *struct.unpack_from("<I", raw, at + 42))
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra, x = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while x + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # ZIP64: the fields that are full in the entry, in this order
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, x + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                x += 4 + length
            self.members[name] = (method, packed, local)
            at += 46 + n_name + n_extra + n_comment

    def stored(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's bytes."""
        method, size, local = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, so it has no ranges")
        head = self.file.read(local, 30)
        if head[:4] != self.LOCAL:
            raise ValueError("a local header is damaged")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, size


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; of a revisit ``payload`` is empty, digest and size are the original's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{revisit}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {clean}"] if url is not None else []), *([f"X-Page-ID: {page_id}"] if page_id is not None else []), f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


KEPT_TYPES = ("response", "revisit", "resource")


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and lower-cased header fields of a header block."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (x.partition(":") for x in lines)
    return first, {k.strip().lower(): v.removeprefix(" ") for k, colon, v in pairs if colon}


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one WARC record. A payload digest in SHA-256 or SHA-1 (hex or
    base 32) is compared with the payload. The digest returned is the payload's SHA-256, of a
    revisit what the record states (null if nothing)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, fields = _fields(head)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["content-length"])]
    payload, http = block, {}
    if block.startswith(b"HTTP/"):
        http_head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(http_head)[1]
    revisit = fields["warc-type"] == "revisit"
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    found = hashlib.sha256(payload).hexdigest()
    if not revisit and kind in ("sha256", "sha1"):
        own = bytes.fromhex(found) if kind == "sha256" else hashlib.sha1(payload).digest()
        if digest.lower() not in (own.hex(), base64.b32encode(own).decode().rstrip("=").lower()):
            raise ValueError("a payload does not match its digest")
    stated = found if not revisit else digest or None
    number = lambda k: int(fields[k]) if k in fields else None
    size = int(http.get("content-length", 0)) if revisit else len(payload)
    return {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_digest": stated, "payload_bytes": size, "refers_to": number("x-refers-to-page-id"), "payload": payload}


def marked(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """Pages with digest, size, and for revisits the page that they revisit."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    twice = rows.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    twice = written(twice, "warc-repeated")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    both = rows.join(twice, (rows["digest"] == twice["d"]) & (rows["n_bytes"] >= least_bytes), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "digest", "n_bytes", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.col("html")).alias("html"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes the archives and returns ``(path, n_records)`` of each, as a table in the
    shared folder, so that no later job writes them again."""

    def pack(rows: list[tuple]) -> tuple[bytes, int]:
        data, index = io.BytesIO(), []
        for page_id, url, digest, size, revisit, refers_to, html in rows:
            record = gzip.compress(record_bytes(page_id, url, (html or "").encode(), digest, size, refers_to, revisit), 1, mtime=0)
            index.append(json.dumps({"filename": DATA.removeprefix("archive/"), "offset": data.tell(), "length": len(record), "page_id": page_id, "digest": digest}))
            data.write(record)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            z.writestr(zipfile.ZipInfo(DATA), data.getvalue())
            z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
        return out.getvalue(), len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            fs.create_dir(root, recursive=True)
            name, (raw, n) = f"{uuid.uuid4().hex}.zip", pack(waiting)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(raw)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n_records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append(row)
                size += 500 + len(row[-1] or "")
                if size >= archive_bytes:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return written(marked(pages, id_col, url_col, html_col, least_bytes).mapInArrow(run, "path string, n_records long"), "warc-manifest")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_KINDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def chunks(file: RangeFile, at: int, size: int, n: int = 1 << 20) -> Iterator[bytes]:
    for start in range(at, at + size, n):
        yield file.read(start, min(n, at + size - start))


def index_lines(file: RangeFile, at: int, size: int, packed: bool) -> Iterator[dict]:
    """Entries of a CDXJ member: ``key timestamp {json}`` lines, or the JSON alone. Lines
    without JSON (headers, blanks) are passed over."""
    rest, pieces = b"", chunks(file, at, size)
    for piece in itertools.chain(unpacked(pieces) if packed else pieces, [b"\n"]):
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            brace = line.find(b"{")
            if brace >= 0 and not line.startswith(b"!"):
                yield json.loads(line[brace:])


def unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of each gzip stream of a run of streams."""
    one, parts = zlib.decompressobj(31), []
    for piece in pieces:
        while piece:
            parts.append(one.decompress(piece))
            piece = one.unused_data
            if one.eof:
                yield b"".join(parts)
                one, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a compressed member ends early")


def plain_records(file: RangeFile, at: int, size: int) -> Iterator[bytes]:
    """The records of an uncompressed member, by their stated lengths."""
    end = at + size
    while at < end:
        head, n = b"", 4096
        while (stop := head.find(b"\r\n\r\n")) < 0:
            if len(head) == end - at:
                raise ValueError("a record ends early")
            head, n = file.read(at, min(n, end - at)), 2 * n
        length = stop + 4 + int(_fields(head[:stop])[1]["content-length"])
        yield file.read(at, min(length, end - at))
        at += length + 4  # two line ends close a record


def records_in(stream: bytes) -> Iterator[bytes]:
    """The records of one decompressed stream, one by the format, more if packed together."""
    at = 0
    while at < len(stream):
        stop = stream.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError("a record ends early")
        end = stop + 4 + int(_fields(stream[at:stop])[1]["content-length"])
        yield stream[at:end]
        at = end + 4  # two line ends close a record


def read_records(uri: str) -> Iterator[dict]:
    """Every response, revisit and resource of one archive: by range reads along its indexes,
    each place once; archive members that no index names are read through."""
    file = RangeFile(uri)
    members = ZipDirectory(file)
    data = {n: members.stored(n) for n in members.members if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))}
    seen: dict[str, set[int]] = {n: set() for n in data}
    for index in (n for n in members.members if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))):
        for entry in index_lines(file, *members.stored(index), index.endswith(".gz")):
            if "offset" not in entry:
                continue
            name = entry.get("filename") or (next(iter(data)) if len(data) == 1 else "")
            name = name if name in data else "archive/" + name
            if name not in data:
                raise ValueError(f"an index names {name}, which is not in the archive")
            at = int(entry["offset"])
            if at not in seen[name]:
                seen[name].add(at)
                raw = file.read(data[name][0] + at, int(entry["length"]))
                yield parse_record(gzip.decompress(raw) if name.endswith(".gz") else raw)
    for name in (n for n, places in seen.items() if not places):
        streams = itertools.chain.from_iterable(records_in(x) for x in unpacked(chunks(file, *data[name]))) if name.endswith(".gz") else plain_records(file, *data[name])
        for raw in streams:
            if _fields(raw.partition(b"\r\n\r\n")[0])[1].get("warc-type") in KEPT_TYPES:
                yield parse_record(raw)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives listed in ``manifest(path)``; without ``payloads`` that
    column is null."""
    names = list(_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                rows: list[dict] = []
                for r in read_records(uri):
                    rows.append(r if payloads else r | {"payload": None})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pydict({n: pa.array([x[n] for x in rows], k) for n, k in _KINDS.items()})
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict({n: pa.array([x[n] for x in rows], k) for n, k in _KINDS.items()})

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 10_000)).mapInArrow(run, RECORD).select(*names)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every page,
    read back from the archives."""
    manifest = write_archives(pages, fresh_path(pages.sparkSession, "warc"), **options)
    return read_archives(manifest, payloads=False).drop("payload", "url")
