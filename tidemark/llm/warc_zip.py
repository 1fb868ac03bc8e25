"""WARC records in ZIP packages: write them, find them by the ZIP directories, and read them by range."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, bounded_batches, join_per_key, scratch_dir, stored

#: A package is closed when its records hold this many bytes; a larger record has one of its own.
PACKAGE_BYTES = 16_000_000
#: Records that lie together are read at once up to this many bytes.
RANGE_BYTES = 4_000_000
_DATA, _INDEX = "archive/data.warc", "indexes/index.cdxj"

# Fixed values of the ZIP format: signatures and record layouts.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_LOCAL_HEAD = struct.Struct("<4s5H3I2H")
_CENTRAL_HEAD = struct.Struct("<4s6H3I5H2I")
_END_HEAD = struct.Struct("<4s4H2IH")
_END64_HEAD = struct.Struct("<4sQ2H2I4Q")
_LOCATOR64_HEAD = struct.Struct("<4sIQI")
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF

ReadAt = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def zip_stored(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> bytes:
    """A ZIP package of stored members, each given in pieces; with ZIP64 fields where needed or asked for."""
    out, central, at = [], [], 0
    for name, pieces in members:
        raw, size, crc = name.encode(), sum(map(len, pieces)), 0
        for p in pieces:
            crc = binascii.crc32(p, crc)
        wide = zip64 or size >= _MAX32 or at >= _MAX32
        extra = struct.pack("<2H3Q", 1, 24, size, size, at) if wide else b""
        local_extra = struct.pack("<2H2Q", 1, 16, size, size) if wide else b""
        shown, place = (_MAX32, _MAX32) if wide else (size, at)
        head = _LOCAL_HEAD.pack(_LOCAL, 45 if wide else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(local_extra)) + raw + local_extra
        central.append(_CENTRAL_HEAD.pack(_CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        out += [head, *pieces]
        at += len(head) + size
    directory = b"".join(central)
    out.append(directory)
    wide = zip64 or at >= _MAX32 or len(central) >= _MAX16
    if wide:
        end = _END64_HEAD.pack(_END64, _END64_HEAD.size - 12, 45, 45, 0, 0, len(central), len(central), len(directory), at)
        out += [end, _LOCATOR64_HEAD.pack(_LOCATOR64, 0, at + len(directory), 1)]
        out.append(_END_HEAD.pack(_END, 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))
    else:
        out.append(_END_HEAD.pack(_END, 0, 0, len(central), len(central), len(directory), at, 0))
    return b"".join(out)


def read_directory(read: ReadAt, size: int) -> list[Member]:
    """Members by the central directory, or by the ZIP64 one where the end record points to it."""
    tail_at = max(0, size - _END_HEAD.size - _MAX16)
    tail = read(tail_at, size - tail_at)
    place = tail.rfind(_END, 0, len(tail) - _END_HEAD.size + 4)
    while place >= 0 and place + _END_HEAD.size + struct.unpack_from("<H", tail, place + 20)[0] != len(tail):
        place = tail.rfind(_END, 0, place)  # the signature can also stand in the comment
    if place < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, at, _ = _END_HEAD.unpack_from(tail, place)
    if count == _MAX16 or _MAX32 in (length, at):
        locator = read(tail_at + place - _LOCATOR64_HEAD.size, _LOCATOR64_HEAD.size)
        if locator[:4] == _LOCATOR64:
            end64 = _LOCATOR64_HEAD.unpack(locator)[2]
            head = _END64_HEAD.unpack(read(end64, _END64_HEAD.size))
            if head[0] != _END64:
                raise ValueError("the ZIP64 locator points to no ZIP64 end record")
            count, length, at = head[7], head[8], head[9]
    directory, members, i = read(at, length), [], 0
    for _ in range(count):
        if directory[i : i + 4] != _CENTRAL:
            raise ValueError("central directory is damaged")
        f = _CENTRAL_HEAD.unpack_from(directory, i)
        method, plain, n_name, n_extra, n_comment, header_at = f[4], f[9], f[10], f[11], f[12], f[16]
        name = directory[i + _CENTRAL_HEAD.size :][:n_name].decode("utf-8", "replace")
        extra = directory[i + _CENTRAL_HEAD.size + n_name :][:n_extra]
        j = 0
        while j + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, j)
            if kind == 1:  # the wide values of those fields that are full, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, j + 4))
                if plain == _MAX32:
                    plain = wide.pop(0)
                if f[8] == _MAX32 and wide:
                    wide.pop(0)
                if header_at == _MAX32 and wide:
                    header_at = wide.pop(0)
            j += 4 + n
        members.append(Member(name, method, plain, header_at))
        i += _CENTRAL_HEAD.size + n_name + n_extra + n_comment
    return members


def data_start(read: ReadAt, member: Member) -> int:
    head = _LOCAL_HEAD.unpack(read(member.header_at, _LOCAL_HEAD.size))
    if head[0] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header_at + _LOCAL_HEAD.size + head[9] + head[10]


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record of an HTTP response, or a revisit of the page ``refers_to`` without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    # A line break in a url would end the header.
    uri = "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "urn:page:none")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Header fields of a record, the length and digest of its payload, and the payload of a response."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    n = int(said.get(b"content-length", len(payload)))
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != n):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    page = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    other = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    return {"page_id": int(page) if page else None, "url": fields.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": int(other) if other else None, "payload": payload if kind == "response" else None}


def record_ranges(read: ReadAt, size: int) -> Iterator[tuple[int, int]]:
    """Places of all records in a package: by its indexes, and by their headers where a stored member has none."""
    members = [m for m in read_directory(read, size) if m.method == 0]
    starts = {m.name: data_start(read, m) for m in members}
    indexed = set()
    for m in members:
        if m.name.startswith("indexes/") and m.name.endswith(".cdxj"):
            for line in read(starts[m.name], m.size).splitlines():
                if line:
                    entry = json.loads(line[line.index(b"{") :])
                    indexed.add(entry["filename"])
                    yield starts[entry["filename"]] + int(entry["offset"]), int(entry["length"])
    for m in members:
        if m.name.startswith("archive/") and m.name.endswith(".warc") and m.name not in indexed:
            at = 0
            while at < m.size:
                span, head = 4096, b""
                while b"\r\n\r\n" not in head and len(head) < m.size - at:
                    head = read(starts[m.name] + at, min(span, m.size - at))
                    span *= 2
                before, _, _ = head.partition(b"\r\n\r\n")
                n = next(int(x.split(b":")[1]) for x in before.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                yield starts[m.name] + at, len(before) + 4 + n + 4
                at += len(before) + 4 + n + 4


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, as the executors see it, and the path within."""
    return pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _packer(folder: str, package_bytes: int, zip64: bool, index: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, within = _opened(folder)
        files.create_dir(within, recursive=True)
        records: list[bytes] = []
        lines: list[str] = []
        at = 0

        def package() -> pa.RecordBatch:
            members = [(_DATA, records)] + ([(_INDEX, ["\n".join(lines).encode()])] if index else [])
            data = zip_stored(members, zip64)
            name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"  # a task that runs again writes files of its own
            with files.open_output_stream(f"{within}/{name}") as out:
                out.write(data)
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64())], ["path", "size"])

        for batch in batches:
            for page, url, html, other in zip(*(batch.column(i) for i in range(4)), strict=True):
                record = warc_record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "replace"), other.as_py())
                lines.append("urn:page:%s %s" % ("" if page.as_py() is None else page.as_py(), json.dumps({"offset": at, "length": len(record), "filename": _DATA})))
                records.append(record)
                at += len(record)
                if at >= package_bytes:
                    yield package()
                    records, lines, at = [], [], 0
        if records:
            yield package()

    return run


def write_packages(pages: DataFrame, folder: str, *, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = True, index: bool = True) -> DataFrame:
    """WARC records of ``pages`` (page_id, url, html) in ZIP files of about ``package_bytes`` in ``folder``.

    Of pages with equal html in UTF-8 of ``least_bytes`` or more, the one with the smallest page_id is a
    response and the others revisit it; smaller ones are all responses. Null html counts as empty. Pages
    without an id are responses; repeated rows of one id are alike. A payload that several pages share is told
    by its SHA-1 and length, found by a partial aggregation; pages meet those few digests, not each other. Beyond
    ``BROADCAST_IDS`` such payloads the ids of pages meet them first, a common payload's spread over all tasks, and
    texts are shuffled by page_id.

    ``folder``: a path or URI that all executors can write to. Returns (path, size), one row per file: each is
    written by one task from the rows that it reads, when the result is computed. A task that runs again writes
    new files; only those of the returned rows count.
    """
    bounded_batches(pages.sparkSession)
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    size, digest = F.octet_length("html").cast("long"), F.unhex(F.sha1(F.col("html").cast("binary")))
    named = rows.where(F.col("page_id").isNotNull()).select("page_id", size.alias("n"), digest.alias("d")).where(F.col("n") >= least_bytes)
    shared = stored(named.groupBy("d", "n").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("other_id"), F.count(F.lit(1)).alias("pages")).where("first_id < other_id").select("d", "n", "first_id", "pages"), "shared-payloads")
    if shared.count() <= BROADCAST_IDS:
        with_first = rows.withColumns({"d": digest, "n": size}).join(F.broadcast(shared), ["d", "n"], "left")
        refers = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))
        placed = with_first.select("page_id", "url", "html", refers.alias("refers_to"))
    else:
        key = F.xxhash64("d", "n").alias("k")
        firsts = shared.groupBy(key).agg(F.sum("pages").alias("pages"), F.collect_list(F.struct("d", "n", "first_id")).alias("firsts"))
        met = join_per_key(named.withColumn("k", key), firsts, "k", "pages", named.count()).withColumn("f", F.filter("firsts", lambda f: (f["d"] == F.col("d")) & (f["n"] == F.col("n")))[0]["first_id"])
        revisits = stored(met.where("f <> page_id").select("page_id", F.col("f").alias("refers_to")).distinct(), "revisits")
        placed = rows.where("page_id IS NOT NULL").join(revisits, "page_id", "left").select("page_id", "url", "html", "refers_to").union(rows.where("page_id IS NULL").withColumn("refers_to", F.lit(None).cast("long")))
    return placed.mapInArrow(_packer(folder.rstrip("/"), package_bytes, zip64, index), "path string, size long")


def _list_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring records of each package, found by its directories and indexes."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            if path is None:
                continue
            files, within = _opened(path)
            with files.open_input_file(within) as f:
                runs: list[list[tuple[int, int]]] = []
                for at, n in record_ranges(lambda at, n: f.read_at(n, at), f.size()):  # noqa: B023
                    if runs and runs[-1][-1][0] + runs[-1][-1][1] == at and at + n - runs[-1][0][0] <= RANGE_BYTES:
                        runs[-1].append((at, n))
                    else:
                        runs.append([(at, n)])
            yield pa.record_batch([pa.array([path] * len(runs), pa.string()), pa.array([r[0][0] for r in runs], pa.int64()), pa.array([[n for _, n in r] for r in runs], pa.list_(pa.int64()))], ["path", "at", "lengths"])


def read_packages(packages: DataFrame, *, with_payload: bool = False, path_col: str = "path") -> DataFrame:
    """Records of the ZIP packages at the given paths or URIs, which the executors can open.

    The directory at the end of a package, the ZIP64 one where there is one, leads to the stored members, their
    indexes to the records; those are all that is read of it at first. The ranges of the records are dealt over
    tasks, which seek and read them, neighbours of up to ``RANGE_BYTES`` at once; nothing is unpacked, and no package is
    loaded whole, so its size has no bound. Digests are checked. Members without
    an index are walked from header to header. Compressed members are passed over; a damaged package raises.
    Null paths give no rows, a path given twice gives its records twice. Returns page_id, payload_bytes, payload_digest, record_type,
    refers_to, and with_payload: url and payload (null for a revisit).
    """
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("url", pa.string()), ("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, within = _opened(path)
                with files.open_input_file(within) as f:
                    data, start, rows = memoryview(f.read_at(sum(lengths), at)), 0, []
                for n in lengths:
                    got = parse_record(bytes(data[start : start + n]))
                    start += n
                    rows.append({k: got[k] for k in schema.names})
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    bounded_batches(packages.sparkSession)
    ranges = packages.select(F.col(path_col)).mapInArrow(_list_ranges, "path string, at long, lengths array<long>")
    return ranges.repartition("path", "at").mapInArrow(run, ddl)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the packages to the shared folder and read them back; see ``write_packages`` and ``read_packages``."""
    folder = f"{scratch_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    return read_packages(stored(write_packages(pages, folder, **options), "packages"))
