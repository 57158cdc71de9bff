r"""WARC archives packaged as ZIP: writing them, and reading records by ranges without extraction.

The writer stores archive/data.warc.gz, one gzip member for each record, and indexes/index.cdxj, a
line of JSON for each record, so a record's bytes lie in the ZIP file as they are. The reader finds
the end-of-central-directory record (and its ZIP64 form) from the file's tail, reads the directory,
each member's local header and the indexes, and turns them into runs of neighbouring records of
about RUN bytes. Runs are the unit of parallel work: each is one range read, whatever the archive's
size. They go to as many tasks as there are shuffle partitions, or to fewer if the manifest's sizes
call for fewer.

Any stored member below archive/ that is named *.warc or *.warc.gz is read, and any index below
indexes/ (CDXJ lines, CDX lines with a header that names their fields, either gzipped or not),
whose lines are matched to the members by file name. Records of a member that no index line names
are found by walking it from its start: gzip members by their ends, plain records by their lengths.

Files are reached through pyarrow's file systems, so any store it knows by URI will do. Each task
attempt writes files of its own; only those that a finished task has named in the manifest are
read, so lost executors and repeated tasks leave no doubled records. The manifest is one file that
one task writes: tasks run again name other files, which several writers might see half of.

Equal payloads of MIN_REVISIT bytes or more are written once: the record with the largest page_id
is the response and the others are revisits that refer to it. Only digests and ids are grouped, by
partial aggregation first, and joined back with plain exchanges on either side.

Defined cases: a null html is an empty payload, a null url is empty; a null page_id ranks below all
others, and rows that share the largest page_id and the payload are all responses; repeated rows
are records of their own; an empty table gives an empty result; columns other than page_id, url and
html are ignored. A payload may be of any length that fits a task's memory a few times over. A
deflated archive member, an index line that names no member, or bytes that are no record, raise
ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again_shuffled, materialize, shared_dir, table

MIN_REVISIT = 1000
RUN, ROLL = 8 << 20, 1 << 30
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVES, INDEXES = "archive/", "indexes/"
LEVEL, PIECE = 5, 1 << 20


# ZIP directories


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int


def _tail(f, size: int) -> tuple[bytes, int]:
    n = min(size, 22 + 65535 + 20)
    return f.read_at(n, size - n), size - n


def members(f, size: int) -> list[Member]:
    """The central directory of an open random-access file: end record, or ZIP64 locator and end record where a field overflows."""
    tail, start = _tail(f, size)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        raise ValueError("no ZIP end record")
    count, length, offset = struct.unpack("<H2I", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        end = f.read_at(56, where)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack("<3Q", end[32:56])
    directory = f.read_at(length, offset)
    out, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack("<2H", directory[at + 8 : at + 12])
        stored, whole, n_name, n_extra, n_comment = struct.unpack("<2I3H", directory[at + 20 : at + 34])
        (header,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<2H", extra[:4])
            if tag == 1:  # ZIP64: the fields that overflow, in this order
                big = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole = big.pop(0) if whole == 0xFFFFFFFF and big else whole
                stored = big.pop(0) if stored == 0xFFFFFFFF and big else stored
                header = big.pop(0) if header == 0xFFFFFFFF and big else header
            extra = extra[4 + n :]
        out.append(Member(name, method, whole, stored, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(f, member: Member) -> int:
    """Where a stored member's bytes begin: after its local header, whose extra field may differ from the directory's."""
    if member.method:
        raise ValueError(f"{member.name} is compressed: its records cannot be read by range")
    head = f.read_at(30, member.header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack("<2H", head[26:30])
    return member.header + 30 + n_name + n_extra


# Records


def record(page_id, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:page:{quote(str(i), safe='') if i is not None else 'null'}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int
    digest: str

    @property
    def type(self) -> str:
        return self.headers["warc-type"]


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def _is_digest(said: str, payload: bytes) -> bool:
    """Whether a sha1 said in hex or, as most archives have it, in base 32 is the payload's. Other algorithms are taken at their word."""
    name, _, value = said.rpartition(":")
    own = hashlib.sha1(payload).digest()
    return name.lower() not in ("", "sha1") or value.lower() == own.hex() or value.upper() == base64.b32encode(own).decode()


def parse(raw: bytes) -> Record:
    """A record from its bytes. Size and digest are the payload's own, and the digest must be the one promised, if one is; of a revisit they are what its headers say. Only HTTP responses have headers before their payload."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _headers(head)
    n = int(headers["content-length"])
    if len(rest) < n or rest[n:].strip(b"\r\n"):
        raise ValueError("a WARC record of another length than it says")
    block, said, kind = rest[:n], headers.get("warc-payload-digest", ""), headers["warc-type"]
    is_http = headers.get("content-type", "").startswith("application/http")
    if kind == "revisit":
        http = _headers(block.partition(b"\r\n\r\n")[0]) if is_http else {}
        return Record(headers, b"", int(http.get("content-length", 0)), said.removeprefix("sha1:"))
    payload = block.partition(b"\r\n\r\n")[2] if is_http and kind == "response" else block
    if said and kind in ("response", "resource") and not _is_digest(said, payload):
        raise ValueError("a payload that doesn't fit its digest")
    return Record(headers, payload, len(payload), hashlib.sha1(payload).hexdigest())


# Writing


DATE = "20240101000000"


def _searchable(url: str) -> str:
    """The host's labels from the last to the first, then the rest: what index lines are looked up by."""
    host, slash, rest = url.partition("://")[2].partition("/")
    return quote(",".join(reversed(host.lower().split("."))) + ")" + slash + rest, safe=",)/?&=:~") or "-"


class Writer:
    """One archive, written front to back: sizes follow the data, so nothing is held but the index."""

    def __init__(self, stream):
        self.zip, self.index, self.at = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), io.BytesIO(), 0
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, raw: bytes, url: str = "", digest: str = "") -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.data.write(member)
        line = {"url": url, "digest": f"sha1:{digest}", "filename": DATA.removeprefix(ARCHIVES), "offset": str(self.at), "length": str(len(member))}
        self.index.write(f"{_searchable(url)} {DATE} {json.dumps(line)}\n".encode())
        self.at += len(member)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write(self.index.getvalue())
        self.zip.close()


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, html, digest, refers_to (null: a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("html") >= min_revisit).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("digest", "last")
    revisits = large.join(again_shuffled(groups), "digest").where("page_id is null or page_id < last").distinct().select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), F.col("last").alias("refers_to"))
    return rows.join(again_shuffled(revisits), F.expr("digest = __d and page_id <=> __p"), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes pages(page_id, url, html) to ZIP archives below folder; returns their manifest: path, n_bytes, n_records."""

    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}"
        done, writer, stream, n = [], None, None, 0

        def finish():
            writer.close()
            stream.close()
            path = f"{base}/{name}-{len(done)}.zip"
            done.append((f"{folder}/{name}-{len(done)}.zip", files.get_file_info(path).size, n))

        for batch in batches:
            for i in range(batch.num_rows):
                if writer is None:
                    stream = files.open_output_stream(f"{base}/{name}-{len(done)}.zip")
                    writer, n = Writer(stream), 0
                page_id, url, html, digest, refers_to = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "refers_to"))
                writer.add(record(page_id, url, html.encode(), digest, refers_to), url, digest)
                n += 1
                if writer.at >= ROLL:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "n_bytes", "n_records"])

    # One file for the manifest, a row for each archive: on local disks each file that Spark writes costs an executor three process starts.
    return materialize(decide(pages, min_revisit).mapInArrow(run, "path string, n_bytes bigint, n_records bigint").repartition(1))


# Reading


def index_lines(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) from an index: CDXJ, or CDX whose header says which fields are g, V and S. Lines without a length are left to walking."""
    fields = None
    for line in (zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8").splitlines():
        brace = line.find("{")
        if line.lstrip().startswith("CDX "):
            fields = line.split()[1:]
        elif line.startswith("!") or not line.strip():
            continue
        elif fields:
            row = dict(zip(fields, line.split(), strict=False))
            if row.get("S", "-").isdigit():
                yield row["g"], int(row["V"]), int(row["S"])
        elif brace >= 0:
            row = json.loads(line[brace:])
            if "length" in row:
                yield row["filename"], int(row["offset"]), int(row["length"])
        else:
            raise ValueError(f"no index line: {line[:80]}")


def walked(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a member of size bytes at start, from one pass over it, PIECE by PIECE."""
    at = 0
    while at < size:
        head = f.read_at(min(2, size - at), start + at)
        if head == b"\x1f\x8b":
            packed, n = zlib.decompressobj(31), 0
            while not packed.eof:
                piece = f.read_at(min(PIECE, size - at - n), start + at + n)
                if not piece:
                    raise ValueError("a record that is cut off")
                packed.decompress(piece)
                n += len(piece) - len(packed.unused_data)
        else:
            raw = b""
            while b"\r\n\r\n" not in raw:
                piece = f.read_at(min(PIECE, size - at - len(raw)), start + at + len(raw))
                if not piece:
                    raise ValueError("not a WARC record")
                raw += piece
            head = raw.partition(b"\r\n\r\n")[0]
            if not head.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            n = len(head) + 4 + int(_headers(head)["content-length"]) + 4
        yield at, n
        at += n


def located(f, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the ZIP file, length) of every record of an open archive, member by member."""
    found = members(f, size)
    data = {m.name: m for m in found if m.name.startswith(ARCHIVES) and m.name.endswith((".warc", ".warc.gz"))}
    places: dict[str, list[tuple[int, int]]] = {}
    for m in found:
        if m.name.startswith(INDEXES) and not m.name.endswith("/"):
            for name, offset, length in index_lines(f.read_at(m.size, data_offset(f, m))):
                full = name if name in data else ARCHIVES + name
                if full not in data:
                    raise ValueError(f"an index names {name}, which the archive doesn't hold")
                places.setdefault(full, []).append((offset, length))
    for name, m in data.items():
        base = data_offset(f, m)
        for offset, length in sorted(set(places[name])) if name in places else walked(f, base, m.size):
            yield base + offset, length


def runs_of(f, size: int, limit: int = RUN) -> Iterator[tuple[int, list[int]]]:
    """(offset in the ZIP file, lengths of consecutive records) for an open archive."""
    start, lengths, total = None, [], 0
    for offset, length in located(f, size):
        if lengths and (total + length > limit or offset != start + total):
            yield start, lengths
            lengths, total = [], 0
        if not lengths:
            start = offset
        lengths.append(length)
        total += length
    if lengths:
        yield start, lengths


def read_records(f, start: int, lengths: list[int]) -> Iterator[Record]:
    """The records of one run, by a single range read."""
    data, at = f.read_at(sum(lengths), start), 0
    for n in lengths:
        raw = data[at : at + n]
        yield parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
        at += n


def page_of(ident: str | None) -> str | None:
    """The page that a record id of our own stands for; null for a null page; other ids as they are."""
    own = ident is not None and ident.startswith("<urn:page:")
    return None if ident == "<urn:page:null>" else ident[len("<urn:page:") : -1] if own else ident


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """manifest(path) -> page_id string, url, payload_bytes, payload_digest, record_type, refers_to string, and payload if asked for. page_id and refers_to are record ids; of ids that write_archives gave, the page's own."""

    def index(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = pafs.FileSystem.from_uri(path)
                with files.open_input_file(name) as f:
                    rows = list(runs_of(f, f.size()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([s for s, _ in rows]), pa.array([x for _, x in rows], pa.list_(pa.int64()))], ["path", "start", "lengths"])

    def records(batches):
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths")), strict=True):
                files, name = pafs.FileSystem.from_uri(path)
                out = []
                with files.open_input_file(name) as f:
                    for r in read_records(f, start, lengths):
                        mine, other = (page_of(r.headers.get(k)) for k in ("warc-record-id", "warc-refers-to"))
                        out.append((mine, r.headers.get("warc-target-uri"), r.payload_bytes, r.digest, r.type, other) + ((r.payload,) if payloads else ()))
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=False)], names[: len(out[0])])

    n = parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "n_bytes" in manifest.columns:  # a task for each RUN bytes, four a core at least
        n_bytes = manifest.agg(F.sum("n_bytes")).first()[0] or 0
        parts = min(n, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // RUN)))
    runs = manifest.select("path").repartition(n).mapInArrow(index, "path string, start bigint, lengths array<bigint>").repartition(parts)
    return runs.mapInArrow(records, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads)


def op1_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")
    return read_archives(manifest).select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM q
"""
