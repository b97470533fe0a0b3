"""WARC records in ZIP-packaged archives, read in place.

Writing: every task streams gzip records into ZIP archives of bounded size: a stored
(not compressed) member ``archive/data.warc.gz`` and a stored index
``indexes/index.cdxj`` with the offset and length of every record. A file is named by
its attempt, and only the manifest a job returns says which files count, so retried and
speculative tasks do no harm.

Reading: the end of the archive gives the central directory (and, where present, the
ZIP64 end record and extra fields); the directory and the local headers give the
place of each stored member; the index gives the records; each record is read by byte
range (neighbouring ranges together) and parsed. Nothing is extracted to disk, and one
archive's records are spread over many tasks.

Equal payloads of at least ``min_revisit`` bytes are written once: the row with the
largest id is the response, the others are revisit records that name it.

Defined cases: a null payload is empty; a null url has no WARC-Target-URI; a row with
a null id is never the named response unless all its copies have null ids (then all
are responses); repeated rows of the largest id are all responses; an empty table
writes no archive; columns other than the three named are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare, workdir

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20      # an archive is closed beyond this
SPLIT_BYTES = 8 << 20         # records of one archive are dealt to tasks in such stretches
RANGE_BYTES = 4 << 20         # neighbouring records are read together up to this
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# ---- files (any store pyarrow reaches; the path of Spark's shared folder) -------

def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


# ---- records ----------------------------------------------------------------------

def record_bytes(kind: str, page_id, url: str | None, digest: str, payload: bytes, refers_to, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    if kind == "response":
        http += b"Content-Length: %d\r\n" % len(payload)
    block = http + b"\r\n" + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (after the HTTP head) of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("record is cut off")
    return headers, block.partition(b"\r\n\r\n")[2]


# ---- ZIP directories --------------------------------------------------------------

class RangeReader:
    """Byte ranges of one file."""

    def __init__(self, path: str):
        fs, p = open_fs(path)
        self.file = fs.open_input_file(p)
        self.size = self.file.size()

    def __call__(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"range {offset}+{length} is outside the archive")
        return data


def members(read, size: int) -> list[dict]:
    """All members from the central directory: name, method, sizes and ``data`` (the
    offset of the content). ``read(offset, length)`` gives bytes."""
    tail_at = max(0, size - 65557 - 20)
    tail = read(tail_at, size - tail_at)
    at = len(tail) - 22
    while at >= 0:
        at = tail.rfind(b"PK\x05\x06", 0, at + 4)
        if at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        end64, = struct.unpack_from("<Q", tail, at - 12)
        record = read(end64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, out, pos = read(start, length), [], 0
    for _ in range(count):
        if directory[pos:pos + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, = struct.unpack_from("<H", directory, pos + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, pos + 20)
        header, = struct.unpack_from("<I", directory, pos + 42)
        name = directory[pos + 46:pos + 46 + n_name].decode()
        extra = directory[pos + 46 + n_name:pos + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:   # ZIP64: the values that did not fit, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                if plain == 0xFFFFFFFF:
                    plain = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if header == 0xFFFFFFFF:
                    header = wide.pop(0)
            extra = extra[4 + n:]
        local = read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        data = header + 30 + sum(struct.unpack_from("<HH", local, 26))
        out.append({"name": name, "method": method, "packed": packed, "plain": plain, "data": data})
        pos += 46 + n_name + n_extra + n_comment
    return out


# ---- writing --------------------------------------------------------------------------

class _Archive:
    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
        fs, p = open_fs(self.path)
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(p)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.index = 0, io.BytesIO()

    def add(self, raw: bytes, page_id, url, digest: str) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.member.write(packed)
        entry = {"id": page_id, "url": url, "offset": self.size, "length": len(packed), "digest": digest}
        self.index.write(json.dumps(entry).encode() + b"\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX, self.index.getvalue())
        self.zip.close()
        self.out.close()
        return self.path, self.size


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all rows; returns the stored manifest (path, bytes) of the archives."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     payload.alias("payload"), F.sha1(payload).alias("digest"))
    # ids of payloads met more than once, found without moving payloads
    repeated = (x.filter(F.octet_length("payload") >= min_revisit)
                .groupBy(F.col("digest").alias("same_digest"))
                .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    x = x.join(repeated, x["digest"] == repeated["same_digest"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False))
    x = x.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest",
                 F.when(revisit, F.col("refers_to")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, body, digest, refers_to = (c[i].as_py() for c in cols)
                kind = "response" if refers_to is None else "revisit"
                archive = archive or _Archive(folder)
                archive.add(record_bytes(kind, page_id, url, digest, body or b"", refers_to, date), page_id, url, digest)
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "bytes": [d[1] for d in done]})

    prepare(pages.sparkSession)
    return materialise(x.mapInArrow(run, "path string, bytes long"), "warc-manifest")


# ---- reading --------------------------------------------------------------------------

def read_index(manifest: DataFrame) -> DataFrame:
    """``path, offset, length, page_id, url, digest`` of every record: ``offset`` counts
    from the start of the archive file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                read = RangeReader(path)
                found = {m["name"]: m for m in members(read, read.size)}
                for m in (found[DATA], found[INDEX]):
                    if m["method"] != 0 or m["packed"] != m["plain"]:
                        raise ValueError(f"{path}: {m['name']} is not stored")
                lines = read(found[INDEX]["data"], found[INDEX]["plain"]).splitlines()
                for at in range(0, len(lines), 10_000):
                    entries = [json.loads(x) for x in lines[at:at + 10_000]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(entries), pa.string()),
                         pa.array([found[DATA]["data"] + e["offset"] for e in entries], pa.int64()),
                         pa.array([e["length"] for e in entries], pa.int64()),
                         pa.array([e["id"] for e in entries], pa.int64()),
                         pa.array([e["url"] for e in entries], pa.string()),
                         pa.array([e["digest"] for e in entries], pa.string())],
                        names=["path", "offset", "length", "page_id", "url", "digest"])

    return manifest.select("path").mapInArrow(
        run, "path string, offset long, length long, page_id long, url string, digest string")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Range-read the records of (a selection of) the index:
    ``page_id, record_type, payload_bytes, payload_digest, refers_to[, payload]``. The digest
    of a response is computed from its bytes and must equal the header's; a revisit has the
    header's digest and no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read = None, None
        for batch in batches:
            batch = batch.sort_by([("path", "ascending"), ("offset", "ascending")])
            paths, offsets, lengths, ids = (batch.column(i).to_pylist() for i in range(4))
            i = 0
            while i < len(paths):
                j, stop = i, offsets[i]
                while j < len(paths) and paths[j] == paths[i] and offsets[j] <= stop and \
                        (j == i or offsets[j] + lengths[j] - offsets[i] <= RANGE_BYTES):
                    stop = max(stop, offsets[j] + lengths[j])
                    j += 1
                if paths[i] != path:
                    path, read = paths[i], RangeReader(paths[i])
                chunk, out = read(offsets[i], stop - offsets[i]), []
                for k in range(i, j):
                    raw = zlib.decompress(chunk[offsets[k] - offsets[i]:offsets[k] - offsets[i] + lengths[k]], 31)
                    head, payload = parse_record(raw)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = head.get("WARC-Refers-To")
                    response = head["WARC-Type"] == "response"
                    if response and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: digest differs at {offsets[k]}")
                    out.append((ids[k], head["WARC-Type"], len(payload) if response else None, digest,
                                int(refers[len("<urn:page:"):-1]) if refers else None, payload if response else None))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                n = 6 if with_payload else 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols[:n], kinds)],
                    names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][:n])
                i = j

    spread = index.select("path", "offset", "length", "page_id").repartition(
        F.col("path"), F.floor(F.col("offset") / SPLIT_BYTES))
    return spread.mapInArrow(run, "page_id long, record_type string, payload_bytes long, payload_digest string, "
                                  "refers_to long" + (", payload binary" if with_payload else ""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Fill a revisit's ``payload_bytes`` from the response it names."""
    named = (records.filter("record_type = 'response'").filter(F.col("page_id").isNotNull())
             .groupBy(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"))
             .agg(F.first("payload_bytes").alias("r_bytes")))
    x = records.join(named, (records["refers_to"] == named["r_id"]) &
                     (records["payload_digest"] == named["r_digest"]), "left")
    return x.withColumn("payload_bytes", F.coalesce("payload_bytes", "r_bytes")).drop("r_id", "r_digest", "r_bytes")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    manifest = write_archives(pages, workdir(spark, "warc"))
    records = materialise(read_records(read_index(manifest.repartition("path"))), "warc-records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
