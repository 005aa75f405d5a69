"""WARC archives: one gzip member a record, written from pages and read in order.

Writing: pages whose payloads (html in UTF-8, null as empty) are equal form a group,
told by SHA-256 and length; the page with the largest page_id is a response, the
others revisit it. Each task writes archives of some `roll` bytes into a shared
folder, under names of its own; the rows that it returns say which archives count,
so those of a task that was lost or ran twice are never read.

Reading: an archive is a row, streamed by one task. Members are inflated piece by
piece, so neither an archive nor a record has to fit into memory unless its payload
is asked for; blocks are framed by Content-Length, and the digests of block and
payload are verified. A member that can't be read (not gzip, cut off, no record,
wrong length) gives one row whose status says why, and reading goes on at the next
place that begins like a member and holds a record. Revisits are resolved by the
record that they refer to.

Equal rows (same page_id and payload) are each written, all of one type; a null
page_id is smaller than any other, and a group without other ids is all responses.
A null url is left out, white space and control characters in one are percent-encoded.
Other columns are ignored, whatever their names. No pages give no archives.

Folders are opened by pyarrow (file, hdfs, viewfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b16encode, b32encode
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut
from .kept import nothing

#: Groups of equal payloads that may be broadcast, after a count: some 60 bytes each.
SMALL = 500_000
_PIECE, _HEAD = 1 << 18, 1 << 16
_MAGIC, _END = b"\x1f\x8b\x08", b"\r\n\r\n"
_NAMES = uuid.UUID("5f0e6d0c-58c5-4f0f-9d5e-0a1b6f3c2d11")


class Damaged(ValueError):
    """A member that holds no whole record."""


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, as all machines can open it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub(r"^file:/+", "file:///", uri)


# ---------------------------------------------------------------- writing


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest.hex()}')}>"


def sha1_label(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member of a record; fields without a value are left out."""
    fields = [*fields, ("WARC-Block-Digest", sha1_label(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress(head.encode()), packer.compress(block), packer.compress(_END), packer.flush()])


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit of the page refers_to with the head alone. digest: the payload's SHA-256, that record ids are made from."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if again else None), ("WARC-Payload-Digest", sha1_label(payload)),
        ("X-Page-Id", None if page_id is None else str(page_id)), ("Content-Type", "application/http;msgtype=response"),
    ]
    return record(fields, http if again else http + payload)


def _written(batches, folder: str, roll: int, date: str):
    nothing()
    files, root = pa.fs.FileSystem.from_uri(folder)
    out, done = None, []

    def close():
        out.close()
        done.append((name, records, size))

    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(*(c for c in batch.columns), strict=True):
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                out, records, size = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                head = record(info, b"format: WARC File Format 1.1\r\n")
                out.write(head)
                size += len(head)
            member = page_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date)
            out.write(member)
            records, size = records + 1, size + len(member)
            if size >= roll:
                close()
                out = None
    if out is not None:
        close()
    if done:
        names, records, sizes = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names]), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])


def write(pages: DataFrame, folder: str, least: int = 0, roll: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of all pages (page_id, url, html); path, records and bytes of each, as a table.

    least: payloads of fewer bytes are never revisited, all are responses.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    files, root = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.where("n > 1 and first is not null").select("digest", "first"), "equal-pages")
    by = F.broadcast(groups) if groups.count() <= SMALL else groups  # else payloads are shuffled by their digest, skewed ones in parts
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(by, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return cut(rows.mapInArrow(partial(_written, folder=folder, roll=roll, date=date), "path string, records long, bytes long"), "archives")


# ---------------------------------------------------------------- reading


class Archive:
    """Members of an open file, in order; `offset` is where the next one begins."""

    def __init__(self, raw):
        self.raw, self.data, self.offset, self._unpack = raw, b"", 0, None

    def begin(self) -> bool:
        """Whether there is another member."""
        self.data = self.data or self.raw.read(_PIECE)
        self._unpack, self._used = zlib.decompressobj(31), 0
        return bool(self.data)

    def read(self) -> bytes:
        """The next piece of the member; empty at its end."""
        unpack = self._unpack
        while not unpack.eof:
            data = self.data or self.raw.read(_PIECE)
            if not data:
                raise Damaged("cut off")
            try:
                out = unpack.decompress(data, _PIECE)
            except zlib.error:
                raise Damaged("not gzip") from None
            self.data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            self._used += len(data) - len(self.data)
            if out:
                return out
        return b""

    def end(self) -> int:
        """The length of the member that was read to its end."""
        self.offset += self._used
        return self._used

    def skip(self) -> bool:
        """Go on to the next place after the start of this member that begins like one; whether there is any."""
        at, tail = self.offset + 1, b""
        self.raw.seek(at)
        while data := self.raw.read(_PIECE):
            found = (tail + data).find(_MAGIC)
            if found >= 0:
                self.offset, self.data = at - len(tail) + found, b""
                self.raw.seek(self.offset)
                return True
            tail, at = (tail + data)[-2:], at + len(data)
        return False


def _until_blank(read: Callable[[], bytes], have: bytes = b"") -> tuple[bytes, bytes]:
    """A head up to its blank line, and what was read behind it."""
    while (at := have.find(_END)) < 0:
        piece = read() if len(have) < _HEAD else b""
        if not piece:
            raise Damaged("no head")
        have += piece
    return have[:at], have[at + len(_END) :]


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines)}


def _agrees(said: str | None, algorithms: dict[str, hashlib._Hash]) -> bool:
    """Whether a digest of a record is right; one that is missing or of an unknown kind is."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() not in algorithms:
        return True
    found = algorithms[kind.lower()].digest()
    return value.upper().rstrip("=") in (b32encode(found).decode().rstrip("="), b16encode(found).decode())


def _hashes(said: str | None) -> dict[str, hashlib._Hash]:
    kind = (said or "").partition(":")[0].lower()
    return {k: hashlib.new(k) for k in ("sha1", *([kind] if kind in ("md5", "sha256", "sha512") else []))}


def read_record(archive: Archive, keep: bool) -> dict:
    """The record of a member that has begun; keep: with its payload."""
    head, have = _until_blank(archive.read)
    if not head.startswith(b"WARC/"):
        raise Damaged("no record")
    fields = _fields(head)
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Damaged("no length")
    left = int(fields["content-length"])
    kind, http = fields.get("warc-type"), fields.get("content-type", "").startswith("application/http")
    block, payload = _hashes(fields.get("warc-block-digest")), _hashes(fields.get("warc-payload-digest"))
    parts, size = [], 0

    def pieces() -> Iterator[bytes]:
        nonlocal have, left
        while left:
            have = have or archive.read()
            if not have:
                raise Damaged("wrong length")
            piece, have = have[:left], have[left:]
            left -= len(piece)
            for h in block.values():
                h.update(piece)
            yield piece

    source = pieces()
    rest = _until_blank(lambda: next(source, b""))[1] if http and left else b""
    while rest or (rest := next(source, b"")):
        for h in payload.values():
            h.update(rest)
        size += len(rest)
        if keep:
            parts.append(rest)
        rest = b""
    while len(have) < len(_END) and (piece := archive.read()):
        have += piece
    if have != _END or archive.read():
        raise Damaged("wrong length")
    said = fields.get("warc-payload-digest")
    right = _agrees(fields.get("warc-block-digest"), block) and (kind == "revisit" or _agrees(said, payload))
    page = fields.get("x-page-id", "")
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "page_id": int(page) if re.fullmatch(r"-?\d{1,19}", page) else None,
        "refers_to_id": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": (said or "").rpartition(":")[2] if kind == "revisit" else b32encode(payload["sha1"].digest()).decode(),
        "status": "ok" if right else "digest differs", "payload": b"".join(parts) if keep else None,
    }


def records_of(raw, keep: bool = False) -> Iterator[dict]:
    """Every record of an open archive, in order; one row, of which only status and offset tell anything, for each stretch that can't be read."""
    archive, lost = Archive(raw), False
    while archive.begin():
        offset = archive.offset
        try:
            row = read_record(archive, keep)
        except Damaged as why:
            if not lost:
                yield {"offset": offset, "status": str(why)}
            lost = True
            if not archive.skip():
                return
            continue
        lost = False
        yield {"offset": offset, "length": archive.end()} | row


_READ = {
    "path": "string", "offset": "long", "length": "long", "record_type": "string", "record_id": "string", "target_uri": "string", "page_id": "long", "refers_to_id": "string",
    "payload_bytes": "long", "payload_digest": "string", "status": "string", "payload": "binary",
}


def _records(batches, keep: bool):
    nothing()
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [x for x in _READ if keep or x != "payload"]
    schema = pa.schema([(x, types[_READ[x]]) for x in names])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, name = pa.fs.FileSystem.from_uri(path)
            rows, size = [], 0
            with files.open_input_file(name) as raw:
                for row in records_of(raw, keep):
                    rows.append({"path": path} | row)
                    size += 200 + len(row.get("payload") or b"")
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the archives (path), one task an archive if there are enough: where it is, its named fields, size and SHA-1 (base 32) of its payload as it was read (of a revisit: the digest that it states), and status.

    payload: with the payload itself, as bytes.
    """
    tasks = max(1, archives.count())
    paths = archives.select("path").repartition(tasks, "path")
    return paths.mapInArrow(partial(_records, keep=payload), ", ".join(f"{k} {v}" for k, v in _READ.items() if payload or k != "payload"))


def resolve(records: DataFrame) -> DataFrame:
    """Records that were read, as a table, with the payload_bytes of revisits and refers_to, the page_id of what they refer to.

    Status is `unresolved` where that record is not among them, or `digest differs`
    where its payload has another digest. Records of one id are one.
    """
    of = F.struct("payload_bytes", "payload_digest", "page_id")
    known = records.where("record_type = 'response' and record_id is not null").groupBy(F.col("record_id").alias("known_id")).agg(F.min(of).alias("known"))
    known = cut(known, "responses")
    visit = F.col("record_type").eqNullSafe("revisit")
    others = records.where(~visit).withColumn("refers_to", F.lit(None).cast("long"))
    status = F.when(F.col("known_id").isNull(), "unresolved").when(F.col("known.payload_digest") != F.col("payload_digest"), "digest differs").otherwise(F.col("status"))
    visits = records.where(visit).join(known, F.col("refers_to_id") == F.col("known_id"), "left")
    visits = visits.withColumns({"status": status, "payload_bytes": F.col("known.payload_bytes"), "refers_to": F.col("known.page_id")}).drop("known_id", "known")
    return others.unionByName(visits)
