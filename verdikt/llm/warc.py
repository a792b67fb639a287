"""WARC archives as a Python data source named ``warc``.

Writing: each task writes gzip-member-per-record files of about ``roll`` bytes into the folder, under names of its own; the
driver's commit writes a manifest of its own with the files of the tasks that succeeded. What lost or repeated tasks left
behind is in no manifest and is never read; an aborted job deletes its files; overwriting deletes those of former commits.

Reading: one partition a file of the manifests (or of the folder, for foreign archives without one; a gzip file can't be
parted, so a large one is one task, of bounded memory but for the payload at hand). Predicates on record
type, record id, target URI, digest and reference are pushed down: equality, IN, prefix and null tests. A record's
headers are inflated first; a record that a predicate rejects, or whose payload isn't asked for (option ``payload`` =
false), is skipped by the compressed length in its gzip header, without inflating its payload. Plain ``.warc`` files and
members without that length are read too, at the cost of inflating.

The session setting spark.sql.python.filterPushdown.enabled is switched on by ``read``. Paths go through
``pyarrow.fs``, so file:, hdfs: and object store URIs work where pyarrow does.

Defined results: a null payload is written as empty; a null id leaves the record id out and is read as null; an empty
table gives a manifest without records; repeated rows are records of their own; further columns are not written; page_id
is read as a long. Headers may have any length. A file that ends inside a record, or a record without a length, is an
error, never a shorter result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import cut, drop_folder, shared_dir

MANIFEST = "_manifest"
ROLL = 64 << 20
LEAST_REVISIT = 100
#: Columns that filters are pushed down for, and their headers.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, content_length long, payload binary, file string, position long"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark takes where it has none (``fs.defaultFS``), so that executors open the same
    files as Spark does."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def member(head: bytes, body: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field "sl" holds its compressed and inflated lengths."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    # the headers end at a flush, so a reader can stop there
    data = deflate.compress(head) + deflate.flush(zlib.Z_SYNC_FLUSH) + deflate.compress(body) + deflate.flush()
    total = 10 + 2 + 12 + len(data) + 8
    size = len(head) + len(body)
    extra = b"sl" + struct.pack("<HII", 8, total, size & 0xFFFFFFFF)
    crc = zlib.crc32(body, zlib.crc32(head))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", crc, size & 0xFFFFFFFF)


def record(kind: str, payload: bytes, headers: dict[str, str | None]) -> tuple[bytes, bytes]:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(payload)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), payload + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.roll = options["path"], int(options.get("roll", ROLL))
        self.date, self.overwrite = options.get("date", "1970-01-01T00:00:00Z"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out = [], None
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None)
                    out.write(member(*record("warcinfo", b"software: verdikt\r\n", {"WARC-Date": self.date, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"})))
                payload = (row.get("payload") or b"") if row["record_type"] != "revisit" else b""
                headers = {"WARC-Record-ID": row.get("record_id"), "WARC-Date": self.date, "WARC-Target-URI": row.get("target_uri"), "WARC-Refers-To": row.get("refers_to"), "WARC-Payload-Digest": row.get("payload_digest")}
                if row.get("payload_length") is not None:
                    headers["WARC-Payload-Length"] = str(row["payload_length"])
                headers = {k: v if v is None else v.replace("\r", " ").replace("\n", " ") for k, v in headers.items()}
                out.write(member(*record(row["record_type"], payload, headers)))
                if out.tell() >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        """A manifest for each commit, so that two writers never rewrite each other's; overwriting deletes what was before."""
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        before = _listed(fs, root) if self.overwrite else []
        name = f"{MANIFEST}-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/{name}.tmp", compression=None) as out:
            out.write(json.dumps(sorted(f for m in messages if m is not None for f in m.files)).encode())
        fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
        # manifests first: a file that none names is read no more
        for old in sorted(before, key=lambda f: not f.startswith(MANIFEST)):
            fs.delete_file(f"{root}/{old}")

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                try:
                    fs.delete_file(f"{root}/{f}")
                except OSError:
                    continue


def _listed(fs, root: str) -> list[str]:
    """The folder's manifests and the files that they name."""
    manifests = _named(fs, root, lambda x: x.startswith(MANIFEST) and x.endswith(".json"))
    return [*manifests, *_files(fs, root, manifests)]


def _named(fs, root: str, test) -> list[str]:
    from pyarrow import fs as pafs

    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if test(f.base_name))


def _files(fs, root: str, manifests: list[str]) -> list[str]:
    out: list[str] = []
    for m in manifests:
        with fs.open_input_stream(f"{root}/{m}", compression=None) as f:
            out += json.loads(f.read())
    return sorted(out)


@dataclass
class FilePart(InputPartition):
    root: str
    file: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append((column, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "some", None))
            elif isinstance(f, IsNull):
                self.tests.append((column, "none", None))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        fs, root = filesystem(self.path)
        manifests = _named(fs, root, lambda x: x.startswith(MANIFEST) and x.endswith(".json"))
        files = _files(fs, root, manifests) if manifests else _named(fs, root, lambda x: x.endswith((".warc", ".warc.gz")))
        return [FilePart(self.path, f) for f in files]

    def wanted(self, head: dict[str, str]) -> bool:
        for column, test, value in self.tests:
            own = head.get(HEADERS[column].lower())
            if not {"in": lambda: own in value and own is not None, "starts": lambda: own is not None and own.startswith(value), "some": lambda: own is not None, "none": lambda: own is None}[test]():
                return False
        return True

    def read(self, part: FilePart | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a plan without partitions still has one task
            return
        fs, root = filesystem(part.root)
        rows, size = [], 0
        with fs.open_input_file(f"{root}/{part.file}") as f:
            for position, head, payload in records(f, self.wanted, self.payload):
                length = int(head.get("content-length", 0))
                full = head.get("warc-payload-length")
                rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), head.get("warc-payload-digest"), int(full) if full is not None else length, length, payload, part.file, position))
                size += len(payload or b"")
                if size >= 8 << 20 or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def parse_headers(block: bytes) -> dict[str, str]:
    head: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            head[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            head[last] = v.strip()
    return head


class Truncated(ValueError):
    """A file ends inside a record, or a record's headers can't be read."""


def _plain(f, at: int, total: int, wanted, with_payload: bool, chunk: int) -> tuple[int, dict[str, str] | None, bytes | None]:
    """Where the next record begins, and headers and payload of the record at ``at`` (headers None if it isn't wanted)."""
    f.seek(at)
    block = b""
    while (end := block.find(b"\r\n\r\n")) < 0:
        more = f.read(chunk)
        if not more:
            raise Truncated(f"the file ends in the headers of the record at {at}")
        block += more
    head = parse_headers(block[:end])
    body = at + end + 4
    if not head.get("content-length", "").isdigit():
        raise Truncated(f"the record at {at} has no length")
    length = int(head["content-length"])
    if body + length > total:
        raise Truncated(f"the file ends in the record at {at}")
    keep, payload = wanted(head), None
    if keep and with_payload:
        f.seek(body)
        payload = f.read(length)
    return body + length, head if keep else None, payload


def _member(f, at: int, total: int, start: bytes, wanted, with_payload: bool, chunk: int) -> tuple[int, dict[str, str] | None, bytes | None]:
    """As ``_plain`` for a gzip member. Headers are inflated first; a known length skips the rest."""
    known = struct.unpack("<I", start[16:20])[0] if start[3] & 4 and start[12:14] == b"sl" else 0
    if at + known > total:
        raise Truncated(f"the file ends in the record at {at}")
    inflate, used = zlib.decompressobj(31), len(start)

    def more(size: int) -> bytes:
        nonlocal used
        raw = inflate.unconsumed_tail
        if not raw:
            raw = f.read(chunk)
            used += len(raw)
        if not raw:
            raise Truncated(f"the file ends in the record at {at}")
        return inflate.decompress(raw, size)

    out = inflate.decompress(start, 1 << 16)
    while b"\r\n\r\n" not in out and not inflate.eof:
        out += more(1 << 16)
    end = out.find(b"\r\n\r\n")
    if end < 0 and out.strip():
        raise Truncated(f"the record at {at} has no end of headers")
    head = parse_headers(out[:end].lstrip()) if end >= 0 else {}
    keep = end >= 0 and wanted(head)
    need = keep and with_payload
    if known and not need:
        return at + known, head if keep else None, None
    parts = [out[end + 4 :]]
    while not inflate.eof:
        got = more(1 << 20)
        if need:
            parts.append(got)
    payload = None
    if need:
        length = int(head.get("content-length", 0))
        payload = b"".join(parts)[:length]
        if len(payload) < length:
            raise Truncated(f"the record at {at} is shorter than its length")
    return at + used - len(inflate.unused_data), head if keep else None, payload


def records(f, wanted, with_payload: bool, chunk: int = 1 << 16) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """position, headers and payload (None if not asked for) of the records that are wanted, for either kind of file."""
    at, total = 0, f.size()
    while at < total:
        f.seek(at)
        start = f.read(chunk)
        if blank := len(start) - len(start.lstrip(b"\r\n")):
            at += blank
            continue
        if start[:2] == b"\x1f\x8b":
            after, head, payload = _member(f, at, total, start, wanted, with_payload, chunk)
        else:
            after, head, payload = _plain(f, at, total, wanted, with_payload, chunk)
        if head is not None:
            yield at, head, payload
        at = after


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(qualified(spark, path))


def write(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").option("path", qualified(rows.sparkSession, path)).save()


def page_records(pages: DataFrame) -> DataFrame:
    """A record for each page: of equal payloads of 100 bytes or more the smallest page_id's is the response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = rows.select("page_id", F.octet_length("payload").alias("n"), "digest").where(f"n >= {LEAST_REVISIT}")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(None).cast("string").alias("warc_date"),
        F.when(again, urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"),
        F.lit(None).cast("long").alias("content_length"), F.when(~again, F.col("payload")).alias("payload"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("position"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives into the shared folder and read them back: responses with payloads, revisits by headers.
    The archives are deleted once the result is written."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(page_records(pages), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    full = read(spark, path).where("record_type = 'response'")
    full = full.select(F.when(F.col("record_id").isNotNull(), number("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    seen = read(spark, path, payload=False).where("record_type = 'revisit'")
    seen = seen.select(F.when(F.col("record_id").isNotNull(), number("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    out = cut(full.unionByName(seen), "warc-records")
    drop_folder(spark, path)
    return out


SQL = """
with p as (select page_id, coalesce(html, '') t, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first from p where n >= 100 group by d)
select p.page_id, n payload_bytes, p.d payload_digest, case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end record_type,
       case when f.first <> p.page_id then f.first end refers_to
from p left join f on p.d = f.d and p.n >= 100
"""
