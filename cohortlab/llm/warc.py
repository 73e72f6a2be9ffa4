"""WARC archives: written with an index, read back by coalesced byte ranges of selected records.

``write_archives`` stores one record per page, each a gzip member of its own, in ``.warc.gz`` files of
at most ``ARCHIVE_BYTES``, and writes the index as it goes: file, offset, length, URL and digest of
every record.  A page whose payload of ``min_bytes`` or more equals that of another page becomes a
revisit of the one with the largest id, which alone holds the payload.  ``index_archives`` makes the
same index of archives that are there already.  ``read_records`` takes any selection of an index,
sorts it by file and offset, joins neighbouring ranges to single reads, and parses and verifies the
records; ``resolve`` fills in what revisits take from the record they refer to.

Files are opened through pyarrow's file systems (local and shared folders, S3, GCS, HDFS where its
client library is installed).  Each attempt of a task writes files of its own, and only those of the
attempts that Spark accepts are in the index, so a lost executor leaves no record twice or half.

Defined results: a null payload is empty, a null URL gives no URL field, control characters of a URL
are written as %XX, a null page id gives no id and ranks below all others.  Among equal payloads with
one page id the row read last holds the response.  Equal payloads have the same SHA-1, length and
64-bit hash.  Empty tables give an empty index.  Payloads of any length are kept whole; a record is the unit held in
memory.  Columns of the input other than the three named ones are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import drop_path, materialize, partitions_for, scratch_path

# Fixed values of the archive format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

MIN_BYTES = 1000  # shorter payloads are stored each time
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 8 << 20  # longest coalesced read, unless one record is longer
GAP_BYTES = 64 << 10  # unselected bytes that are read over rather than skipped
TASK_BYTES = 64 << 20  # selected bytes for a reading task
SCAN_BYTES = 1 << 20

_INDEX = "path string, offset long, length long, url string, digest string"
_RECORD = (
    "record_id string, record_type string, url string, page_id long, payload_bytes long, payload_digest string, "
    "refers_to string, intact boolean, payload binary"
)
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def _open_root(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style path, which may have one slash after its scheme."""
    path = re.sub(r"^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _fields(pairs: list[tuple[str, str | int | None]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None)


def record_bytes(run: uuid.UUID, date: str, row: int, page_id: int | None, url: str | None, payload: bytes, refers_row: int | None) -> tuple[bytes, str]:
    """A compressed record and the hexadecimal digest of its payload."""
    sha1 = hashlib.sha1(payload)
    named = lambda number: f"<{uuid.uuid5(run, str(number)).urn}>"
    http = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    revisit = refers_row is not None
    block = http if revisit else http + payload
    header = _fields(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", named(row)),
            ("WARC-Date", date),
            ("WARC-Target-URI", None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1.digest()).decode()),
            ("WARC-Refers-To", named(refers_row) if revisit else None),
            ("WARC-Profile", REVISIT_PROFILE if revisit else None),
            ("Page-ID", page_id),
            ("Content-Type", HTTP_TYPE),
            ("Content-Length", len(block)),
        ]
    )
    record = VERSION + b"\r\n" + header + b"\r\n" + block + b"\r\n\r\n"
    return zlib.compress(record, 6, wbits=31), sha1.hexdigest()


def parse_header(record: bytes) -> tuple[dict[str, str], int]:
    """Fields of a record by lower-case name, and where its block begins."""
    end = record.find(b"\r\n\r\n")
    if not record.startswith(b"WARC/") or end < 0:
        raise ValueError("no WARC record at this place")
    lines = record[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def _hex_digest(field: str | None) -> str | None:
    """A digest field's SHA-1, in either of the usual spellings, as lower-case hexadecimal."""
    name, _, value = (field or "").partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _payload(fields: dict[str, str], record: bytes, at: int) -> bytes:
    block = record[at : at + int(fields["content-length"])]
    if not fields.get("content-type", "").startswith("application/http"):
        return block
    head = block.find(b"\r\n\r\n")
    return block[head + 4 :] if head >= 0 else b""


def _parsed(data: bytes, with_payload: bool) -> tuple:
    record = zlib.decompress(data, wbits=31) if data[:2] == b"\x1f\x8b" else data
    fields, at = parse_header(record)
    kind, digest = fields["warc-type"], _hex_digest(fields.get("warc-payload-digest"))
    payload = None if kind == "revisit" else _payload(fields, record, at)
    found = None if payload is None else hashlib.sha1(payload).hexdigest()
    page = fields.get("page-id")
    return (
        fields["warc-record-id"],
        kind,
        fields.get("warc-target-uri"),
        None if page is None else int(page),
        None if payload is None else len(payload),
        digest if payload is None else found,
        fields.get("warc-refers-to"),
        payload is None or digest in (None, found),
        payload if with_payload else None,
    )


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_INDEX_TYPES = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string())]
_RECORD_TYPES = [
    ("record_id", pa.string()),
    ("record_type", pa.string()),
    ("url", pa.string()),
    ("page_id", pa.int64()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("refers_to", pa.string()),
    ("intact", pa.bool_()),
    ("payload", pa.binary()),
]


def _revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """Written table of row and refers_row of the rows whose payload another row holds."""
    key = ["digest", "bytes", "hash"]
    large = rows.where(F.col("bytes") >= min_bytes).select("row", "page_id", *key)
    top = F.max(F.struct("page_id", "row"))["row"].alias("refers_row")
    groups = large.groupBy(*key).agg(top, F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "groups")
    return materialize(large.join(groups, key).where("row != refers_row").select("row", "refers_row"), "revisits")


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = MIN_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write the archives below ``folder`` (default: the shared scratch folder); their written index."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary")
    numbered = pages.select(
        F.monotonically_increasing_id().alias("row"),
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(payload).alias("digest"),
        F.xxhash64(payload).alias("hash"),
    )
    pages_path = scratch_path(spark, "pages")
    numbered.write.option("compression", "zstd").parquet(pages_path)
    rows = spark.read.schema(numbered.schema).parquet(pages_path)
    run, date = uuid.uuid4(), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open_root(folder)
        system.create_dir(root, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                index = []
                for row, page_id, url, payload, refers_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data, digest = record_bytes(run, date, row, page_id, url, payload, refers_row)
                    if out is None or at and at + len(data) > archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    index.append((f"{folder}/{name}", at, len(data), url, digest))
                    at += len(data)
                if index:
                    yield _batch(index, _INDEX_TYPES)
        finally:
            if out is not None:
                out.close()

    columns = ["row", "page_id", "url", "payload", "refers_row"]
    joined = rows.join(_revisits(rows, min_bytes), "row", "left").select(*columns)
    index = materialize(joined.mapInArrow(write, _INDEX), "index")
    drop_path(spark, pages_path)
    return index


def _members(system: pafs.FileSystem, path: str) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of each record of an archive, compressed by record or not at all."""
    with system.open_input_stream(path, compression=None) as source:
        held, start = source.read(SCAN_BYTES), 0
        while held:
            if held[:2] == b"\x1f\x8b":
                machine, parts, used = zlib.decompressobj(wbits=31), [], 0
                while not machine.eof:
                    parts.append(machine.decompress(held[used:]))
                    used = len(held) - len(machine.unused_data)
                    if not machine.eof:
                        more = source.read(SCAN_BYTES)
                        if not more:
                            raise ValueError(f"{path} ends inside a record")
                        held += more
                record = b"".join(parts)
            else:
                while (end := held.find(b"\r\n\r\n")) < 0 and (more := source.read(SCAN_BYTES)):
                    held += more
                fields, end = parse_header(held)
                used = end + int(fields["content-length"]) + 4
                while len(held) < used:
                    if not (more := source.read(max(SCAN_BYTES, used - len(held)))):
                        raise ValueError(f"{path} ends inside a record")
                    held += more
                record = held[:used]
            yield start, used, record
            start, held = start + used, held[used:]
            if len(held) < 2:
                held += source.read(SCAN_BYTES)


def index_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Index of archives that are there already; one task reads one archive."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["path"].to_pylist():
                system, path = _open_root(name)
                index = []
                for offset, length, record in _members(system, path):
                    fields, _ = parse_header(record)
                    index.append((name, offset, length, fields.get("warc-target-uri"), _hex_digest(fields.get("warc-payload-digest"))))
                    if len(index) == 10_000:
                        yield _batch(index, _INDEX_TYPES)
                        index = []
                if index:
                    yield _batch(index, _INDEX_TYPES)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return materialize(listed.mapInArrow(scan, _INDEX), "index")


def coalesce(ranges: Iterator[tuple[str, int, int]], read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of the sorted (path, offset, length) ranges that one read of a file serves."""
    path, run = "", []
    for name, offset, length in ranges:
        if run and (name != path or offset - (run[-1][0] + run[-1][1]) > gap_bytes or offset + length - run[0][0] > read_bytes):
            yield path, run
            run = []
        path = name
        run.append((offset, length))
    if run:
        yield path, run


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name; ``payload`` False verifies payloads but leaves them out."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = (r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("path", "offset", "length")), strict=True))
        source, opened = None, ""
        try:
            for path, run in coalesce(ranges):
                if path != opened:
                    if source is not None:
                        source.close()
                    system, place = _open_root(path)
                    source, opened = system.open_input_file(place), path
                first = run[0][0]
                data = source.read_at(run[-1][0] + run[-1][1] - first, first)
                yield _batch([_parsed(data[a - first : a - first + n], payload) for a, n in run], _RECORD_TYPES)
        finally:
            if source is not None:
                source.close()

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    least = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = partitions_for(total, TASK_BYTES, least)
    dealt = index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset")
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(fetch, _RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Written ``records`` with the page id that revisits refer to and the length of the payload they share."""
    targets = records.where("record_type != 'revisit'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page"), F.col("payload_bytes").alias("refers_bytes")
    )
    revisits = records.where("record_type = 'revisit'").join(targets, "refers_to", "left")
    others = records.where("record_type != 'revisit'")
    none = F.lit(None).cast("long")
    columns = ["page_id", "url", "record_id", "record_type", "payload_digest", "intact"]
    return others.select(*columns, "payload_bytes", none.alias("refers_page")).unionByName(
        revisits.select(*columns, F.col("refers_bytes").alias("payload_bytes"), "refers_page")
    )


def archive_round(pages: DataFrame) -> DataFrame:
    """Write every page, read all records back by the index: one row per page.

    A record whose payload differs from its digest ends the job.
    """
    records = materialize(read_records(write_archives(pages), payload=False), "records")
    wrong = F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))
    return resolve(records).select(
        "page_id",
        "payload_bytes",
        F.when(F.col("intact"), F.col("payload_digest")).otherwise(wrong).alias("payload_digest"),
        "record_type",
        F.col("refers_page").alias("refers_to"),
        "url",
    )
