"""WARC archives with an index: write once, then read selected records by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workspace import materialise

# An archive is closed and the next one begun once it has this many bytes.
ARCHIVE_BYTES = 256 << 20
# Records whose gap is at most this are read with one request of at most RANGE_BYTES.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
# When records are read, archives are cut into spans of this many bytes, about one to a task.
SPAN_BYTES = 16 << 20
# Repeated payloads up to this count are sent to all tasks.
BROADCAST_PAYLOADS = 100_000

INDEX = (
    "record_id string, url string, record_type string, refers_to string, payload_digest string, "
    "payload_bytes long, archive string, offset long, length long"
)
RECORDS = (
    "record_id string, url string, record_type string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def plan_records(
    pages: DataFrame, record_id: str, url: str, payload: str, min_revisit_bytes: int = 0,
    broadcast_payloads: int = BROADCAST_PAYLOADS,
) -> DataFrame:
    """(record_id, url, payload, record_type, refers_to) of every page, as strings.

    Of pages with equal payloads of at least ``min_revisit_bytes``, the one with the largest
    id is the response and the others revisit it; repeated rows of that id are responses
    too. Smaller payloads are all responses. A null payload is empty. Only digests are
    grouped, and the few that repeat meet the pages again.
    """
    rows = pages.select(
        F.col(record_id).alias("_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    ).withColumn("_sha", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= min_revisit_bytes)
    repeated = materialise(
        large.groupBy(F.col("_sha").alias("_of")).agg(F.max("_id").alias("_target"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 AND _target IS NOT NULL").drop("_n"), "payloads")
    if repeated.count() <= broadcast_payloads:
        repeated = F.broadcast(repeated)
    met = rows.join(
        repeated, (F.col("_sha") == F.col("_of")) & (F.octet_length("payload") >= min_revisit_bytes), "left")
    revisit = F.col("_target").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_target"))
    return met.select(
        F.col("_id").cast("string").alias("record_id"), "url", "payload",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_target").cast("string")).alias("refers_to"),
    )


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def _one_line(value: str | None) -> str | None:
    """Control characters and blanks percent-encoded, as a header needs."""
    return value if value is None else "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in value)


def _record(row: dict, date: str) -> tuple[bytes, str, int]:
    """One gzip member with its payload digest and payload size."""
    payload = (row["payload"] or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD + (b"" if revisit else payload)
    head = _header([
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:record:{_one_line(row['record_id'] or '')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<urn:record:{_one_line(row['refers_to'])}>" if revisit else None),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush(), digest, len(payload)


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records below ``folder``, one gzip member each; returns the stored index.

    Each task writes archives of its own under fresh names, so a repeated task leaves at
    most a file that no index row names. ``folder`` must be reachable from all executors.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    packed, digest, size = _record(row, date)
                    out.write(packed)
                    rows.append({
                        "record_id": row["record_id"], "url": row["url"], "record_type": row["record_type"],
                        "refers_to": row["refers_to"], "payload_digest": digest, "payload_bytes": size,
                        "archive": name, "offset": at, "length": len(packed),
                    })
                    at += len(packed)
                yield pa.RecordBatch.from_pylist(rows, schema=index_schema)
        finally:
            if out is not None:
                out.close()

    index_schema = pa.schema([
        (f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string())
        for f in T._parse_datatype_string(INDEX).fields
    ])
    return materialise(records.mapInArrow(write, INDEX), "warc-index")


def _parsed(member: bytes) -> dict:
    """A record's fields and payload; the digest of a response is checked."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    refers = fields.get("WARC-Refers-To")
    return {
        "record_type": fields["WARC-Type"], "payload_digest": digest,
        "refers_to": refers and refers.removeprefix("<urn:record:").removesuffix(">"),
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload": None if revisit else payload,
    }


def coalesced(rows: list[dict], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[list[dict]]:
    """Runs of index rows, sorted by archive and offset, that one read covers."""
    run: list[dict] = []
    for row in rows:
        if run and (
            row["archive"] != run[-1]["archive"] or row["offset"] - run[-1]["offset"] - run[-1]["length"] > gap
            or row["offset"] + row["length"] - run[0]["offset"] > most
        ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(index: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Records of the given index rows, read from the archives in ``folder``.

    Index rows are dealt by archive and span of the archive, sorted by offset, and near
    neighbours are fetched by one byte-range read, so a selection reads little more than
    its own bytes. A revisit has a null payload; its digest and size are the response's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        try:
            for batch in batches:
                for run in coalesced(batch.to_pylist(), gap, most):
                    if run[0]["archive"] != name:
                        if source is not None:
                            source.close()
                        name = run[0]["archive"]
                        source = store.open_input_file(f"{base}/{name}")
                    start = run[0]["offset"]
                    data = source.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
                    got = [
                        {"record_id": r["record_id"], "url": r["url"]}
                        | _parsed(data[r["offset"] - start: r["offset"] - start + r["length"]]) for r in run
                    ]
                    yield pa.RecordBatch.from_pylist(got, schema=record_schema)
        finally:
            if source is not None:
                source.close()

    kinds = {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    record_schema = pa.schema([
        (f.name, kinds[f.dataType.simpleString()]) for f in T._parse_datatype_string(RECORDS).fields])
    span = F.floor(F.col("offset") / SPAN_BYTES)
    # Index rows are small, what they fetch is not: the number of tasks follows the bytes to read.
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("record_id", "url", "archive", "offset", "length").repartition(
        -(-total // SPAN_BYTES) or 1, "archive", span).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(read, RECORDS)
