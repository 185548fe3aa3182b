"""WARC archives with an index of byte ranges.

Writing gives one gzip member a record, so a record can be read alone, and yields
the index: file, offset, length, url and digest. Each attempt of a task writes files
of its own name, and only the index that Spark commits names them, so a lost
executor leaves at most files that nothing refers to. Reading takes index rows,
sorts them by file and offset and joins neighbours into one range read each.

Of payloads equal in digest and at least ``MIN_REVISIT`` bytes long, the smallest
``page_id`` is the response (every row with it, if rows repeat), the others are
revisits without a payload of their own. A null html is an empty payload; a null
``page_id`` is never the smallest; a null url is left out of the header. An empty
table gives no archive.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import shared_folder, table

MIN_REVISIT = 100
FILE_BYTES = 256 << 20
#: Range reads are joined over gaps up to the first, up to the second in size.
MAX_GAP, MAX_RANGE = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, file string, offset long, length long"
)
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with size, digest, record type and referred page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select(
        "page_id",
        "url",
        "html",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    shared = (
        sized.where(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    other = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return sized.join(shared, F.col("payload_digest") == F.col("digest"), "left").select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("first")).alias("refers_to"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(row: dict) -> bytes:
    """One compressed record."""
    revisit = row["record_type"] == "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_urn(row['page_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    body = b"" if revisit else (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + body
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:>" else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": None if fields["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2],
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
        ("length", pa.int64()),
    ])
    out, name, at = None, "", 0
    for batch in batches:
        index = []
        for i in range(batch.num_rows):  # one page at a time is held as Python objects
            row = batch.slice(i, 1).to_pylist()[0]
            if out is None or at >= FILE_BYTES:
                if out is not None:
                    out.close()
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            data = record_bytes(row)
            out.write(data)
            del row["html"]
            index.append(row | {"file": name, "offset": at, "length": len(data)})
            at += len(data)
        yield pa.RecordBatch.from_pylist(index, schema)
    if out is not None:
        out.close()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives below ``folder``; returns the index, stored in ``folder/index``."""
    spark = pages.sparkSession
    index = plan_records(pages).mapInArrow(lambda b: _write(b, f"{folder}/archives"), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Rows (file, offset, length) in order, joined into the ranges to read."""
    group: list[tuple[str, int, int]] = []
    for row in rows:
        if group:
            end = group[-1][1] + group[-1][2]
            near = row[0] == group[0][0] and 0 <= row[1] - end <= MAX_GAP
            if not near or row[1] + row[2] - group[0][1] > MAX_RANGE:
                yield group
                group = []
        group.append(row)
    if group:
        yield group


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])
    opened, source = "", None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        for group in _ranges(rows):
            if group[0][0] != opened:
                opened = group[0][0]
                source = store.open_input_file(f"{root}/{opened}")
            begin = group[0][1]
            data = source.read_at(group[-1][1] + group[-1][2] - begin, begin)
            yield pa.RecordBatch.from_pylist(
                [parse_record(zlib.decompress(data[o - begin : o - begin + n], 31)) for _, o, n in group],
                schema,
            )


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows, read by joined byte ranges."""
    ordered = (
        index.select("file", "offset", "length")
        .repartitionByRange("file", "offset")
        .sortWithinPartitions("file", "offset")
    )
    return ordered.mapInArrow(lambda b: _read(b, f"{folder}/archives"), RECORD)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    records = read_warc(write_warc(table(spark, folder, "pages"), path), path)
    response = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long"))
        .otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256))
        .otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
with sized as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes,
    sha256(coalesce(html, '')) as payload_digest
  from pages
), firsts as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first
  from sized
)
select page_id, payload_bytes, payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from firsts
"""

QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": SQL}
