"""WARC archives: writing with revisit records and segments, reading with reassembly.

``write_archive`` makes one record per page.  The payload goes out in chunked
transfer framing behind an HTTP head; a block longer than a segment is cut
into a first ``response`` record and ``continuation`` records that name their
origin, and the last one states the total length.  Of pages with equal
payloads (of ``least_revisit`` bytes or more) the largest page id is a
``response`` and the others are ``revisit`` records that refer to it.  Spark's
text writer writes the files, in gzip form: its line separator is the record
separator, so any file system that Spark knows will do, and lost tasks are
written again.  A file has at most ``RECORDS_PER_FILE`` records, none longer
than a segment and its head, so about 34 MB before compression.

``read_archive`` splits the files into records, groups continuation records by
origin, orders them by segment number, verifies numbers and total length, and
decodes the framing.  A record that fails has ``complete`` false and no payload.

Null html counts as empty and a null url is left out.  Of repeated rows with
the same id and payload one is the response.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_path, staged, table

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 1024
GAP = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = """record_id string, record_type string, page_id long, url string, payload_digest string,
    refers_to_id string, segment int, origin_id string, total_length long, block binary"""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def from_chunks(body: bytes) -> bytes | None:
    """The payload, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _head(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + GAP + block


def records_of(page_id: int | None, url: str | None, payload: bytes, kind: str, unique: bool, segment: int) -> Iterator[bytes]:
    """The records of one page, each without the separator that follows it."""
    digest = payload_digest(payload)
    shared = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    own = f"<urn:uuid:{uuid.uuid4()}>" if kind == "revisit" or not unique else shared
    where = " ".join(url.split()) if url else None
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", where),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if kind == "revisit":
        fields += [
            ("WARC-Refers-To", shared),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
        yield _head([*fields, ("Content-Type", "application/http; msgtype=response")], head)
        return
    block = head + to_chunks(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield _head([*fields, *first, ("Content-Type", "application/http; msgtype=response")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        yield _head(
            [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                ("WARC-Date", DATE),
                ("WARC-Target-URI", where),
                ("WARC-Segment-Origin-ID", own),
                ("WARC-Segment-Number", n),
                ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None),
            ],
            part,
        )


def squeezed(batches):
    """A ``mapInArrow`` function: html to its zlib form."""
    import pyarrow as pa

    for b in batches:
        packed = pa.array([zlib.compress(x.as_buffer(), 3) for x in b.column("html")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), packed], ["page_id", "url", "sha", "size", "packed"])


def revisits(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """``(page_id, url, packed, kind, unique)``: the html in zlib form, and whether its payload is in a group.

    Groups are found on digests alone; only compressed pages move.  Of rows that share id and payload
    the one with the smallest url leads, found by an aggregate of such rows alone, however many there are.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    keys = rows.groupBy("page_id", "sha", F.octet_length("html").alias("size")).count()
    grouped = keys.where(F.col("size") >= least_revisit)
    groups = grouped.groupBy("sha").agg(F.max("page_id").alias("top"), F.sum("count").alias("rows")).where("rows > 1")
    top = F.col("page_id").eqNullSafe(F.col("top"))
    flags = grouped.join(groups, "sha").select("page_id", "sha", top.alias("is_top"), (top & (F.col("count") > 1)).alias("several"))
    packed = rows.select("page_id", "url", "sha", F.octet_length("html").alias("size"), F.col("html").cast("binary").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    packed = packed.mapInArrow(squeezed, f"page_id {kind}, url string, sha string, size int, packed binary")
    told = packed.alias("r").join(
        flags.alias("f"), F.col("r.page_id").eqNullSafe(F.col("f.page_id")) & (F.col("r.sha") == F.col("f.sha")), "left"
    )
    columns = ["r.page_id", "r.url", "r.size", "r.packed", "r.sha", "f.is_top", F.coalesce("f.several", F.lit(False)).alias("several")]
    numbered = staged(told.select(*columns, F.monotonically_increasing_id().alias("row")), "pages")
    several = numbered.where("several")
    first = several.groupBy("page_id", "sha").agg(F.min(F.struct("url", "row"))["row"].alias("row")).withColumn("picked", F.lit(True))
    picked = several.join(first.select("row", "picked"), "row", "left").withColumn("is_top", F.coalesce("picked", F.lit(False)))
    rows = numbered.where("not several").unionByName(picked.select(numbered.columns)).withColumn("grouped", F.col("is_top").isNotNull())
    return rows.select(
        "page_id",
        "url",
        "packed",
        F.when(F.coalesce("is_top", F.lit(True)), "response").otherwise("revisit").alias("kind"),
        (F.col("grouped") | (F.col("size") >= least_revisit)).alias("unique"),
    )


def write_archive(
    pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, per_file: int = RECORDS_PER_FILE, least_revisit: int = 0
) -> None:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page_id, url, packed, kind, unique in b.itertuples(index=False, name=None):
                number = None if pd.isna(page_id) else int(page_id)
                out += records_of(number, url, zlib.decompress(packed), kind, unique, segment)
            yield pd.DataFrame({"record": out})

    bound_batches(pages.sparkSession)
    revisits(pages, least_revisit).mapInPandas(encode, "record binary").select(
        F.col("record").cast("string").alias("value")
    ).write.option("lineSep", GAP.decode()).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def parse(content: bytes) -> Iterator[tuple]:
    """The records of one archive file."""
    at = 0
    while at < len(content):
        end = content.index(GAP, at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        f = dict(x.split(": ", 1) for x in lines[1:])
        size = int(f["Content-Length"])
        block = content[end + 4 : end + 4 + size]
        if content[end + 4 + size : end + 8 + size] != GAP:
            raise ValueError(f"record at byte {at} has no end")
        at = end + 8 + size
        number = lambda k, f=f: int(f[k]) if k in f else None
        yield (
            f["WARC-Record-ID"],
            f["WARC-Type"],
            number("WARC-Page-ID"),
            f.get("WARC-Target-URI"),
            f.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
            f.get("WARC-Refers-To"),
            number("WARC-Segment-Number"),
            f.get("WARC-Segment-Origin-ID"),
            number("WARC-Segment-Total-Length"),
            block,
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as stored, continuation records too."""
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.int32(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(",")]

    def decode(batches):
        for b in batches:
            for content in b.column(0):
                rows = list(parse(gzip.decompress(content.as_buffer())))
                for i in range(0, len(rows), 256):
                    part = list(zip(*rows[i : i + 256], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(decode, RECORD_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records with their ``blocks`` in order, found by origin and number; ``complete`` if nothing is missing."""
    part = F.struct("segment", "block")
    joined = (
        records.where("segment is not null")
        .groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(
            *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "page_id", "url", "payload_digest", "refers_to_id")],
            F.max("total_length").alias("total_length"),
            F.array_sort(F.collect_list(part)).alias("parts"),
        )
    )
    numbered = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + F.octet_length(p["block"]))
    columns = ["record_id", "record_type", "page_id", "url", "payload_digest", "refers_to_id", "blocks", "complete"]
    whole = joined.withColumn("blocks", F.transform("parts", lambda p: p["block"])).withColumn(
        "complete", F.coalesce(numbered & (total == F.col("total_length")), F.lit(False))
    )
    single = records.where("segment is null").withColumn("blocks", F.array("block")).withColumn("complete", F.lit(True))
    return single.select(columns).unionByName(whole.select(columns))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, record_type, page_id, url, payload_digest, refers_to_id, complete, payload)``."""
    schema = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, complete boolean, payload binary"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            payloads = []
            for kind, blocks, complete, digest in zip(b.record_type, b.blocks, b.complete, b.payload_digest, strict=True):
                body = b"".join(blocks).partition(GAP)[2] if complete else b""
                payload = from_chunks(body) if complete and kind == "response" else None
                payloads.append(payload if payload is not None and payload_digest(payload) == digest else None)
            out = b.drop(columns="blocks").assign(payload=payloads)
            out["complete"] = [p is not None or (c and k != "response") for p, c, k in zip(payloads, b.complete, b.record_type, strict=True)]
            out["page_id"] = b.page_id.astype("Int64")
            yield out[[x.split()[0] for x in schema.split(", ")]]

    return reassemble(read_records(spark, path)).mapInPandas(decode, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    found = staged(
        read_archive(spark, path).select(
            "record_id", "record_type", "page_id", "payload_digest", "refers_to_id", F.octet_length("payload").cast("long").alias("payload_bytes")
        ),
        "records",
    )
    responses = found.where("record_type = 'response'")
    origin = responses.select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size")
    )
    again = found.where("record_type = 'revisit'").join(origin, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        responses.withColumn("refers_to", F.lit(None).cast("long"))
        .select(columns)
        .unionByName(again.withColumn("payload_bytes", F.col("size")).select(columns))
    )
