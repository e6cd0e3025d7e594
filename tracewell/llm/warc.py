"""WARC archives: written by Spark, normalised to one gzip member per record, and read back by offset.

1. ``write``: every page becomes a WARC record; Spark's text writer lays records out with the record separator as line
   separator and gzips each file as one stream. Its commit protocol makes the files safe against lost tasks.
2. ``normalise``: each such file is inflated once, as a stream, and every record is written again as a gzip member of
   its own, with a sidecar that lists offset, length, record id and type. A task names its files after its attempt and
   returns the names; only names that Spark accepted are used later, so a task that is run again does no harm.
3. ``read``: records are found by the sidecar's offsets, inflated one by one, and their payloads digested.

Steps 2 and 3 hold one record and one buffer at a time. Files are reached through pyarrow's filesystems.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, fresh_folder, removed

SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one archive at most, and bytes read at a time.
ARCHIVE_RECORDS, BUFFER = 20_000, 1 << 20
#: A payload shared by more than this part of all records is looked up in a broadcast table (at most its inverse in rows).
HOT_SHARE = 1 / 1000
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's UTF-8 bytes in bare upper-case base 32: 40 bits at a time from the hexadecimal digest."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexa = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexa, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), digits, letters)


def with_roles(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is null for responses.

    Of records with equal payloads of at least ``min_payload`` bytes the one with the least page_id is the response
    and the others refer to it. Rows that repeat that page_id are responses too; a row without page_id
    refers to the least one there is, or is a response if there is none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    slim = rows.where(F.octet_length("payload") >= min_payload)
    groups = cut(slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("records")).where("records > 1"))
    hot_from = max(1, int(pages.count() * HOT_SHARE))
    hot = groups.where(F.col("records") > hot_from).select(F.col("payload_digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    cool = groups.where(F.col("records") <= hot_from).select(F.col("payload_digest").alias("at"), "first")
    # Rows found in the broadcast table get a key of their own for the second join: they match nothing there and spread out.
    seen = rows.join(F.broadcast(hot), F.col("payload_digest") == F.col("hot_digest"), "left")
    at = F.when(F.col("hot_digest").isNotNull(), F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("payload_digest"))
    found = seen.withColumn("at", at).join(cool, "at", "left").withColumn("first", F.coalesce("hot_first", "first"))
    return found.select("page_id", "url", "payload", "payload_digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """The record's text without the separator after it. A revisit has no block of its own, only its payload's length."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    revisit, size = refers_to.isNotNull(), F.octet_length(payload).cast("string")
    uri = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", uri(page_id)), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(url, r"[\x00-\x20\x7F]+", "%20")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("Payload-Length", size), F.coalesce(F.concat(line("WARC-Refers-To", uri(refers_to)), line("WARC-Profile", F.lit(PROFILE))), F.lit("")),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(revisit, "0").otherwise(size)), F.lit(SEPARATOR), F.when(revisit, "").otherwise(payload))


def write(pages: DataFrame, folder: str, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of all pages under ``folder``, each one gzip stream of at most ``ARCHIVE_RECORDS`` records."""
    text = record(*(F.col(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), date)
    with_roles(pages, min_payload).select(text.alias("value")).write.option("compression", "gzip").option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def inflated(stream):
    """Pieces of a gzip stream's content, of one member or several; none is longer than ``BUFFER``, however well it was compressed."""
    d = zlib.decompressobj(31)
    while data := stream.read(BUFFER):
        while data:
            yield d.decompress(data, BUFFER)
            data = d.unconsumed_tail or d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)
    while rest := d.decompress(d.unconsumed_tail, BUFFER):  # what a full piece left in the decompressor
        yield rest


def records(pieces):
    """(fields, header bytes, block bytes) of each record in an inflated stream."""
    held, stop = bytearray(), SEPARATOR.encode()
    at, end, need = 0, -1, 0
    for piece in pieces:
        if at:  # once a piece, not once a record
            del held[:at]
            end, need, at = end - at if end >= 0 else end, need - at, 0
        held += piece
        while len(held) >= need:
            if end < 0:
                end = held.find(stop, at)
                if end < 0:
                    break
                need = end + 4 + int(re.search(rb"(?im)^Content-Length:\s*(\d+)", held[at:end])[1]) + 4
                continue
            head, block = bytes(held[at:end]), bytes(held[end + 4 : need - 4])
            at, end = need, -1
            yield dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), head, block
    if held[at:].strip():
        raise ValueError("an archive ends within a record")


def normalise(spark, folder: str, out: str, level: int = 6) -> DataFrame:
    """(archive, sidecar, records) of the rewritten archives. The work is done when this returns."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = opened(path)
                to, base = opened(out)
                to.create_dir(base, recursive=True)
                archive = f"{out}/{name.rsplit('/', 1)[1].split('.')[0]}-{TaskContext.get().taskAttemptId()}.warc.gz"
                offset, index = 0, []
                with store.open_input_stream(name, compression=None) as source, to.open_output_stream(opened(archive)[1], compression=None) as sink:
                    for fields, head, block in records(inflated(source)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = b"".join((z.compress(head + SEPARATOR.encode() + block + SEPARATOR.encode()), z.flush()))
                        sink.write(member)
                        index.append(json.dumps({"offset": offset, "length": len(member), "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"]}))
                        offset += len(member)
                with to.open_output_stream(opened(archive)[1] + ".idx", compression=None) as sink:
                    sink.write("\n".join(index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [archive], "sidecar": [archive + ".idx"], "records": [len(index)]})

    files = paths.count()
    return cut(paths.repartition(max(1, files)).mapInArrow(run, "archive string, sidecar string, records long"))


def read(archives: DataFrame) -> DataFrame:
    """``ROW`` of every record of normalised archives, each reached by its offset. Payloads of responses are digested anew."""

    def number(uri: str | None):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(found[1]) if found else None

    def run(batches):
        for b in batches:
            for archive, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = opened(archive)
                with store.open_input_stream(opened(sidecar)[1], compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = []
                with store.open_input_file(name) as f:
                    for x in index:
                        f.seek(x["offset"])
                        fields, _, block = next(records([zlib.decompress(f.read(x["length"]), 31)]))
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                        rows.append((number(fields["WARC-Record-ID"]), int(fields["Payload-Length"]) if revisit else len(block), digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

    files = archives.count()
    return archives.select("archive", "sidecar").repartition(max(1, files)).mapInArrow(run, ROW)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All pages through archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to. The archives are deleted once read."""
    folder = fresh_folder(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/streams")
    archives = normalise(spark, f"{folder}/streams", f"{folder}/members")
    removed(spark, f"{folder}/streams")
    rows = cut(read(archives))
    removed(spark, folder)
    return rows


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p
), b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (1 + 10 * (k // 8))::BIGINT, 10))::BIGINT) >> (35 - 5 * (k % 8))) & 31) + 1, 1)), '') AS payload_digest FROM d
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
