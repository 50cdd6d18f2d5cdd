"""Zstandard WARC archives: one frame per record, the dictionary in the leading skippable frame.

Archives are written and read through Spark, so any file system that Spark knows will do. A partition becomes a file whose rows
are frames; the separator that the text writer puts between rows is an empty skippable frame, which every decoder passes over.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import SENT_ROWS, query, saved, shared_folder, small_batches, table

#: Fixed values of the formats: magic numbers of a frame, of the dictionary's skippable frame, and an empty skippable frame.
FRAME, DICTIONARY, EMPTY = 0xFD2FB528, 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in one archive, and what a dictionary is made from: the archive's first records.
ARCHIVE_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 8_000_000, 200, 1_000_000, 32_768
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, problem string"


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the response's headers only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, by its header and block sizes."""
    descriptor = data[at + 4]
    single, checksum, dictionary = descriptor >> 5 & 1, descriptor >> 2 & 1, (0, 1, 2, 4)[descriptor & 3]
    content = (single, 2, 4, 8)[descriptor >> 6]
    at += 5 + (1 - single) + dictionary + content
    while True:
        head = int.from_bytes(data[at: at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("the archive ends inside a frame")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * checksum


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one per frame."""
    view, at, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at + 8 <= len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic == DICTIONARY and at == 0:
            kept = bytes(view[8: 8 + size])
            if kept[:4] == FRAME.to_bytes(4, "little"):
                kept = zstandard.ZstdDecompressor().decompress(kept)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(kept))
            at += 8 + size
        elif magic >> 4 == 0x184D2A5:
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(view, at)
            yield decoder.decompressobj().decompress(view[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")
    if at != len(view):
        raise ValueError("the archive ends inside a frame")


def parsed(raw: bytes) -> tuple:
    """The fields of `RECORD` from a decoded record; `problem` says what is wrong with it."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    ident = lambda v: int(v[10:-1]) if v and v.startswith("<urn:page:") and v[10:-1].lstrip("-").isdigit() else None
    size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else -1
    block, kind = rest[: max(size, 0)], fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next((int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), -1)
    problem = None
    if not mark or not lines[0].startswith("WARC/1."):
        problem = "no WARC header"
    elif size < 0 or rest[size:] != b"\r\n\r\n":
        problem = "content length"
    elif kind not in ("response", "revisit"):
        problem = "record type"
    elif kind == "response" and (said != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        problem = "payload"
    elif kind == "revisit" and (payload or ident(fields.get("warc-refers-to")) is None):
        problem = "revisit"
    return (ident(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, ident(fields.get("warc-refers-to")) if kind == "revisit" else None,
            digest, said, payload if kind == "response" else None, problem)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every page as a record into archives under `folder`.

    Of records with equal payloads of at least `least` bytes, that with the greatest id holds the payload; the others, those
    without an id among them, revisit it. If none has an id, all are responses; rows that repeat the greatest id are responses too.
    Null html is an empty payload, a null url is left out, an empty table writes no record; other columns are not read.
    """
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1 and holder is not null").select("digest", "holder"), "holders")
    groups = F.broadcast(groups) if groups.count() <= SENT_ROWS // 4 else groups
    held = rows.join(groups, "digest", "left")
    held = held.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        coder = None

        def start() -> list[bytes]:
            nonlocal coder, waiting
            try:
                made = zstandard.train_dictionary(DICTIONARY_BYTES, waiting, k=256, d=8)
                coder, out = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True), [struct.pack("<II", DICTIONARY, len(made)) + made.as_bytes()]
            except zstandard.ZstdError:  # too little to make one from
                coder, out = zstandard.ZstdCompressor(level=3, write_checksum=True), []
            out += map(coder.compress, waiting)
            waiting = []
            return out

        for batch in batches:
            out: list[bytes] = []
            columns = [batch.column(k).to_pylist() for k in range(4)] + [batch.column(4).cast(pa.binary()).to_pylist()]
            for page_id, url, digest, refers_to, html in zip(*columns, strict=True):
                raw = record(page_id, url, html, digest, refers_to, date)
                if coder:
                    out.append(coder.compress(raw))
                else:
                    waiting.append(raw)
                    if len(waiting) >= SAMPLE_RECORDS or sum(map(len, waiting)) >= SAMPLE_BYTES:
                        out += start()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(start(), pa.binary())], ["frame"])

    archives = max(1, -(-total // ARCHIVE_BYTES))
    dealt = held.repartition(archives, F.xxhash64("page_id", "digest", "url"))
    made = dealt.select("page_id", "url", "digest", "refers_to", "html").mapInArrow(write, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY).text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records under `folder`, with `RECORD`'s columns; `problem` is null for a sound record. `payloads`: return them as well."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                try:
                    for raw in frames(content.as_py()):
                        row = parsed(raw)
                        rows.append(row if payloads else (*row[:6], None, row[7]))
                except (ValueError, zstandard.ZstdError) as error:
                    rows.append((None, None, None, None, None, None, None, f"archive: {error}"))
                for at in range(0, len(rows), 2000):
                    part = rows[at: at + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(read, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload size and digest that a revisit's response really has; a revisit without its response is a problem."""
    slim = records.drop("payload")
    holders = slim.where("record_type = 'response'").select(F.col("page_id").alias("h_id"), F.col("payload_digest").alias("h_digest"),
                                                            F.col("payload_bytes").alias("h_bytes")).dropDuplicates(["h_id", "h_digest"])
    joined = slim.join(holders, (F.col("refers_to") == F.col("h_id")) & (F.col("payload_digest") == F.col("h_digest")), "left")
    lost = F.col("refers_to").isNotNull() & F.col("h_id").isNull()
    return joined.withColumn("problem", F.when(lost, "revisit without response").otherwise(F.col("problem"))).withColumn(
        "payload_bytes", F.coalesce("h_bytes", "payload_bytes")).drop("h_id", "h_digest", "h_bytes")


@query("op5_warc_zstd")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    records = saved(read_archives(spark, folder, payloads=False), "records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
