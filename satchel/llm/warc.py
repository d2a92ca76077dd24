"""WARC archives whose records are compressed one by one with a dictionary that the archive carries itself.

An archive is a skippable Zstandard frame that holds the dictionary, then one Zstandard frame for each WARC/1.1 record.
The dictionary is trained on a bounded sample over all of the archive's own records, or is such a sample itself, so any archive can be read alone and any
record of it without its neighbours. Archives lie as binary values in a Parquet table, which any store that Spark
writes can hold; export_archives puts them into a folder as plain files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, bound_batches, fresh_name, fresh_path, join_dealt

#: Fixed values of the format: the magic number of the dictionary's frame and the ends of lines.
DICT_MAGIC = 0x184D2A5D
CRLF = b"\r\n"
ID_PREFIX = "urn:page:"
#: Raw bytes of an archive, bytes of records that the dictionary is trained on, and the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 24 << 20, 1 << 20, 32 << 10
MIN_REVISIT = 1000


class ArchiveError(ValueError):
    """An archive is damaged, or a payload differs from its digest."""


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record. A revisit keeps the response's HTTP header, which tells the payload's length, and drops the payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    safe = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {safe}"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + CRLF + CRLF


def train(records: list[bytes]) -> bytes:
    """A dictionary from a bounded sample of records, drawn evenly over all; without records an empty one.

    What is too little to train on (COVER cannot, with few or small records) is a dictionary as it is: raw content.
    """
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    most = max(1, SAMPLE_BYTES // max(1, len(records[::step])))
    sample = [x[: max(most, 4096)] for x in records[::step]]
    size = sum(map(len, sample))
    if len(sample) >= 16 and size >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, size // 8), sample, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # too alike to train on
    return b"".join(x[: max(64, DICT_BYTES // len(sample))] for x in sample)[-DICT_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data, zstandard.DICT_TYPE_AUTO) if len(data) >= 8 else None


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    dictionary = train(records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(dictionary)), dictionary, *map(packer.compress, records)])


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive as dicts of their header fields, with `http` and `payload` besides."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_MAGIC:
        raise ArchiveError("no leading dictionary frame")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    dictionary = data[8:at]
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    while at < len(data):
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ArchiveError("a cut record")
            piece = data[at : at + 16384]
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as e:
                raise ArchiveError(str(e)) from e
            at += len(piece) - len(one.unused_data)
        yield _parse(b"".join(parts))


def _fields(head: bytes) -> dict[str, str]:
    return {k.decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in head.split(CRLF)[1:]) if k}


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(CRLF + CRLF)
    found: dict = _fields(head)
    block = rest[: int(found["Content-Length"])]
    if rest[len(block) :] != CRLF + CRLF:
        raise ArchiveError("a record's length differs from its header")
    http, _, payload = block.partition(CRLF + CRLF)
    return found | {"http": _fields(http), "payload": payload}


def mark_revisits(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Add payload_digest, payload_bytes and refers_to (the response's id, null for responses) to df, whose other columns stay.

    Of rows with equal payloads of at least min_bytes, those with the largest id are the response. Rows without an id
    are responses only where no row of their payload has one. A null payload counts as empty. Columns of df with one of
    the three names are replaced. Copies of one payload are dealt to several tasks; an empty table gives an empty table.
    """
    first, n = fresh_name(df, "first"), fresh_name(df, "n")
    rows = df.drop("payload_digest", "payload_bytes", "refers_to").withColumn(payload_col, F.coalesce(F.col(payload_col).cast("string"), F.lit("")))
    rows = rows.withColumns({"payload_digest": F.sha1(F.encode(payload_col, "UTF-8")), "payload_bytes": F.octet_length(payload_col).cast("long")})
    total = df.count()
    copies = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(id_col).alias(first), F.count("*").alias(n))
    copies = copies.filter(F.col(n) > 1).drop(n)
    joined = join_dealt(rows, copies, ["payload_digest", "payload_bytes"], F.monotonically_increasing_id(), total, "left")
    out = joined.withColumn("refers_to", F.when(~F.col(first).eqNullSafe(F.col(id_col)), F.col(first))).drop(first)
    return out.select(*[c for c in df.columns if c in out.columns], *[c for c in ("payload_digest", "payload_bytes", "refers_to") if c not in df.columns])


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row into archives under path: (archive, n_records, data)."""
    spark = df.sparkSession
    bound_batches(spark)
    picked = df.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.col(payload_col).cast("string").alias("html"))
    names, types = ["archive", "n_records", "data"], [pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = write_archive(held)
            return batch_of(names, [[f"{hashlib.sha1(data).hexdigest()}.warc.zst"], [len(held)], [data]], types)

        for batch in batches:
            for row in batch.to_pylist():
                one = record(row["page_id"], row["url"], row["html"].encode(), row["payload_digest"], row["refers_to"], row["refers_to"] is not None)
                held.append(one)
                size += len(one)
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    mark_revisits(picked).mapInArrow(run, "archive string, n_records long, data binary").write.parquet(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives under path, from the stored bytes; digests of responses are tested."""
    bound_batches(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * with_payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def page(uri: str) -> int | None:
        text = uri.strip("<>").removeprefix(ID_PREFIX)
        return int(text) if text else None

    def row(x: dict) -> tuple:
        digest = base64.b32decode(x["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        length, refers = int(x["http"]["Content-Length"]), x.get("WARC-Refers-To")
        if x["WARC-Type"] == "response" and (len(x["payload"]) != length or hashlib.sha1(x["payload"]).hexdigest() != digest):
            raise ArchiveError(f"payload of {x['WARC-Record-ID']} differs from its digest")
        return (page(x["WARC-Record-ID"]), length, digest, x["WARC-Type"], page(refers) if refers else None, x["WARC-Target-URI"]) + ((x["payload"] if not refers else None,) if with_payload else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [row(x) for x in read_archive(data.as_py())]
                for k in range(0, len(rows), 2000):
                    yield batch_of(names, list(map(list, zip(*rows[k : k + 2000], strict=True))), types)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return spark.read.parquet(path).select("data").mapInArrow(run, schema)


def export_archives(spark: SparkSession, path: str, folder: str) -> None:
    """Write the archives under path as plain .warc.zst files into a folder of any store that Spark's driver can reach.

    The driver copies one archive after the other, so no task needs the folder on its own disk; a file appears whole.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(root)
    for x in spark.read.parquet(path).select("archive", "data").toLocalIterator():
        part = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(x["data"]))
        out.close()
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder}/{x['archive']}"))


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """Write pages into archives in the shared folder (or path) and return what reading them back gives.

    Null payloads are empty, null urls are empty; an empty table gives empty archives and no rows. Rows that repeat an
    id and payload are all written; of the largest id's, all are responses. Other columns are not read.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(df, path, id_col, url_col, payload_col)
    return read_archives(spark, path)
