"""Content-addressed WARC archive.

Two parts lie in one folder, and from them every record is made again:

* ``payloads/``: every distinct payload once, as a WARC/1.1 ``resource`` record whose target is
  ``urn:sha256:<digest>``; the digest is its address. Each record is a gzip member of its own, as is usual
  for WARC, and files are closed beyond ``FILE_BYTES`` (one larger record may exceed that).
* ``headers/``: Parquet, one row per record: the exact WARC header and HTTP header texts and the address of
  the payload that they speak of.

``reconstruct`` joins headers to payloads and gives back the bytes of every record, ``parse`` reads those
bytes as any WARC reader would and holds lengths and digests against them, and ``export`` writes them as
ordinary archives.

Reading verifies each payload against its address (and its length and SHA-1), so two payloads with one
address would be noticed and never silently merged. Payloads are hashed where they are read; owners are
chosen on addresses and ids alone, and payload bytes are shuffled once, to their owner's row. Addresses
with more than ``HOT`` records have their payload spread over ``SALT`` join keys when records are rebuilt.

Of records with equal payloads of at least ``min_revisit`` bytes, the one of the smallest page_id is
the ``response`` and the others ``revisit`` it; smaller ones are all responses.

Defined results: null html is an empty payload; null url is ``about:blank``, and control characters
or blanks in a url are percent-encoded; repeated page_ids are records of their own (equal page_ids
with equal payload: the first by url is the response); a null page_id is not an owner unless no row of its
payload has an id; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm.common import discard, fresh_path, slices, stash, table

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
#: Records of an address that has more than ``HOT`` of them are spread over so many join keys.
SALT, HOT = 16, 1024
#: A file of payloads is closed beyond ``CHUNKS`` blobs of about ``BLOB_BYTES`` each, before compression.
BLOB_BYTES, CHUNKS = 8 << 20, 12
FILE_BYTES = BLOB_BYTES * CHUNKS
NO_ID = (1 << 63) - 1
_NOTHING = gzip.compress(b"", mtime=0)
_UNSAFE = re.compile("[\x00-\x20\x7f]")


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, uri, n_bytes, address (SHA-256), sha1 (bare base32) of each payload; payloads stay behind."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            raw = [p or b"" for p in batch.column("payload").to_pylist()]
            uri = [_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(uri, pa.string()), pa.array([len(p) for p in raw], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in raw], pa.string()), pa.array([base32_sha1(p) for p in raw], pa.string())],
                names=["page_id", "url", "uri", "n_bytes", "address", "sha1"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("about:blank")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    return rows.mapInArrow(hashed, "page_id long, url string, uri string, n_bytes long, address string, sha1 string")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: F.Column, url: F.Column, twin: F.Column) -> F.Column:
    h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), url, twin.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def classify(hashed: DataFrame, min_revisit: int = 0) -> DataFrame:
    """record_type and refers_to of each row, and the join key (``slice``) that its payload is found by.

    Owners are found by pre-aggregation; the rows of an address are spread over salted keys.
    """
    id_ = F.coalesce(F.col("page_id"), F.lit(NO_ID))
    owners = owners_of(hashed).where(F.col("copies") > 1).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "twin"), F.lit(SALT)).cast("int"))
    j = rows.join(owners, ["address", "salt"], "left")
    own = F.col("o").isNull() | (F.col("n_bytes") < min_revisit) | ((id_ == F.col("o.page_id")) & (F.col("url") == F.col("o.url")) & (F.col("twin") == F.col("o.twin")))
    named = F.when(~own, F.nullif(F.col("o.page_id"), F.lit(NO_ID)))
    return j.withColumns({"slice": F.when(F.col("copies") > HOT, F.col("salt")).otherwise(0), "record_type": F.when(own, "response").otherwise("revisit"), "refers_to": named, "refers_id": F.when(~own, record_id(F.col("o.page_id"), F.col("o.url"), F.col("o.twin")))}).drop("salt", "o", "copies")


def owners_of(hashed: DataFrame) -> DataFrame:
    """(address, o, copies): the first record of each payload, and how many there are."""
    first = F.min(F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), F.col("url"), F.col("twin")))
    return hashed.groupBy("address").agg(first.alias("o"), F.count("*").alias("copies"))


def headers(rows: DataFrame, date: str = DATE) -> DataFrame:
    """The exact header texts of each record."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.length(http) + F.when(F.col("record_type") == "response", F.col("n_bytes")).otherwise(0)
    known = record_id(F.coalesce(F.col("page_id"), F.lit(NO_ID)), F.col("url"), F.col("twin"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), known), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), "uri"),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: "), "refers_id"), F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string")),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return rows.select("page_id", F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)).alias("warc_header"), http.alias("http_header"), "address", "slice")


def write_archive(pages: DataFrame, path: str, min_revisit: int = 0, date: str = DATE) -> None:
    """Hash, choose owners, write the headers, then each distinct payload once."""
    spark = pages.sparkSession
    used = []
    hashed, at = stash(digests(pages).withColumn("twin", F.lit(0)), "warc-digests")
    used.append(at)
    doubled = hashed.groupBy("page_id").count().where("count > 1").limit(1).count()
    if doubled:  # repeated page_ids: number the rows that cannot be told apart otherwise
        hashed, at = stash(hashed.withColumn("twin", F.row_number().over(Window.partitionBy("page_id", "url", "address").orderBy("n_bytes")) - 1), "warc-digests")
        used.append(at)
    headers(classify(hashed, min_revisit), date).write.parquet(f"{path}/headers")
    body = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("owner"), F.coalesce(F.col("url"), F.lit("about:blank")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("address", F.sha2("payload", 256))
    owners = owners_of(hashed).select("address", F.col("o.url").alias("url"), F.col("o.page_id").alias("owner"), F.when(F.col("copies") > HOT, SALT).otherwise(1).alias("fan"))
    first = body.join(owners, ["address", "url", "owner"])
    if doubled:
        first = first.dropDuplicates(["address"])
    blobs = first.select("address", "fan", "payload").mapInArrow(lambda batches: packed(batches, date), "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", CHUNKS).text(f"{path}/payloads")
    discard(spark, *used)


def packed(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """Blobs of gzip members, a resource record each. A blob lacks the last byte of an empty member, a zero, which the writer's line separator adds."""
    held: list[bytes] = []
    size = 0

    def blob() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held) + _NOTHING[:-1]], pa.binary())], names=["blob"])

    for batch in slices(batches, "payload"):
        for address, fan, payload in zip(*(batch.column(c).to_pylist() for c in ("address", "fan", "payload")), strict=True):
            head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:sha256:{address}>", f"WARC-Date: {date}", f"WARC-Target-URI: urn:sha256:{address}", f"X-Join-Keys: {fan}", "Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
            held.append(gzip.compress(CRLF.join(head).encode() + payload + b"\r\n\r\n", 6, mtime=0))
            size += len(payload) + 300
            if size >= BLOB_BYTES:
                yield blob()
                held, size = [], 0
    if held:
        yield blob()


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, by its lengths alone."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split(CRLF)
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        yield fields, raw[end + 4 : end + 4 + n]
        if raw[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        at = end + 8 + n


def members(raw: bytes) -> Iterator[bytes]:
    """The inflated gzip members of a file, one at a time."""
    at = 0
    while at < len(raw):
        d, out = zlib.decompressobj(31), []
        while not d.eof:  # a piece at a time, so that what follows the member is not copied with it
            out.append(d.decompress(raw[at : at + (1 << 16)]))
            at += 1 << 16
        at = min(at, len(raw)) - len(d.unused_data)
        yield b"".join(out)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """address, sha1, n_bytes, join keys and payload of the store, each verified against its address."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                out: list[tuple] = []
                size = 0
                for member in members(raw):
                    for fields, block in parse_records(member):
                        address = fields["WARC-Target-URI"].removeprefix("urn:sha256:")
                        if hashlib.sha256(block).hexdigest() != address:
                            raise ValueError(f"payload {address} does not match its address")
                        out.append((address, int(fields["X-Join-Keys"]), base32_sha1(block), len(block), block))
                        size += len(block)
                    if size > 4 << 20:
                        yield made(out)
                        out, size = [], 0
                if out:
                    yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["address", "fan", "stored_sha1", "stored_bytes", "payload"])

    files = spark.read.format("binaryFile").load(f"{path}/payloads").select("content")
    return files.mapInArrow(parsed, "address string, fan int, stored_sha1 string, stored_bytes long, payload binary")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Every record again, byte for byte: headers joined to the payload of their address; a revisit's block is its HTTP header only."""
    store = read_payloads(spark, path).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    j = spark.read.parquet(f"{path}/headers").join(store, ["address", "slice"])
    body = F.when(F.contains("warc_header", F.lit("\r\nWARC-Type: response\r\n")), F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"), body, F.lit(b"\r\n\r\n"))
    return j.select("page_id", "address", "stored_sha1", "stored_bytes", record.alias("record"))


def parse(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, all read from the records' own bytes.

    A response's payload is measured and hashed; what its header says of it must be true. A revisit has no
    payload: what it says must be true of the payload that its address leads to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "record"):
            out = []
            for raw, stored_sha1, stored_bytes in zip(*(batch.column(c).to_pylist() for c in ("record", "stored_sha1", "stored_bytes")), strict=True):
                ((fields, block),) = parse_records(raw)
                end = block.index(b"\r\n\r\n") + 4
                http = dict(line.split(": ", 1) for line in block[:end].decode().split(CRLF)[1:-2])
                said = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                found = (len(block) - end, base32_sha1(block[end:])) if kind == "response" else (stored_bytes, stored_sha1)
                if said != found:
                    raise ValueError(f"record {fields['WARC-Record-ID']} speaks of another payload than {found}")
                page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                out.append((None if page is None else int(page), *found, kind, None if refers is None else int(refers)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records.select("record", "stored_sha1", "stored_bytes").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(records: DataFrame, path: str) -> None:
    """Ordinary WARC files of the reconstructed records."""
    records.select(F.expr("cast(substring(record, 1, length(record) - 4) as string)").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return parse(reconstruct(spark, path))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM d
"""
