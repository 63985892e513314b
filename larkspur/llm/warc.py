"""Content-addressed web archive.

Records are kept apart from what they carry: a payload is stored once under its
SHA-256, and every record keeps its exact WARC and HTTP header bytes with the
digest as reference. Joining both gives the original records back byte for byte.

Of records with equal payloads the one with the largest page_id is the response;
the others are revisit records that name it. Payloads below `least_bytes` are
responses always. Equality is by SHA-256, checked against length and SHA-1 when
the archive is written, and again against the bytes when it is read.

A record's id names its page and the row it came in, so that repeated rows have
records of their own; a revisit refers to its response by that id. White space
in an address is written as %XX in the header, the address itself stays beside it.

Nulls: a null html is an empty payload, a null url an empty target. A null
page_id is never named by a revisit, unless all of its copies are null, which
makes all of them responses. Repeated rows are kept: rows that share the largest
page_id of a payload are responses each. Very long payloads are one record each.
Empty tables give empty archives. Columns other than page_id, url and html are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_to, new_path, saved, small_batches

HASHED = "page_id long, url string, sha256 string, payload_digest string, payload_bytes long, pressed binary"
RECORDS = "page_id long, row long, url string, sha256 string, copies long, payload_digest string, record_type string, refers_to long, header binary, http binary"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
SHARE = 10_000  # records that one copy of a payload serves in a join


def _hashed(pages: DataFrame) -> DataFrame:
    """Digests of each payload, and the payload compressed, so that every later shuffle moves fewer bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                bodies = [(x or "").encode() for x in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": some.column("page_id"),
                        "url": some.column("url"),
                        "sha256": [hashlib.sha256(x).hexdigest() for x in bodies],
                        "payload_digest": [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in bodies],
                        "payload_bytes": pa.array([len(x) for x in bodies], pa.int64()),
                        "pressed": pa.array([press.compress(x) for x in bodies], pa.binary()),
                    }
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, HASHED)


def _named(page: str, row: str) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))


def _headers(records: DataFrame) -> DataFrame:
    """The exact header bytes of each record."""
    target = F.coalesce("url", F.lit(""))
    for blank in " \t\r\n":
        target = F.replace(target, F.lit(blank), F.lit(f"%{ord(blank):02X}"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), _named("page_id", "row")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _named("refers_to", "kept_row"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length("http") + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)).cast("string")),
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    return records.withColumn("http", F.encode(http, "UTF-8")).withColumn("header", F.encode(F.concat(head, F.lit("\r\n\r\n")), "UTF-8"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes path/payloads (each payload once) and path/records (headers and references)."""
    spark = pages.sparkSession
    small_batches(spark)
    hashed = f"{path}/hashed"
    _hashed(pages).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "none").parquet(hashed)
    rows = spark.read.schema(HASHED + ", row long").parquet(hashed)
    narrow = rows.drop("pressed")
    # counted before the shuffle, so that a payload of very many pages is a few rows there
    alike = narrow.groupBy("sha256").agg(
        F.max(F.struct("page_id", "row")).alias("kept"), F.count("*").alias("copies"), F.min("payload_bytes").alias("least"), F.max("payload_bytes").alias("most"), F.min("payload_digest").alias("first_sha1"), F.max("payload_digest").alias("last_sha1")
    )
    sound = F.when((F.col("least") != F.col("most")) | (F.col("first_sha1") != F.col("last_sha1")), F.raise_error(F.lit("payloads of equal SHA-256 differ"))).otherwise(F.lit(True))
    alike = saved(alike.where(sound).select("sha256", "copies", F.col("kept.page_id").alias("kept_id"), F.col("kept.row").alias("kept_row")), "digests")
    records = joined_to(narrow, alike, ["sha256"], "copies", max(1, rows.count()))
    records = records.withColumn("refers_to", F.when((F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("kept_id")), F.col("kept_id")))
    records = records.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    _headers(records).select(*[x.split(" ")[0] for x in RECORDS.split(", ")]).write.parquet(f"{path}/records")
    # any row of a payload will do as the stored one: each task offers one of its own
    one = rows.groupBy("sha256").agg(F.first("pressed").alias("pressed"), F.first("payload_bytes").alias("payload_bytes"), F.count("*").alias("copies"))
    one.write.option("compression", "none").parquet(f"{path}/payloads")
    folder = spark._jvm.org.apache.hadoop.fs.Path(hashed)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _with_payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Records with the compressed payload that each refers to. A payload comes once for every SHARE of its records, so that none meets all of them in one task."""
    stored = spark.read.schema("sha256 string, pressed binary, payload_bytes long, copies long").parquet(f"{path}/payloads")
    shares = F.ceil(F.col("copies") / SHARE).cast("long")
    dealt = stored.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).select("sha256", "share", "pressed")
    return records.withColumn("share", F.pmod(F.xxhash64("row"), shares)).join(dealt, ["sha256", "share"], "left")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records with their payloads: page_id, url, record_type, refers_to, payload_bytes, payload_digest, header,
    http and payload. Lengths and digests are those of the stored bytes, checked against the address.
    """
    joined = _with_payloads(spark, path, spark.read.schema(RECORDS).parquet(f"{path}/records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                bodies = [unpress.decompress(x) for x in some.column("pressed").to_pylist()]
                if [hashlib.sha256(x).hexdigest() for x in bodies] != some.column("sha256").to_pylist():
                    raise ValueError("a stored payload doesn't match its address")
                digests = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in bodies]
                if digests != some.column("payload_digest").to_pylist():
                    raise ValueError("a record's digest doesn't match its payload")
                kept = {n: some.column(n) for n in ("page_id", "url", "record_type", "refers_to", "header", "http")}
                yield pa.RecordBatch.from_pydict(kept | {"payload_bytes": pa.array([len(x) for x in bodies], pa.int64()), "payload_digest": digests, "payload": pa.array(bodies, pa.binary())})

    return joined.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, header binary, http binary, payload_bytes long, payload_digest string, payload binary")


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the whole original record, byte for byte. Only responses carry a payload, which is checked against its address."""
    records = spark.read.schema(RECORDS).parquet(f"{path}/records")
    revisits = records.where("record_type = 'revisit'").withColumn("pressed", F.lit(None).cast("binary"))
    responses = _with_payloads(spark, path, records.where("record_type = 'response'")).drop("share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out = []
                for kind, sha, pressed, header, http in zip(*(some.column(c).to_pylist() for c in ("record_type", "sha256", "pressed", "header", "http")), strict=True):
                    body = unpress.decompress(pressed) if kind == "response" else b""
                    if kind == "response" and hashlib.sha256(body).hexdigest() != sha:
                        raise ValueError("a stored payload doesn't match its address")
                    out.append(header + http + body + b"\r\n\r\n")
                yield pa.RecordBatch.from_pydict({"page_id": some.column("page_id"), "record": pa.array(out, pa.binary())})

    columns = ("page_id", "sha256", "record_type", "header", "http", "pressed")
    return responses.select(*columns).unionByName(revisits.select(*columns)).mapInArrow(run, "page_id long, record binary")


def _page_of(name: str) -> int | None:
    page = name.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


def parsed_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, as a record's own bytes say; those of a response are counted and hashed anew."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = block[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    said = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response":
        if (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()) != (said, digest):
            raise ValueError("a record's payload isn't what its headers say")
        return _page_of(fields["WARC-Record-ID"]), len(body), digest, kind, None
    return _page_of(fields["WARC-Record-ID"]), said, digest, kind, _page_of(fields["WARC-Refers-To"])


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes an archive of the pages in the shared folder, rebuilds every record and reads from the records' bytes READ's columns."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [parsed_record(r) for r in batch.column("record").to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in read], t) for k, t in enumerate(kinds)], [x.split(" ")[0] for x in READ.split(", ")])

    return original_records(pages.sparkSession, path).mapInArrow(run, READ)
