"""WARC revisit resolution.

Headers alone are shuffled by payload digest; each digest elects one original
response, the others become revisit records that refer to it, and the archives
are written anew with fresh headers. Payloads move once, to the archive that
holds them.

Defined results: a null payload counts as empty; a null page id never becomes
the original of a group that has another id; rows that repeat the original's
page id are responses too; payloads shorter than ``min_bytes`` are never
deduplicated; an empty input gives an empty folder of archives.
"""

from __future__ import annotations

import io
import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, new_path

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
RECORD_SCHEMA = (
    "record_id long, target_uri string, record_type string, refers_to long, refers_to_uri string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def payload_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(record_id, target_uri, payload_digest, payload_bytes) of each page; payloads stay behind."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.regexp_replace(F.col(url_col), r"[\r\n]+", "%0A").alias("target_uri"),
        F.sha2(body, 256).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Add ``record_type``, ``refers_to`` and ``refers_to_uri`` to headers.

    The smallest id of each digest is the response. Only digests that occur
    more than once reach the join; its key is renamed by an expression so that
    both sides are dealt anew and adaptive execution can split a hot digest.
    """
    originals = (
        headers.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("record_id").alias("original"), F.min_by("target_uri", "record_id").alias("original_uri"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select(F.unhex("payload_digest").alias("digest_key"), "original", "original_uri")
    )
    joined = headers.join(originals, (F.unhex(headers["payload_digest"]) == originals["digest_key"]) & (headers["payload_bytes"] >= min_bytes), "left")
    again = F.col("original").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("original"))
    return joined.select(
        *headers.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("original")).alias("refers_to"),
        F.when(again, F.col("original_uri")).alias("refers_to_uri"),
    )


def _record(body, date: str):
    """The WARC record as one string column, without its closing blank lines."""
    urn = lambda c: F.concat(F.lit("<urn:millrace:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    length = F.when(revisit, F.lit(len(HTTP_HEAD))).otherwise(F.col("payload_bytes") + len(HTTP_HEAD))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("record_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", urn(F.col("refers_to"))),
                F.coalesce(line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), F.lit("")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF + HTTP_HEAD),
        F.when(revisit, "").otherwise(body),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 100,
    archive_bytes: int = 32 << 20,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
) -> None:
    """Write gzip archives of about ``archive_bytes`` of payload each to ``path``.

    Spark's committer writes them, so a lost task leaves no half archive. The
    whole file is one gzip member. One page larger than ``archive_bytes`` gets
    an archive of its own size.
    """
    headers = materialize(payload_headers(pages, id_col, url_col, body_col), "warc-headers")
    total = headers.agg(F.sum("payload_bytes")).first()[0] or 0
    archives = max(1, math.ceil(total / archive_bytes))
    resolved = resolve_revisits(headers, min_bytes)
    # Rows that repeat an id share its resolution: what is joined is one row per (id, digest).
    keyed = resolved.dropDuplicates(["record_id", "payload_digest", "target_uri"]).repartition(archives, F.coalesce("record_id", F.lit(-1)))
    body = F.coalesce(F.col(body_col), F.lit(""))
    source = pages.select(
        F.col(id_col).cast("long").alias("id_"), F.regexp_replace(F.col(url_col), r"[\r\n]+", "%0A").alias("url_"), body.alias("body_"), F.sha2(body.cast("binary"), 256).alias("digest_")
    ).repartition(archives, F.coalesce("id_", F.lit(-1)))
    joined = source.join(
        keyed,
        (F.coalesce("id_", F.lit(-1)) == F.coalesce("record_id", F.lit(-1)))
        & F.col("id_").eqNullSafe(F.col("record_id"))
        & (F.col("digest_") == F.col("payload_digest"))
        & F.col("url_").eqNullSafe(F.col("target_uri")),
    )
    joined.select(_record(F.col("body_"), date).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _parse(stream):
    """(fields, payload) of each record of one unpacked archive, by Content-Length alone."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record ends early")
        yield fields, block.partition(b"\r\n\r\n")[2]


class _Gunzip(io.RawIOBase):
    """Unpacks a bytes object piece by piece, so that only packed bytes are held whole."""

    def __init__(self, packed: bytes):
        self.left, self.unpack = memoryview(packed), zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, into):
        out = b""
        while not out:
            data = self.unpack.unconsumed_tail
            if not data:
                if self.unpack.eof:
                    rest = self.unpack.unused_data
                    if not rest and not self.left:
                        return 0
                    self.unpack, data = zlib.decompressobj(31), rest
                if not data:
                    if not self.left:
                        return 0
                    data, self.left = bytes(self.left[: 1 << 18]), self.left[1 << 18 :]
            out = self.unpack.decompress(data, len(into))
        into[: len(out)] = out
        return len(out)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``.

    Each record's digest is recomputed where the payload is present; a mismatch
    raises. ``payload`` is null for revisits, or always without ``with_payload``.
    """

    def parse(batches):
        import hashlib

        urn = lambda v: None if v is None or v == "<urn:millrace:page:null>" else int(v.rpartition(":")[2].rstrip(">"))
        schema = pa.schema(
            [("record_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for packed in batch.column(0):
                rows, held = [], 0
                for f, payload in _parse(io.BufferedReader(_Gunzip(packed.as_py()), 1 << 18)):
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    response = f["warc-type"] == "response"
                    if response and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {f['warc-record-id']} does not fit its payload")
                    keep = payload if response and with_payload else None
                    rows.append((urn(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], urn(f.get("warc-refers-to")), f.get("warc-refers-to-target-uri"), digest, int(f["x-payload-length"]), keep))
                    held += len(keep or b"") + 400
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def deduplicate_archives(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as deduplicated archives and read their records back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **options)
    return read_archives(spark, path, with_payload=False)
