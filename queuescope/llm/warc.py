"""Content-addressed WARC archive: headers as they were written, payload bytes once per strong digest.

A record is header block, empty line, payload. The archive keeps two tables: the exact header bytes of every record with the
SHA-256 of its payload, and every distinct payload once, compressed, under its SHA-256. Records are put together again by a join, and each
payload is hashed anew on the way, so a wrong byte cannot pass.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuescope.session import materialize, work_dir

MIN_REVISIT_BYTES = 0  # equal payloads of at least this many bytes are stored as one response and revisits
DATE = "2024-01-01T00:00:00Z"  # pages carry no time, and the same pages must give the same archive
_NAMESPACE = uuid.UUID(int=0x57415243)
_LINE = "\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


@F.pandas_udf(T.StringType())
def _sha1_base32(payloads: pd.Series) -> pd.Series:
    return pd.Series([base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads], dtype=object)


@F.pandas_udf(T.BinaryType())
def _packed(payloads: pd.Series) -> pd.Series:
    pack = zstd.ZstdCompressor(level=3).compress
    return pd.Series([pack(p) for p in payloads], dtype=object)


@F.pandas_udf(T.StringType())
def _record_id(keys: pd.Series) -> pd.Series:
    return pd.Series([record_id(None if pd.isna(k) else int(k)) for k in keys], dtype=object)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null. Line breaks of a value are percent-coded, as a URI would have them."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(_LINE)), F.lit(""))


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of a WARC record per row: (header, sha256), and (sha256, packed) once per distinct payload.

    Of equal payloads of ``min_bytes`` or more the smallest page_id is the response. The payload is the html in UTF-8; null
    counts as empty. Rows that repeat a page_id are records of their own; the one that is response is chosen by page_id
    and, among equal ones, by a row number, so exactly one record of a payload is a response.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # The slim table gets its row numbers once, by being written; everything after reads the same ones.
    slim = materialize(
        pages.withColumn("_body", body).select(
            "page_id", F.col("url").cast("string").alias("url"),
            F.sha2("_body", 256).alias("sha256"), _sha1_base32("_body").alias("sha1"),
            F.length("_body").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
        )
    )
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    first = slim.groupBy("sha256").agg(F.min(place).alias("first"))
    joined = slim.join(first, "sha256")
    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("row") != F.col("first.row"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    header = F.concat(
        F.lit("WARC/1.1" + _LINE),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id("page_id")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id("first.page_id"))),
        _line("WARC-Profile", F.when(
            revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-ID", F.when(revisit, F.col("first.page_id").cast("string"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.col("n_bytes").cast("string")),
        F.lit(_LINE),
    )
    headers = joined.select(F.encode(header, "UTF-8").alias("header"), "sha256")
    # Equal payloads meet as one row per task, compressed; the bytes of a hot payload never pile up in one place.
    payloads = (
        pages.select(body.alias("_body"))
        .select(F.sha2("_body", 256).alias("sha256"), _packed("_body").alias("packed"))
        .dropDuplicates(["sha256"])
    )
    return headers, payloads


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the archive's two tables below ``path``."""
    headers, payloads = records(pages, min_bytes)
    headers.write.parquet(f"{path}/headers")
    payloads.write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, packed, sha256) of every record, put together by the digest; ``packed`` is the zstandard frame."""
    headers = spark.read.schema("header binary, sha256 string").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, packed binary").parquet(f"{path}/payloads")
    return headers.join(payloads, "sha256", "left").select("header", "packed", "sha256")


def parse_header(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8").split(_LINE)
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def unpack(packed: bytes) -> bytes:
    return zstd.ZstdDecompressor().decompress(packed)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for header, packed, digest in zip(*(batch.column(i).to_pylist() for i in range(3))):
            payload = None if packed is None else unpack(packed)
            if payload is None or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload {digest} is missing or broken")
            fields = parse_header(header)
            sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if int(fields["Content-Length"]) != len(payload) or fields["WARC-Payload-Digest"] != f"sha1:{sha1}":
                raise ValueError(f"record {fields['WARC-Record-ID']} does not fit its payload")
            page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
            rows.append((
                None if page is None else int(page), fields.get("WARC-Target-URI"), len(payload), sha1,
                fields["WARC-Type"], None if refers is None else int(refers),
            ))
        columns = list(zip(*rows)) or [()] * len(_RECORD)
        yield pa.record_batch({n: pa.array(c, type=t) for (n, t), c in zip(_RECORD.items(), columns)})


_RECORD = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(),
}


def summary(archive: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, from its verified bytes."""
    return archive.mapInArrow(
        _parsed, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


@F.pandas_udf(T.StringType())
def _record_text(headers: pd.Series, packed: pd.Series) -> pd.Series:
    return pd.Series([(h + unpack(p)).decode("utf-8") for h, p in zip(headers, packed)], dtype=object)


def warc_text(archive: DataFrame) -> DataFrame:
    """One string column with whole records; written with ``lineSep`` of two line breaks it makes plain WARC files."""
    return archive.select(_record_text("header", "packed").alias("value"))


def write_warc_files(archive: DataFrame, path: str) -> None:
    """Plain .warc files: the records of each partition one after the other, each closed by two line breaks."""
    warc_text(archive).write.option("lineSep", _LINE * 2).text(path)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive the pages in the shared folder, read the archive back, and list what its records hold."""
    spark = pages.sparkSession
    path = f"{work_dir(spark)}/archives/{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    return summary(read_archive(spark, path))
