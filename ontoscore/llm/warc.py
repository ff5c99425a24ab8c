"""Content-addressed WARC archive. DataFrame operations only, but for parsing plain WARC files.

An archive is a folder with two Parquet tables. `payloads` has each payload's bytes once, by its SHA-256. `headers` has the exact
header of every record and the digest of its payload. A join gives the original records back; digests are verified on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equal payloads of at least so many bytes make revisit records.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def _record_id(page: Column, url: Column, digest: Column, ordinal: Column) -> Column:
    """Differs between any two records: rows that are equal in page, url and payload are told apart by their ordinal."""
    h = F.md5(F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("null")), digest, ordinal.cast("string"), F.when(url.isNull(), "-").otherwise(F.concat(F.lit("+"), url))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _safe(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "\r", "%0D"), "\n", "%0A")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes one record per row of pages.

    A null payload is empty; a null url has no target header. Of records with equal payloads of `revisit_bytes` or more that with the
    largest id is the response and the others revisit it; null ids come first; rows that share the largest id are all responses.
    Shorter payloads are responses. Equal payloads are stored once in any case. Repeated rows are records of their own, each with its
    own record id; a revisit names the first record of the page it refers to. Long payloads are stored whole, as one value. An empty
    table makes an empty archive; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    # equal payloads combine in each task before they move, so a frequent one is no load
    rows.select("sha256", "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    light = rows.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"))
    groups = light.where(F.col("bytes") >= revisit_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("c")).where("c > 1").select("sha256", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    # repeated rows combine before they move, then get their ordinals
    each = light.groupBy(*light.columns).agg(F.count("*").alias("c")).withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c")))).drop("c")
    joined = each.join(groups, "sha256", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("sha256"), F.col("ordinal"))),
        F.coalesce(field("WARC-Target-URI", _safe(F.col("url"))), F.lit("")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.coalesce(field("WARC-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", _record_id(F.col("first_id"), F.col("first_url"), F.col("sha256"), F.lit(1))), field("WARC-Refers-To-Page", F.col("first_id").cast("string")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )
    joined.select(header.alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")


def _verified(payload: Column, digest: Column) -> Column:
    return F.when(F.sha2(payload, 256) == digest, payload).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), digest)).cast("string"))


def _field(name: str) -> Column:
    value = F.regexp_extract("header", rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the rebuilt records say and hold: page_id, payload_bytes, payload_digest, record_type, refers_to, url, sha256.

    Every record is rebuilt from its header and payload (read_records). Its block must be as long as the header says, and sizes and
    SHA-1 digests are those of the rebuilt payload, which the header must agree with.
    """
    block = F.expr(f"substring(record, length(header) + 3, length(record) - length(header) - {2 + len(END)})")
    size = _field("Content-Length").cast("long")
    facts = read_records(spark, path).select("header", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.octet_length(block).cast("long").alias("block_bytes"))
    right = F.concat(F.lit("sha1:"), F.col("sha1")).eqNullSafe(_field("WARC-Payload-Digest")) & F.col("block_bytes").eqNullSafe(size)
    digest = F.when(right, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("a record differs from its header, payload "), F.col("sha256"))).cast("string"))
    return facts.select(_field("WARC-Page-ID").cast("long").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), _field("WARC-Type").alias("record_type"), _field("WARC-Refers-To-Page").cast("long").alias("refers_to"), _field("WARC-Target-URI").alias("url"), "sha256")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: header, sha256, payload (of a revisit too: the one it refers to), record (the exact bytes of a WARC record).

    Payloads move once; where one payload has very many records, adaptive execution splits those and repeats the payload.
    """
    headers = spark.read.schema("header string, sha256 string").parquet(f"{path}/headers")
    stored = spark.read.schema("sha256 string, payload string").parquet(f"{path}/payloads").withColumn("payload", _verified(F.col("payload"), F.col("sha256")))
    body = F.when(_field("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    known = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no payload for "), F.col("sha256"))).cast("string"))
    return headers.join(stored, "sha256", "left").withColumn("payload", known).select("header", "sha256", "payload", F.concat("header", F.lit("\r\n"), body, F.lit(END)).alias("record"))


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """Plain WARC files, gzip-compressed: the text writer's line separator ends each record."""
    whole = read_records(spark, path).select(F.expr(f"substring(record, 1, length(record) - {len(END)})").alias("value"))
    whole.write.option("lineSep", END).option("compression", "gzip").text(to)


def parse_warc(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, payload) of each record of a plain WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        header = data[at : end + 2].decode()
        size = next(int(x.split(":", 1)[1]) for x in header.split("\r\n") if x.lower().startswith("content-length:"))
        yield header, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain or gzip): header, payload. One task reads one file."""
    import gzip

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows = list(parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["header", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "header string, payload binary")
