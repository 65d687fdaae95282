"""Content-addressed WARC archive.

An archive is a folder with two tables. `payloads` holds every payload's bytes once under its
SHA-256; `headers` holds each record's exact header block and the digest it points to. Records are
rebuilt byte for byte by a join of the two, and digests are verified on the bytes that were read.

Of records with equal payloads of at least `least` bytes the one with the smallest id is a response,
the others are revisits that refer to it; smaller payloads are always responses.

Scale: grouping needs only (id, digest, length). Payload bytes are shuffled once, when they are stored, after
a partial aggregate, so a payload that a third of all pages share is one row per task. They are stored
in buckets of their digest: the join that rebuilds records moves headers to the payloads and no
payload, but for digests of more than `split` records, whose headers are dealt out by a salt to as many
copies of the payload.

Defined cases: a null payload is empty; a null url is written as an empty target; line terminators in a
url are percent-encoded; rows with equal
ids and payloads (repeated rows) stay rows, one of them the response; null ids sort last among equal
payloads; empty tables make empty archives; extra columns are not read.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.shared import delete_folder, materialise, pick, small, table_path

#: Fixed values of the WARC/1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


#: Characters that some reader takes as the end of a line, percent-encoded in a target.
TERMINATORS = {"\r": "%0D", "\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\x1c": "%1C", "\x1d": "%1D", "\x1e": "%1E", "\x85": "%C2%85", "\u2028": "%E2%80%A8", "\u2029": "%E2%80%A9"}


def _target(url: Column) -> Column:
    for c, encoded in TERMINATORS.items():
        url = F.replace(url, F.lit(c), F.lit(encoded))
    return url


def write_archive(pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of pages to `path` (a new folder that all executors share)."""
    spark = pages.sparkSession
    pages = pick(pages, id_col, url_col, payload_col)
    body = F.encode(F.coalesce(pages[payload_col].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # equal digests hold equal bytes, so any of them will do, and a task sends each digest once; with as
    # many buckets as the aggregate has partitions, a bucket is written by one task
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    once = rows.groupBy("digest").agg(F.any_value("payload").alias("payload"))
    name = f"cellweave_{uuid.uuid4().hex}"
    once.write.format("parquet").bucketBy(buckets, "digest").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")
    # the row number is fixed by writing it: all later steps read it from this table
    rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")).write.parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows")
    key = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("row"))
    first = held.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), "n").write.parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    # only digests of several records need the join, those of very many a broadcast
    several = first.where("n > 1")
    records = held.select("page_id", "url", "digest", "bytes", "row").join(small(several), "digest", "left")
    again = F.coalesce((F.col("bytes") >= least) & (F.col("row") != F.col("first_row")), F.lit(False))

    def record_id(page, row):
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))

    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("row"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _target(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first_id"), F.col("first_row")))),
        F.when(again, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    head = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")
    records.select("row", "digest", F.coalesce("n", F.lit(1)).alias("n"), head.alias("header")).write.parquet(f"{path}/headers")
    delete_folder(spark, f"{path}/rows")
    delete_folder(spark, f"{path}/first")


def _field(name: str) -> Column:
    """The value of a header field; a line ends with CRLF and nothing else."""
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) as stored, in buckets."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    name = f"cellweave_{uuid.uuid4().hex}"
    where = f"{path}/payloads".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} (digest STRING, payload BINARY) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{where}'")
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan of held has its files
    return held


def _verified(payloads: DataFrame, *more: str) -> DataFrame:
    """Payloads; one whose bytes don't have the digest they are stored under makes the read fail."""
    wrong = F.raise_error(F.concat(F.lit("stored payload does not match digest "), F.col("digest")))
    return payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload"), *more)


def read_records(spark: SparkSession, path: str, split: int = 2000) -> DataFrame:
    """(row, header, payload, record): each record rebuilt exactly, a revisit's payload through its digest."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), _payloads(spark, path)
    joined = headers.where(f"n <= {split}").join(_verified(payloads), "digest").select("row", "header", "payload")
    hot = headers.where(f"n > {split}").groupBy("digest").agg(F.ceil(F.count("*") / split).cast("int").alias("copies"))
    hot = materialise(hot, "hot-payloads")
    if not hot.isEmpty():
        # the copies of a hot payload, each with a salt, and its headers dealt out over the salts
        copies = _verified(payloads.join(small(hot), "digest"), "copies").select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        dealt = headers.where(f"n > {split}").withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / split)).cast("int"))
        joined = joined.unionByName(dealt.join(copies, ["digest", "salt"]).select("row", "header", "payload"))
    own = F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return joined.select("row", "header", "payload", F.concat("header", own, F.encode(F.lit(CRLF + CRLF), "UTF-8")).alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each rebuilt record; a response's
    length is that of the record's block. The digests were verified on the bytes that were joined."""
    block = F.octet_length("record") - F.octet_length("header") - len(CRLF + CRLF)
    page = F.regexp_extract(_field("WARC-Record-ID"), r"<urn:page:(-?\d+):", 1)
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+):", 1)
    again = _field("WARC-Type") == "revisit"
    return read_records(spark, path).select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.when(again, F.octet_length("payload")).otherwise(block).cast("long").alias("payload_bytes"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"sha256:([0-9a-f]+)", 1).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """WARC files of the archive's records (gzip), written by Spark's text writer."""
    body = F.decode(F.col("record"), "UTF-8")
    read_records(spark, path).select(F.substring(body, F.lit(1), F.length(body) - 4).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(out)


def round_trip(pages: DataFrame, least: int = 100, **columns: str) -> DataFrame:
    """Write an archive of pages to the shared folder and read it back."""
    spark = pages.sparkSession
    path = table_path(spark, "warc")
    write_archive(pages, path, least, **columns)
    return read_index(spark, path)
