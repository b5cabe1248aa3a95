"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables:

    payloads   digest, payload: the bytes of each payload once, under their SHA-256
    records    page_id, head, digest: the exact header block of every record, in the order
               and bytes of a WARC file, and the digest of the payload that belongs to it

The head holds the WARC header lines and the HTTP header lines of the block. A response
record is its head, its payload and two line ends; a revisit record has no payload of its
own and names the record that has. Record ids are ``<urn:page:ID:DIGEST:N>``, N counting the
rows of one page id and payload, so that no two records share one. ``records`` brings heads and payloads together again by a
join on the digest and checks every payload against it.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_REVISIT = 100  # bytes from which an equal payload is not recorded again
NO_DATE = "1970-01-01T00:00:00Z"  # of records whose time of capture is not known
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _utf8(text: Column) -> Column:
    return F.encode(text, "utf-8")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends within a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_END)), F.lit(""))


def _urn(page_id: Column, place: Column) -> Column:
    page = F.coalesce(F.url_encode(page_id.cast("string")), F.lit(""))
    return F.concat(
        F.lit("<urn:page:"), page, F.lit(":"), "digest", F.lit(":"), place.cast("string"), F.lit(">")
    )


def _head(revisit: Column) -> Column:
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(_END * 2),
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("place"))),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first_id"), F.lit(1)))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(_END),
        http,
    )


def write(
    pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: Column | None = None
) -> None:
    """Archive one record for every row of ``pages``: page_id, url and html.

    The payload is the html in UTF-8, a null one empty; a null url has no target line. Of
    records with equal payloads of ``min_revisit`` bytes or more, that with the smallest
    page_id is the response; of several rows with that id, one. Null ids come last and stand
    as an empty ID. ``date`` is the time of capture as ``YYYY-MM-DDThh:mm:ssZ``; where it is
    not given or null, ``NO_DATE`` stands for it. Further columns are not read; an empty table
    makes an empty archive.
    """
    spark = pages.sparkSession
    given = F.lit(NO_DATE) if date is None else F.coalesce(date.cast("string"), F.lit(NO_DATE))
    payload = _utf8(F.coalesce("html", F.lit("")))
    hashed = pages.select(
        "page_id", "url", given.alias("date"), payload.alias("payload")
    ).withColumn(
        "digest", F.sha2("payload", 256)
    )
    # equal payloads collapse in the task that reads them, before they are moved
    hashed.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{folder}/payloads")
    heads = hashed.select(
        "page_id", "url", "date", "digest", F.octet_length("payload").alias("n_bytes")
    )
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    # written, so that the join starts from two plain exchanges and a hot digest can be split
    first.write.parquet(f"{folder}/first")
    first = spark.read.schema(first.schema).parquet(f"{folder}/first")
    again = Window.partitionBy("digest", "page_id").orderBy("url", "date")
    ranked = heads.withColumn("place", F.row_number().over(again)).join(first, "digest")
    revisit = (F.col("n_bytes") >= min_revisit) & ~(
        F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("place") == 1)
    )
    ranked.select("page_id", _utf8(_head(revisit)).alias("head"), "digest").write.parquet(
        f"{folder}/records"
    )


def _field(name: str) -> Column:
    """A header line's value; the WARC lines come before the HTTP lines."""
    found = F.regexp_extract(F.decode("head", "utf-8"), rf"^(?s).*?\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``(head, payload, record)`` of every record, verified against the digest in its head.

    ``record`` is the record as it stands in a WARC file; ``payload`` is there for revisits
    too. A payload that is missing or has another digest is an error.
    """
    payloads = spark.read.parquet(f"{folder}/payloads")
    heads = spark.read.parquet(f"{folder}/records").select("head", "digest")
    payloads = payloads.select(
        F.col("digest").alias("key"),
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).alias("payload"),
    )
    joined = heads.join(payloads, F.col("digest") == F.col("key"), "left")
    wrong = F.col("payload").isNull() | (_field("WARC-Payload-Digest") != F.concat(F.lit("sha256:"), "digest"))
    payload = F.when(wrong, F.raise_error(F.concat(F.lit("payload not as its digest: "), "digest"))).otherwise(
        F.col("payload")
    )
    end = _utf8(F.lit(_END * 2))
    own = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(_utf8(F.lit("")))
    return joined.select("head", payload.cast("binary").alias("payload")).select(
        "head", "payload", F.concat("head", own, end).alias("record")
    )


def listed(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """What the archive says of each page, read from heads and payloads.

    ``id_type`` is the type of the page ids that were written; an empty one is null.
    """

    def of(name: str) -> Column:
        page = F.regexp_extract(_field(name), "<urn:page:([^:>]*):", 1)
        return F.when(page != "", F.url_decode(page)).cast(id_type)

    return records(spark, folder).select(
        of("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        of("WARC-Refers-To").alias("refers_to"),
    )
