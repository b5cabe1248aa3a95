"""Loading each landing file once."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mastline.schemas import XDR
from mastline.sources.landing import with_origin


def stream_xdr(
    spark: SparkSession,
    landing: str,
    *,
    max_files: int | None = None,
    clean: str | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Usage records as their files arrive, with the file each came from.

    ``clean`` is 'delete' or 'archive': consumed files leave the landing folder one batch
    later. An empty folder is a courtesy; that each file counts once is the checkpoint's
    work.
    """
    reader = spark.readStream.schema(XDR).option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if clean is not None:
        reader = reader.option("cleanSource", clean)
    if archive is not None:
        reader = reader.option("sourceArchiveDir", archive)
    return with_origin(reader.parquet(landing))


def ingest_stream(records: DataFrame, raw: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last run to the raw table, then stop."""
    return (
        records.writeStream.format("parquet")
        .option("path", raw)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def within_bound(records: DataFrame, max_lateness_h: int | None) -> DataFrame:
    """Records at most so many hours late; without a bound, all. Unknown lateness stays."""
    if max_lateness_h is None:
        return records
    return records.filter(F.coalesce(~_beyond(max_lateness_h), F.lit(True)))


def beyond_bound(records: DataFrame, max_lateness_h: int) -> DataFrame:
    """The other records, for a table of their own: nothing is dropped unseen."""
    return records.filter(_beyond(max_lateness_h))


def _beyond(hours: int):
    return F.col("ingest_ts") - F.col("event_ts") > F.make_dt_interval(hours=F.lit(hours))
