"""The landing folder and the raw table of usage records."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mastline.operators.joins import spread_join
from mastline.schemas import XDR

FILE, LOADED = "source_file", "source_modified"
RAW = T.StructType(
    [*XDR.fields, T.StructField(FILE, T.StringType()), T.StructField(LOADED, T.TimestampType())]
)


def scan_xdr(spark: SparkSession, path: str) -> DataFrame:
    """Usage records of every file below a folder; dt= and hour= folders are no columns."""
    return spark.read.schema(XDR).option("recursiveFileLookup", True).parquet(path)


def peek(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """A few records, to see that the files are readable."""
    return scan_xdr(spark, path).limit(n)


def with_origin(df: DataFrame) -> DataFrame:
    """Add the file a row was read from; only valid right on a file scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_modification_time").alias(LOADED),
    )


def list_landing(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of the landing files; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def write_landing(
    df: DataFrame, path: str, batch: Sequence[str] = ("batch_id", "batch_type")
) -> None:
    """Append batches as dt=/hour= folders, each batch under its earliest ingest hour.

    The rows are rebalanced by folder, so a folder gets few files and a large batch is
    still written by many tasks.
    """
    start = df.groupBy(*batch).agg(F.min("ingest_ts").alias("_start"))
    placed = spread_join(df, start, list(batch), "left", spread=["xdr_id"])
    placed.select(
        *df.columns,
        F.date_format("_start", "yyyy-MM-dd").alias("dt"),
        F.date_format("_start", "HH").alias("hour"),
    ).hint("rebalance", "dt", "hour").write.partitionBy("dt", "hour").mode("append").parquet(path)


def copy_append(spark: SparkSession, landing: str, raw: str) -> None:
    """Append every landing file to the raw table. Run twice, it loads the files twice."""
    with_origin(scan_xdr(spark, landing)).write.mode("append").parquet(raw)


def read_raw(spark: SparkSession, raw: str) -> DataFrame:
    """The raw table with the origin of each row."""
    return spark.read.schema(RAW).parquet(raw)


def load_history(raw: DataFrame) -> DataFrame:
    """Per source file: rows loaded, the batches in it, its time."""
    return raw.groupBy(F.col(FILE).alias("file")).agg(
        F.count("*").alias("rows_loaded"),
        F.min("batch_id").alias("first_batch"),
        F.max("batch_id").alias("last_batch"),
        F.max(LOADED).alias("modified"),
    )


def unpurged_files(landing: DataFrame, history: DataFrame) -> DataFrame:
    """Files that were loaded and still lie in the landing folder."""
    return landing.join(history.select(F.col("file").alias("path")), "path", "left_semi")
