"""Run documents in, reports out."""

from pyspark.sql import DataFrame, SparkSession, functions as F

PROFILE = (
    "data struct<jobSummary: struct<"
    "stats: struct<inputOutputStats: map<string, string>>,"
    "meter: struct<measurements: array<struct<key: string, unit: string, value: string>>>>>"
)


def scan_documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON documents with a declared schema, and the folder (run) and file they came from."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(glob)
        .select("*", F.col("_metadata.file_path").alias("_path"))
        .withColumns(
            {
                "run_id": F.element_at(F.split("_path", "/"), -2),
                "file": F.element_at(F.split("_path", "/"), -1),
            }
        )
        .drop("_path")
    )


def scan_rows(spark: SparkSession, glob: str, row_schema: str) -> DataFrame:
    """Result documents: one row per entry of their ``rows`` list."""
    documents = scan_documents(spark, glob, f"rows array<struct<{row_schema}>>")
    return documents.select("run_id", "file", F.explode("rows").alias("r")).select(
        "run_id", "file", "r.*"
    )


def scan_profiles(spark: SparkSession, glob: str) -> DataFrame:
    """Job profile documents, named <number>_<label>.json in a folder profiles_<run>."""
    summary = F.col("data.jobSummary")
    return scan_documents(spark, glob, PROFILE).select(
        F.regexp_replace("run_id", "^profiles_", "").alias("run_id"),
        F.regexp_replace("file", r"^\d+_|\.json$", "").alias("label"),
        summary["stats"]["inputOutputStats"].alias("stats"),
        summary["meter"]["measurements"].alias("meter"),
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report; a missing value is an empty field in CSV and left out in JSON."""
    if fmt == "csv":
        df.write.option("header", True).option("emptyValue", "").csv(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"no report format {fmt!r}")
