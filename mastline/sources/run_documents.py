"""JSON documents of runs, wherever they were collected, as tables.

A run is a folder: ``manifest.json`` lists its statements, ``plan.json`` its sizes, and
``<sequence>_<label>.json`` holds what one request gave back, in ``rows``. Refresh histories
have the label ``history``, job lists ``recent_jobs``; what a job says of itself lies in a
folder ``profiles_<run>``. Documents come as files or packed into an archive table of path and
content, the form for any number of small documents.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mastline.functions.usage import interval_seconds
from mastline.sources.reports import PROFILE

#: label of a result document -> the field of its first row that counts
RESULTS = {
    "affected_customers": "affected_customers",
    "tag_transitions": "flag_transitions",
    "verify": "mismatches",
    "verify_reverse": "mismatches",
    "verify_counts": "customers",
}
ARCHIVE = "path string, content string"


def scan_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of document files."""
    return (
        spark.read.text(glob, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def write_archive(documents: DataFrame, folder: str) -> None:
    documents.select("path", "content").write.parquet(folder)


def scan_archive(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).parquet(folder)


def located(documents: DataFrame) -> DataFrame:
    """(run_id, sequence, label, content): what a document's path says about it."""
    part = lambda at: F.element_at(F.split("path", "/"), at)
    number = F.regexp_extract(part(-1), r"^(\d+)_", 1)
    return documents.select(
        part(-2).alias("run_id"),
        F.when(number != "", number).cast("int").alias("sequence"),
        F.regexp_replace(part(-1), r"^\d+_|\.json$", "").alias("label"),
        "content",
    )


def _parsed(schema: str) -> Column:
    """The content; a document that is no JSON of this shape fails the query."""
    return F.from_json("content", schema, {"mode": "FAILFAST"})


def _rows(documents: DataFrame, label: str, schema: str) -> DataFrame:
    found = located(documents).filter(F.col("label") == label)
    return found.select(
        "run_id",
        F.col("sequence").alias("snapshot"),
        F.explode(_parsed(f"rows array<struct<{schema}>>")["rows"]).alias("r"),
    ).select("run_id", "snapshot", "r.*")


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration written as [months, days, nanoseconds] or as a number."""
    triple = F.from_json(text, "array<bigint>", {"mode": "FAILFAST"})
    listed = F.when(text.startswith("["), triple)
    return F.when(
        text.startswith("["), interval_seconds(listed[0], listed[1], listed[2])
    ).otherwise(F.when(~text.startswith("["), text).cast("double"))


def manifests(documents: DataFrame) -> DataFrame:
    """(run_id, seq, label, category, job_id, ok), a row for each statement in order."""
    schema = "array<struct<label string, category string, job_ids array<string>, ok boolean>>"
    listed = located(documents).filter(F.col("label") == "manifest")
    return listed.select("run_id", F.posexplode(_parsed(schema)).alias("seq", "s")).select(
        "run_id",
        "seq",
        "s.label",
        "s.category",
        F.try_element_at("s.job_ids", F.lit(1)).alias("job_id"),
        "s.ok",
    )


def plans(documents: DataFrame) -> DataFrame:
    """(run_id, customers, subscriptions, selected_customers)."""
    config = _parsed(
        "config struct<customers bigint, subscriptions bigint, changed bigint>"
    )["config"]
    return (
        located(documents)
        .filter(F.col("label") == "plan")
        .select("run_id", config.alias("c"))
        .select("run_id", "c.customers", "c.subscriptions", F.col("c.changed").alias("selected_customers"))
    )


def histories(documents: DataFrame) -> DataFrame:
    """(run_id, snapshot, job_id, refresh_mode, duration_s, end_time) of all refreshes."""
    rows = _rows(
        documents, "history", "job_id string, refresh_mode string, duration string, end_time timestamp_ntz"
    )
    seconds = duration_seconds(F.col("duration")).alias("duration_s")
    return rows.select("run_id", "snapshot", "job_id", "refresh_mode", seconds, "end_time")


def jobs(documents: DataFrame) -> DataFrame:
    """(snapshot, job_id, execution_s, end_time) of all jobs, whichever run listed them."""
    rows = _rows(documents, "recent_jobs", "job_id string, execution_time string, end_time timestamp_ntz")
    seconds = duration_seconds(F.col("execution_time")).alias("execution_s")
    return rows.select("snapshot", "job_id", seconds, "end_time")


def profiles(documents: DataFrame) -> DataFrame:
    """(run_id, label, stats, meter) of the profile folders."""
    summary = F.col("p.data.jobSummary")
    return (
        located(documents)
        .filter(F.col("run_id").startswith("profiles_"))
        .select(
            F.regexp_replace("run_id", "^profiles_", "").alias("run_id"),
            "label",
            _parsed(PROFILE).alias("p"),
        )
        .select(
            "run_id",
            "label",
            summary["stats"]["inputOutputStats"].alias("stats"),
            summary["meter"]["measurements"].alias("meter"),
        )
    )


def results(documents: DataFrame) -> DataFrame:
    """One row per run: the values of its result documents side by side.

    Of several documents with one label the first counts; a document without rows, or none
    at all, leaves NULL. ``changed_source_rows`` adds up all ``qualifying_rows_...`` documents.
    """
    first = F.try_element_at(_parsed("rows array<map<string, string>>")["rows"], F.lit(1))
    changed = F.col("label").startswith("qualifying_rows_")
    rows = (
        located(documents)
        .filter(F.col("label").isin(list(RESULTS)) | changed)
        .filter(~F.col("run_id").startswith("profiles_"))
        .select("run_id", "sequence", "label", first.alias("first"))
    )
    value = lambda field: F.try_element_at("first", F.lit(field)).cast("bigint")
    chosen = [
        F.min_by(
            F.struct(value(field).alias("v")), F.when(F.col("label") == label, F.col("sequence"))
        )["v"].alias(label)
        for label, field in RESULTS.items()
    ]
    total = F.sum(F.when(changed, value("qualifying_source_rows")))
    return rows.groupBy("run_id").agg(
        *chosen, F.coalesce(total, F.lit(0)).alias("changed_source_rows")
    )


def prices(documents: DataFrame) -> DataFrame:
    """(sku_code, measurements_unit, price_rate, discount_rate) of the observed rates."""
    return _rows(
        documents,
        "observed_rates",
        "sku_code string, measurements_unit string, price_rate string, discount_rate double",
    ).select("sku_code", "measurements_unit", F.col("price_rate").cast("double").alias("price_rate"), "discount_rate")
