"""Distinct subscribers that can be added up: sketches kept per cell-hour."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mastline.operators.joins import keep_keys
from mastline.operators.rollups import CELL_HOUR, MONEY

LG_K = 12  # 4,096 slots: a standard error of 1.6 %
_DAY = "event_date"
HOURS = (
    "event_hour timestamp_ntz, cell_id string, rat string, sessions bigint, bytes bigint,"
    f" revenue {MONEY}, subscribers binary, {_DAY} date"
)


def hourly_sketches(sessions: DataFrame) -> DataFrame:
    """Usage and a sketch of the subscribers per event hour, cell and radio technology.

    Summed per subscriber first, so that a busy cell-hour is spread over its subscribers.
    Sessions without a subscriber count as sessions only.
    """
    per_subscriber = sessions.groupBy(*CELL_HOUR, "msisdn").agg(
        F.count("*").alias("sessions"),
        F.sum(F.coalesce("bytes_dl", F.lit(0)) + F.coalesce("bytes_ul", F.lit(0))).alias("bytes"),
        F.sum("rated_amount").alias("revenue"),
    )
    return per_subscriber.groupBy(*CELL_HOUR).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("bytes").alias("bytes"),
        F.sum("revenue").cast(MONEY).alias("revenue"),
        F.hll_sketch_agg("msisdn", F.lit(LG_K)).alias("subscribers"),
        F.to_date("event_hour").alias(_DAY),
    )


def merged(hours: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Totals of cell-hours by day, cell or anything else; only the sketches are read."""
    return hours.groupBy(*by).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("bytes").alias("bytes"),
        F.sum("revenue").cast(MONEY).alias("revenue"),
        F.hll_sketch_estimate(F.hll_union_agg("subscribers")).alias("subscribers_approx"),
    )


def touched_days(before: DataFrame, arrived: DataFrame) -> DataFrame:
    """Event days of new records, and of the sessions that they may replace."""
    day = F.to_date("event_ts").alias(_DAY)
    replaced = keep_keys(before, arrived.select("xdr_id").distinct(), ["xdr_id"])
    return arrived.select(day).union(replaced.select(day)).distinct()


class SketchTable:
    """Sketches per cell-hour in a folder by event day.

    A sketch cannot forget a subscriber, so days that a correction touched are made anew
    from the sessions. Rebuilding days twice gives the same rows, so a run that failed half
    way is simply repeated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, sessions: DataFrame) -> None:
        self._write(hourly_sketches(sessions))

    def rebuild(self, sessions: DataFrame, days: DataFrame) -> None:
        """Replace the given days, also those that have no sessions any more."""
        wanted = sessions.withColumn(_DAY, F.to_date("event_ts"))
        rows = hourly_sketches(keep_keys(wanted, days, [_DAY]).drop(_DAY))
        # an empty row a day, or a day without sessions would keep its old files
        self._write(rows.unionByName(days.select(_DAY), allowMissingColumns=True))

    def _write(self, rows: DataFrame) -> None:
        (
            rows.hint("rebalance", _DAY)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(_DAY)
            .parquet(self.path)
        )

    def read(self) -> DataFrame:
        return self.spark.read.schema(HOURS).parquet(self.path).filter("sessions IS NOT NULL")
