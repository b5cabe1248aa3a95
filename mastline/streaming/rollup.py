"""The usage rollups kept current, with corrections taken back exactly.

COUNT DISTINCT and MAX cannot be updated by adding, so the rollups rest on signed
contributions: per row of a rollup, and per value that is counted or compared (subscriber,
lateness, event hour), how much each micro-batch added or took back. A record that is
superseded takes back what it had contributed, wherever that was.

One table of record images feeds all rollups. The stream's keyed state knows the current
image of every record, how often it was seen and on which event days. So only records seen
before look for the image they replace, and only in the folders of those days. Work per
micro-batch follows the batch and the days it touches, not the history: the days, a bounded
list, become literal partition filters, and the logs are folded every ``compact_every``
versions.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from mastline.functions.usage import hour_of, hours_between, lateness_bucket
from mastline.operators.joins import keep_keys
from mastline.operators.rollups import CELL_HOUR, cell_hours
from mastline.operators.versions import version_order
from mastline.sources.store import Commit, CommitLog, KeyedTable, consume, now

_NO_DAY = "1900-01-01"  # folder of records without a time
_VERSION = "_version"
_TYPES = {
    "event_hour": "timestamp_ntz",
    "cell_id": "string",
    "rat": "string",
    "msisdn": "string",
    "event_date": "date",
    "ingest_hour": "timestamp_ntz",
    "lateness_h": "bigint",
    "lateness_bucket": "string",
    "bytes_dl": "bigint",
    "bytes_ul": "bigint",
    "bytes_total": "bigint",
    "duration_s": "bigint",
    "rated_amount": "decimal(22,4)",
    "very_late": "bigint",
}
_IMAGES = (
    "xdr_id string, "
    + ", ".join(f"{name} {kind}" for name, kind in _TYPES.items())
    + ", ingest_day date, seen bigint, days array<date>, _version bigint, day date"
)
HOURLY = (
    "event_hour timestamp_ntz, cell_id string, rat string, sessions bigint, uniq_subs bigint,"
    " uniq_subs_approx bigint, bytes_dl bigint, bytes_ul bigint, revenue decimal(22,4),"
    " very_late_records bigint"
)
DAILY = (
    "event_date date, msisdn string, bytes_total bigint, voice_s bigint,"
    " revenue decimal(22,4), max_lateness_h bigint"
)
AUDIT = (
    "ingest_hour timestamp_ntz, lateness_bucket string, records bigint,"
    " event_hours_touched bigint"
)


@dataclass(frozen=True)
class Rollup:
    """One rollup: its rows, what contributions are kept by besides, and how rows are made.

    ``settle`` gets one row per key and grain with ``sessions`` (0: gone) and the measures
    of those that are there; its result has ``_left``, the records behind each row.
    """

    name: str
    key: Sequence[str]
    grain: Sequence[str]
    measures: Sequence[str]
    day: str
    schema: str
    settle: Callable[[DataFrame], DataFrame]

    @property
    def by(self) -> list[str]:
        return [*self.key, *self.grain]

    @property
    def sums(self) -> list[str]:
        return ["sessions", *self.measures, *[f"n_{name}" for name in self.measures]]

    @property
    def contributions(self) -> str:
        columns = [f"{name} {_TYPES[name]}" for name in self.by]
        columns += [f"{name} {_TYPES.get(name, 'bigint')}" for name in self.sums]
        return ", ".join([*columns, "_version bigint", "day date"])

    def typed(self, df: DataFrame) -> DataFrame:
        """The sums as declared, without those that came to nothing."""
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(self.contributions)}
        some = " OR ".join(f"{name} <> 0" for name in self.sums)
        return df.withColumns({c: F.col(c).cast(kinds[c]) for c in self.sums}).filter(some)


def _there(value: str) -> Column:
    return F.when(F.col("sessions") > 0, F.col(value))


def _hourly_rows(total: DataFrame) -> DataFrame:
    return cell_hours(
        total.withColumns({"msisdn": _there("msisdn"), "revenue": F.col("rated_amount")})
        .withColumn("very_late_records", F.coalesce("very_late", F.lit(0)))
    ).withColumn("_left", F.col("sessions"))


def _daily_rows(total: DataFrame) -> DataFrame:
    return total.groupBy("event_date", "msisdn").agg(
        F.sum("bytes_total").alias("bytes_total"),
        F.sum("duration_s").alias("voice_s"),
        F.sum("rated_amount").alias("revenue"),
        F.max(_there("lateness_h")).alias("max_lateness_h"),
        F.sum("sessions").alias("_left"),
    )


def _audit_rows(total: DataFrame) -> DataFrame:
    return total.groupBy("ingest_hour", "lateness_bucket").agg(
        F.sum("sessions").alias("records"),
        F.count(_there("event_hour")).alias("event_hours_touched"),
        F.sum("sessions").alias("_left"),
    )


ROLLUPS = (
    Rollup(
        "hourly",
        CELL_HOUR,
        ["msisdn"],
        ["bytes_dl", "bytes_ul", "rated_amount", "very_late"],
        "day",
        HOURLY,
        _hourly_rows,
    ),
    Rollup(
        "daily",
        ["event_date", "msisdn"],
        ["lateness_h"],
        ["bytes_total", "duration_s", "rated_amount"],
        "day",
        DAILY,
        _daily_rows,
    ),
    Rollup(
        "audit", ["ingest_hour", "lateness_bucket"], ["event_hour"], [], "ingest_day", AUDIT, _audit_rows
    ),
)


def _day(ts: Column) -> Column:
    return F.coalesce(F.to_date(ts), F.lit(_NO_DAY).cast("date"))


def current_images(records: DataFrame) -> DataFrame:
    """Per record: what the rollups need of its current version, in update mode.

    There is no watermark; the state keeps every id, as a late correction may come any
    time. The set of event days of an id is the only list in it.
    """
    event, arrived = F.col("event_ts"), F.col("ingest_ts")
    lateness = hours_between(event, arrived)
    values = {
        "event_hour": hour_of(event),
        "event_date": F.to_date(event),
        "ingest_hour": hour_of(arrived),
        "lateness_h": lateness,
        "lateness_bucket": lateness_bucket(lateness),
        "bytes_total": F.col("bytes_dl") + F.col("bytes_ul"),
        "very_late": F.when(lateness >= 24, 1).otherwise(0),
    }
    image = F.struct(
        *[values.get(name, F.col(name)).cast(kind).alias(name) for name, kind in _TYPES.items()]
    )
    return (
        records.groupBy("xdr_id")
        .agg(
            F.max_by(image, version_order()).alias("i"),
            F.count("*").alias("seen"),
            F.collect_set(_day(event)).alias("days"),
        )
        .select(
            "xdr_id",
            "i.*",
            _day(F.col("i.ingest_hour")).alias("ingest_day"),
            "seen",
            "days",
            _day(F.col("i.event_hour")).alias("day"),
        )
    )


def _contributions(signed: DataFrame, rollup: Rollup) -> DataFrame:
    sign = F.col("_sign")
    amounts = []
    for name in rollup.measures:
        value = F.col(name)
        amounts += [
            F.sum(sign * F.coalesce(value, F.lit(0))).alias(name),
            # a sum over nothing but NULL is NULL, so the known values are counted too
            F.sum(F.when(value.isNotNull(), sign).otherwise(0)).alias(f"n_{name}"),
        ]
    day = F.col(rollup.day).alias("day")
    return rollup.typed(
        signed.groupBy(*rollup.by, day).agg(F.sum(sign).alias("sessions"), *amounts)
    )


class UsageRollups:
    """The maintained rollups: images and contributions by day, results as keyed tables."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        rollups: Sequence[Rollup] = ROLLUPS,
        compact_every: int = 100,
    ):
        self.spark, self.path, self.compact_every = spark, path, compact_every
        self.rollups = {rollup.name: rollup for rollup in rollups}
        self.log = CommitLog(spark, f"{path}/commits")
        self.tables = {
            name: KeyedTable(f"{path}/{name}", list(r.key), r.schema, self.log)
            for name, r in self.rollups.items()
        }

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def history(self) -> DataFrame:
        """What every micro-batch did to every rollup."""
        return self.log.table().filter("table_name <> 'logs'").drop("kind")

    def _folder(self, name: str) -> str:
        """Where images or contributions are kept since the last compaction."""
        generation = max((c.version for c in self.log.commits() if c.kind == "logs"), default=-1)
        return f"{self.path}/logs/{generation + 1}/{name}"

    def _images(self) -> DataFrame:
        return self.spark.read.schema(_IMAGES).parquet(self._folder("images"))

    def _log(self, rollup: Rollup) -> DataFrame:
        folder = self._folder(f"contributions-{rollup.name}")
        return self.spark.read.schema(rollup.contributions).parquet(folder)

    def absorb(self, images: DataFrame, version: int) -> None:
        """Take in the changed records of a micro-batch; a replayed batch changes nothing.

        The rollups become visible together, when their commits are written.
        """
        if all(table.has(version) for table in self.tables.values()):
            return consume(images)
        self._write(images, self._folder("images"), version)
        known = self._images()
        fresh = known.filter(F.col(_VERSION) == version)
        columns = ["day", "ingest_day", *_TYPES]
        signed = fresh.select(*columns, F.lit(1).alias("_sign")).unionByName(
            self._replaced(known, fresh, version).select(*columns, F.lit(-1).alias("_sign"))
        )
        for name, rollup in self.rollups.items():
            folder = self._folder(f"contributions-{name}")
            self._write(_contributions(signed, rollup), folder, version)
            rows = rollup.settle(_totals(self._standing(version, name), rollup))
            self.tables[name].upsert(rows, version, removed=F.col("_left") == 0)
        self.log.write()
        if version % self.compact_every == self.compact_every - 1:
            self.compact()

    def _standing(self, version: int, name: str) -> DataFrame:
        """All contributions to the rows of a rollup that a version touched."""
        rollup = self.rollups[name]
        log = self._log(rollup)
        touched = log.filter(F.col(_VERSION) == version).select(*rollup.key, "day").distinct()
        upto = log.filter((F.col(_VERSION) <= version) & _on_days(touched))
        return keep_keys(upto, touched, rollup.key, plain=["day"])

    def compact(self) -> None:
        """Fold the logs: one image per record, one contribution per row and grain.

        Runs between micro-batches. The new folder counts once its commit is written; the
        old one is left to the owner of the storage.
        """
        last = max(c.version for c in self.log.commits() if c.table_name in self.tables)
        started = now()
        upto = F.col(_VERSION) <= last
        generation = 1 + max((c.version for c in self.log.commits() if c.kind == "logs"), default=-1)
        target = f"{self.path}/logs/{generation + 1}"
        images = _newest(self._images().filter(upto)).drop(_VERSION)
        self._write(images, f"{target}/images", last)
        for name, rollup in self.rollups.items():
            sums = [F.sum(c).alias(c) for c in rollup.sums]
            folded = self._log(rollup).filter(upto).groupBy(*rollup.by, "day").agg(*sums)
            self._write(rollup.typed(folded), f"{target}/contributions-{name}", last)
        self.log.add(Commit(generation, "logs", "logs", "FULL", 0, 0, 0, started, now()))
        self.log.write()
        for table in self.tables.values():
            table.compact()

    def _write(self, df: DataFrame, path: str, version: int) -> None:
        df.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(
            f"{path}/{_VERSION}={version}"
        )

    def _replaced(self, known: DataFrame, fresh: DataFrame, version: int) -> DataFrame:
        """The images that records of this micro-batch had before it."""
        again = fresh.filter("seen > 1").select("xdr_id", F.explode("days").alias("day"))
        before = known.filter((F.col(_VERSION) < version) & _on_days(again))
        return _newest(keep_keys(before, again, ["xdr_id"], plain=["day"]))


def _on_days(rows: DataFrame) -> Column:
    """Whether a folder's day is among those of ``rows``, as literals: one value a day.

    Pruning by a join would depend on Spark broadcasting the other side.
    """
    days = [row["day"] for row in rows.select("day").distinct().collect()]
    return F.col("day").isin(days) if days else F.lit(False)


def _newest(images: DataFrame) -> DataFrame:
    """The last image written for each record."""
    last_first = Window.partitionBy("xdr_id").orderBy(F.col(_VERSION).desc())
    ranked = images.withColumn("_rank", F.row_number().over(last_first))
    return ranked.filter("_rank = 1").drop("_rank")


def _totals(contributions: DataFrame, rollup: Rollup) -> DataFrame:
    """One row per key and grain; measures are NULL where nothing known is left."""
    total = contributions.groupBy(*rollup.by).agg(*[F.sum(c).alias(c) for c in rollup.sums])
    here = F.col("sessions") > 0
    return total.withColumns(
        {
            name: F.when(here & (F.col(f"n_{name}") > 0), F.col(name))
            for name in rollup.measures
        }
    )


def keep_rollups(records: DataFrame, rollups: UsageRollups, checkpoint: str) -> StreamingQuery:
    """Bring the rollups up to date with what has arrived, then stop."""
    return (
        current_images(records)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(rollups.absorb)
        .trigger(availableNow=True)
        .start()
    )
