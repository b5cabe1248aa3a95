"""Latest version per record."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mastline.functions.usage import hour_of, hours_between
from mastline.schemas import XDR

_ORDER = ["record_version", "ingest_ts", "batch_id"]


def fingerprint(columns: Sequence[str]) -> Column:
    """Settles ties between different rows of one version, the same way on every run."""
    return F.xxhash64(*columns)


def version_order() -> Column:
    """The order of versions as one value, for keeping the greatest; NULL is the least."""
    return F.struct(*_ORDER, fingerprint(XDR.names))


def latest_versions(
    raw: DataFrame, key: str = "xdr_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: highest version, then latest ingest, then latest batch.

    Different rows that agree in all three are settled by a fingerprint of the declared
    record, whatever else ``raw`` has and whichever ``columns`` are asked for: every reader
    and every stream picks the same row. The fingerprint is taken before the shuffle, so
    only the wanted columns travel. The rank limit lets Spark drop superseded rows before
    it, so a key repeated across a third of the input sends one row per task.
    """
    wanted = raw.columns if columns is None else list(dict.fromkeys([key, *_ORDER, *columns]))
    latest_first = Window.partitionBy(key).orderBy(
        *[F.col(name).desc() for name in _ORDER], F.col("_tie").desc()
    )
    return (
        raw.withColumn("_tie", fingerprint(XDR.names))
        .select(*wanted, "_tie")
        .withColumn("_rank", F.row_number().over(latest_first))
        .filter("_rank = 1")
        .drop("_rank", "_tie")
    )


def with_event_time(latest: DataFrame) -> DataFrame:
    """Add the event hour and how many complete hours the record was late."""
    return latest.withColumns(
        {
            "event_hour": hour_of(F.col("event_ts")),
            "lateness_h": hours_between(F.col("event_ts"), F.col("ingest_ts")),
        }
    )


def sessions(raw: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Current usage records. ``columns`` limits the shuffle to what one rollup needs."""
    if columns is not None:
        columns = ["event_ts", *columns]
    return with_event_time(latest_versions(raw, columns=columns))
