"""Latest version per record while files arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mastline.operators.joins import union_all
from mastline.operators.versions import latest_versions
from mastline.schemas import XDR
from mastline.sources.store import CommitLog, KeyedTable


class SessionsTable(KeyedTable):
    """Images of records in any order of arrival; ``read`` takes the latest version of each.

    A late replay of an old version is an image like any other. So a stream need not know
    what came before: what it costs grows with the arriving rows, not with all ids.
    """

    def read(self) -> DataFrame:
        bases = [c.version for c in self._commits("base")]
        since = max(bases, default=-1)
        newer = [c.version for c in self._commits("changes") if c.version > since]
        images = []
        if bases:
            images.append(self.spark.read.schema(self.schema).parquet(self._folder("base", since)))
        if newer:
            images.append(self.changes(newer).select(*self.columns))
        if not images:
            return self.spark.createDataFrame([], self.schema)
        return latest_versions(union_all(images)) if newer else images[0]


def sessions_table(spark: SparkSession, path: str) -> SessionsTable:
    return SessionsTable(f"{path}/sessions", ["xdr_id"], XDR, CommitLog(spark, f"{path}/commits"))


def keep_latest(
    records: DataFrame, table: SessionsTable, checkpoint: str
) -> StreamingQuery:
    """Bring the table of sessions up to date with what has arrived, then stop.

    Each micro-batch writes the latest version of the records in it, under its own number; a
    replayed one changes nothing. There is no watermark and no state: a correction may come
    at any time.
    """

    def absorb(rows: DataFrame, batch: int) -> None:
        if not table.has(batch):
            table.upsert(latest_versions(rows.select(*XDR.names)), batch)
            table.log.write()

    return (
        records.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(absorb)
        .trigger(availableNow=True)
        .start()
    )
