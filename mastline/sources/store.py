"""Published tables: whole snapshots, and keyed tables kept as a base plus changed rows.

Plain Parquet has no row updates, and overwriting a folder that a running job reads loses
data. So nothing is ever overwritten in place: every version has its own folder, and a
version exists once its row is in the commit log.
"""

import datetime as dt
import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass, fields

import pyarrow as pa
from pyspark.sql import (
    Column,
    DataFrame,
    Observation,
    SparkSession,
    Window,
    functions as F,
    types as T,
)

from mastline.operators.joins import drop_keys, keep_keys, sorted_if_many, union_all

_REMOVED, _EXISTED, _VERSION = "_removed", "_existed", "_version"
_FLAGS = [_REMOVED, _EXISTED]


def publish(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write a table and read it back: 'error' creates, 'append' adds."""
    if mode == "overwrite":
        raise ValueError("replace a table through Snapshots, never in place")
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows of a page in a clustered table: a read of one key takes in little more
PAGE_ROWS = 500
_PAGE_OPTION = "parquet.page.row.count.limit"


def publish_clustered(df: DataFrame, path: str, key: str) -> DataFrame:
    """Publish a table in the order of ``key``, so that reads of a few keys skip the rest.

    Files hold ranges of the key in order; a key that most rows share spreads over many files.
    """
    # dealt by ranges, not in equal shares of hashed keys; the row's number splits a hot key
    dealt = df.repartitionByRange(key, F.monotonically_increasing_id()).sortWithinPartitions(key)
    dealt.write.option(_PAGE_OPTION, PAGE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_bounds(keys: DataFrame, key: str, parts: int) -> list[int]:
    """Values that cut a column of unique numbers into about equal parts."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx(key, shares, 100 * parts)).first()[0]
    return sorted(set(found or []))


def in_ranges(df: DataFrame, key: str, bounds: Sequence[int]) -> DataFrame:
    """Rows dealt by the ranges that ``bounds`` cut a unique key into, in order inside each.

    A NULL key goes to the first range.
    """
    reached = lambda found: F.size(F.filter(found, lambda bound: bound <= F.col(key)))
    longs = lambda values: F.array(*(F.lit(b).cast("bigint") for b in values))
    # two steps of about the root of their number, instead of a look at every bound
    size = math.isqrt(len(bounds)) + 1
    groups = [bounds[at : at + size] for at in range(0, len(bounds), size)]
    part = F.lit(0)
    if groups:
        group = reached(longs(g[0] for g in groups))
        inside = reached(F.element_at(F.array(*(longs(g) for g in groups)), group))
        part = F.when(group > 0, (group - 1) * size + inside).otherwise(0)
    return df.repartitionById(len(bounds) + 1, part.cast("int")).sortWithinPartitions(key)


def consume(df: DataFrame) -> None:
    """Run a micro-batch without keeping it: its state is only saved if it is read to the end."""
    df.write.format("noop").mode("overwrite").save()


def write_counted(
    df: DataFrame, path: str, page_rows: int | None = None, **counts: Column
) -> dict[str, int]:
    """Write a version folder and return counts taken while writing, without another job."""
    seen = Observation()
    observed = df.observe(
        seen, *[F.coalesce(value, F.lit(0)).alias(name) for name, value in counts.items()]
    )
    writer = observed.write.mode("overwrite")
    (writer.option(_PAGE_OPTION, page_rows) if page_rows else writer).parquet(path)
    return {name: int(value) for name, value in seen.get.items()}


@dataclass(frozen=True)
class Commit:
    """One table brought to one version. ``kind`` says what was written; 'none' is nothing."""

    version: int
    table_name: str
    kind: str
    refresh_mode: str
    affected_keys: int
    rows_inserted: int
    rows_deleted: int
    started_at: dt.datetime
    finished_at: dt.datetime


_ARROW = {
    "version": pa.int64(),
    "table_name": pa.string(),
    "kind": pa.string(),
    "refresh_mode": pa.string(),
    "affected_keys": pa.int64(),
    "rows_inserted": pa.int64(),
    "rows_deleted": pa.int64(),
    "started_at": pa.timestamp("us"),
    "finished_at": pa.timestamp("us"),
}


class CommitLog:
    """The commits of one or more tables. They count for other readers once written."""

    SCHEMA = (
        "version bigint, table_name string, kind string, refresh_mode string,"
        " affected_keys bigint, rows_inserted bigint, rows_deleted bigint,"
        " started_at timestamp_ntz, finished_at timestamp_ntz"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._written: list[Commit] | None = None
        self._pending: list[Commit] = []

    def commits(self) -> list[Commit]:
        """Every commit, one small row per table and refresh, and those about to be written."""
        if self._written is None:
            # an empty log comes into being unless there is one
            self._append([], "ignore")
            rows = self.table().distinct().collect()
            self._written = sorted((Commit(*row) for row in rows), key=lambda c: c.version)
        return [*self._written, *self._pending]

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def add(self, commit: Commit) -> None:
        self.commits()
        self._pending.append(commit)

    def write(self) -> None:
        """Make the pending commits visible, all at once."""
        if self._pending:
            self._append(self._pending, "append")
            self._written, self._pending = self.commits(), []

    def _append(self, commits: Sequence[Commit], mode: str) -> None:
        names = [field.name for field in fields(Commit)]
        columns = list(zip(*map(astuple, commits))) or [[] for _ in names]
        rows = pa.table({name: pa.array(values, _ARROW[name]) for name, values in zip(names, columns)})
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode(mode).parquet(self.path)

    def next_version(self) -> int:
        return max((c.version for c in self.commits()), default=-1) + 1


class Snapshots:
    """A table replaced as a whole: readers keep the version they started with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, f"{path}/commits")

    def _folder(self, version: int) -> str:
        return f"{self.path}/base/{_VERSION}={version}"

    def replace(self, df: DataFrame) -> None:
        version, started = self.log.next_version(), now()
        counts = write_counted(df, self._folder(version), rows=F.count(F.lit(1)))
        self.log.add(
            Commit(version, self.path, "base", "FULL", 0, counts["rows"], 0, started, now())
        )
        self.log.write()

    def read(self) -> DataFrame:
        versions = [c.version for c in self.log.commits()]
        if not versions:
            raise ValueError(f"nothing published in {self.path}")
        return self.spark.read.parquet(self._folder(max(versions)))


class KeyedTable:
    """A table with one row per key. A refresh writes the changed rows only.

    ``read`` takes the base without the changed keys, plus the latest image of each
    changed key; ``compact`` folds the changes into a new base. Commits go to the log of
    the table's owner, who writes them.
    """

    def __init__(
        self,
        path: str,
        key: Sequence[str],
        schema: T.StructType | str,
        log: CommitLog,
    ):
        self.spark, self.path, self.key, self.log = log.spark, path, list(key), log
        self.name = path.rsplit("/", 1)[-1]
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def _commits(self, *kinds: str) -> list[Commit]:
        return [c for c in self.log.commits() if c.table_name == self.name and c.kind in kinds]

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/{_VERSION}={version}"

    def has(self, version: int) -> bool:
        return any(c.version == version for c in self._commits("base", "changes"))

    def size(self) -> int:
        """Number of rows, from the commits. Only tables kept by create and apply know it."""
        return sum(c.rows_inserted - c.rows_deleted for c in self._commits("base", "changes"))

    def create(
        self, df: DataFrame, version: int, affected: int = 0, bounds: Sequence[int] | None = None
    ) -> Commit:
        """Write the whole table as a new base; ``bounds`` of its one key cluster it."""
        started, before = now(), self.size()
        rows = self._typed(df)
        if bounds is not None:
            rows = in_ranges(rows, self.key[0], bounds)
        counts = write_counted(
            rows,
            self._folder("base", version),
            page_rows=None if bounds is None else PAGE_ROWS,
            rows=F.count(F.lit(1)),
        )
        return self._done(version, "base", "FULL", affected, counts["rows"], before, started)

    def apply(
        self,
        rows: DataFrame,
        keys: DataFrame,
        version: int,
        affected: int = 0,
        only: Column | None = None,
    ) -> Commit:
        """Make ``rows`` the only rows of ``keys``.

        Rows that come out as they were are not written, so later tables do not see them.
        ``only`` says the same as ``keys`` as a condition that a scan can be cut down by;
        ``affected`` is the number of keys.
        """
        started = now()
        if only is None:
            before = keep_keys(self.read(), sorted_if_many(keys, affected), self.key)
        else:
            before = self.read().filter(only)
        counts = write_counted(
            self._difference(self._typed(rows), before),
            self._folder("changes", version),
            inserted=F.count_if(~F.col(_REMOVED)),
            deleted=F.count_if(F.col(_EXISTED)),
        )
        return self._done(
            version,
            "changes",
            "INCREMENTAL",
            affected,
            counts["inserted"],
            counts["deleted"],
            started,
        )

    def upsert(self, rows: DataFrame, version: int, removed: Column | None = None) -> Commit:
        """Make ``rows`` the current image of their keys without reading the table.

        ``removed`` marks keys that are gone. How many rows were there before is unknown.
        """
        started = now()
        gone = F.lit(False) if removed is None else removed
        marked = rows.withColumns({_REMOVED: gone, _EXISTED: F.lit(None).cast("boolean")})
        counts = write_counted(
            self._typed(marked, *_FLAGS),
            self._folder("changes", version),
            inserted=F.count_if(~F.col(_REMOVED)),
            removed=F.count_if(F.col(_REMOVED)),
        )
        n = counts["inserted"] + counts["removed"]
        return self._done(
            version, "changes", "INCREMENTAL", n, counts["inserted"], counts["removed"], started
        )

    def idle(self, version: int) -> Commit:
        """Nothing to do in this version."""
        return self._done(version, "none", "NO_DATA", 0, 0, 0, now())

    def _done(
        self,
        version: int,
        kind: str,
        mode: str,
        affected: int,
        inserted: int,
        deleted: int,
        started: dt.datetime,
    ) -> Commit:
        commit = Commit(
            version, self.name, kind, mode, affected, inserted, deleted, started, now()
        )
        self.log.add(commit)
        return commit

    def _typed(self, df: DataFrame, *more: str) -> DataFrame:
        """The declared columns in their declared types, as every version is read back."""
        declared = [
            f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in self.schema.fields
        ]
        return df.selectExpr(*declared, *more)

    def _difference(self, rows: DataFrame, before: DataFrame) -> DataFrame:
        values = [name for name in self.columns if name not in self.key]
        images = union_all(
            [
                side.select(*self.key, F.struct(*values).alias(here), F.lit(None).alias(there))
                for side, here, there in ((rows, "_n", "_o"), (before, "_o", "_n"))
            ]
        )
        # keys are unique on both sides, so each group holds at most two rows
        paired = images.groupBy(*self.key).agg(
            F.first("_n", ignorenulls=True).alias("_n"),
            F.first("_o", ignorenulls=True).alias("_o"),
        )
        return paired.filter("NOT _n <=> _o").selectExpr(
            *self.key,
            *[f"_n.{name}" for name in values],
            f"_n IS NULL AS {_REMOVED}",
            f"_o IS NOT NULL AS {_EXISTED}",
        )

    def changes(self, versions: Sequence[int]) -> DataFrame:
        """Rows written by some refreshes, with whether they are gone and the version."""
        more = [T.StructField(name, T.BooleanType()) for name in _FLAGS]
        more.append(T.StructField(_VERSION, T.LongType()))
        return (
            self.spark.read.schema(T.StructType([*self.schema.fields, *more]))
            .parquet(f"{self.path}/changes")
            .filter(F.col(_VERSION).isin(list(versions)))
        )

    def read(self) -> DataFrame:
        bases = [c.version for c in self._commits("base")]
        since = max(bases, default=-1)
        later = [c for c in self._commits("changes") if c.version > since]
        newer = [c.version for c in later]
        if bases:
            base = self.spark.read.schema(self.schema).parquet(self._folder("base", since))
        elif not newer:
            return self.spark.createDataFrame([], self.schema)
        if not newer:
            return base
        changes = self.changes(newer)
        if len(newer) > 1:
            latest_first = Window.partitionBy(*self.key).orderBy(F.col(_VERSION).desc())
            changes = (
                changes.withColumn("_rank", F.row_number().over(latest_first))
                .filter("_rank = 1")
                .drop("_rank")
            )
        current = changes.filter(~F.col(_REMOVED)).select(*self.columns)
        if not bases:
            return current
        replaced = sorted_if_many(changes, sum(c.rows_inserted + c.rows_deleted for c in later))
        return drop_keys(base, replaced, self.key).unionByName(current)

    def compact(self) -> None:
        """Fold the changes into a new base of the same version, if there are any."""
        changed = max((c.version for c in self._commits("changes")), default=-1)
        if changed > max((c.version for c in self._commits("base")), default=-1):
            self.create(self.read(), changed)
            self.log.write()


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
