"""Joins that stay balanced when one key holds a large share of the rows."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from mastline.functions.usage import hour_of

FANOUT = 8
#: rows of a lookup, where their number is known, that Spark may still broadcast
BROADCAST_ROWS = 10_000
_SALT, _KEY = "_salt", "_boxed_key"


def sorted_if_many(lookup: DataFrame, n: int) -> DataFrame:
    """A lookup of ``n`` rows that, if they are many, is sorted beside the other side.

    Spark's own size check goes by compressed files: keys take many times that in the driver.
    """
    return lookup.hint("merge") if n > BROADCAST_ROWS else lookup


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    fanout: int = FANOUT,
    n: int = 0,
) -> DataFrame:
    """Join many rows to a narrow lookup whose keys may be very unevenly used.

    ``spread`` names columns that differ between the facts of one key. Their hash picks one
    of ``fanout`` salts, so the rows of a hot key land in that many tasks, each of which
    adaptive execution can split further; the lookup is repeated once per salt. The salt
    depends on the row alone: filters pass through it, and a lost task makes it again.
    Valid for joins that keep or filter the facts. NULL keys match nothing. No broadcast is
    forced: Spark broadcasts the lookup only where its own size check allows. The repeats come
    from a join, whose size that check knows; an exploded array would pass for one copy.
    ``n`` is the number of lookup rows, if known: many are never broadcast. An inner join could
    broadcast the facts, if their file is small: its sides are always sorted.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat lookup rows once per salt")
    salted = facts.withColumn(_SALT, F.pmod(F.xxhash64(*spread), F.lit(fanout)).cast("int"))
    salts = lookup.sparkSession.range(0, fanout, 1, 1).select(F.col("id").cast("int").alias(_SALT))
    repeated = lookup.crossJoin(salts)
    repeated = repeated.hint("merge") if how == "inner" else sorted_if_many(repeated, n * fanout)
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)


def rows_of(
    df: DataFrame, keys: DataFrame, key: str, spread: Sequence[str], n: int = 0
) -> DataFrame:
    """Rows whose key is in a (small or distinct) key set, even if one key has most rows.

    A NULL key is a key like any other, as in ``keep_keys``: structs compare that way.
    ``n`` is the number of keys, if known: many are never broadcast.
    """
    boxed = F.struct(F.col(key).alias("k")).alias(_KEY)
    found = spread_join(df.select("*", boxed), keys.select(boxed), [_KEY], "left_semi", spread, n=n)
    return found.drop(_KEY)


def keep_keys(
    df: DataFrame, keys: DataFrame, key: Sequence[str], plain: Sequence[str] = ()
) -> DataFrame:
    """Rows whose key is in ``keys``; a NULL key is a key like any other.

    ``plain`` columns are never NULL: compared directly, they can prune partitions.
    """
    return _matching(df, keys, key, plain, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return _matching(df, keys, key, (), "left_anti")


def _matching(
    df: DataFrame, keys: DataFrame, key: Sequence[str], plain: Sequence[str], how: str
) -> DataFrame:
    left, right = df.alias("l"), keys.select(*key, *plain).alias("r")
    same = [f"l.{name} <=> r.{name}" for name in key] + [f"l.{name} = r.{name}" for name in plain]
    return left.join(right, F.expr(" AND ".join(same)), how)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_after(
    rows: DataFrame, marks: DataFrame, at: str, mark_at: str, by: Sequence[str] = ()
) -> DataFrame:
    """Each row with the first mark at or after its time, among the marks of the same ``by``.

    Of marks at one time the smallest in the order of their other columns counts. Rows
    without a later mark, or without a time, get NULLs; marks without a time are left out;
    NULL is a value of ``by`` like any other. Times are zone-less. Mark columns must not
    share names with those of the rows, except for ``by``.

    Not a range join: rows and marks are united and run through hour by hour, latest first,
    and an hour without a mark of its own takes the first one of the next hour that has one.
    A task holds one hour of one ``by``, and one line per hour to look further ahead.
    """
    others = [name for name in marks.columns if name not in (*by, mark_at)]
    clashing = {mark_at, *others} & set(rows.columns)
    if clashing:
        raise ValueError(f"columns of both sides: {sorted(clashing)}")
    keys = F.struct(F.lit(0).alias("_"), *by).alias("_by")
    row, mark = F.struct(*rows.columns), F.struct(mark_at, *others)
    united = rows.select(keys, F.col(at).alias("_t"), row.alias("_row")).unionByName(
        marks.filter(F.col(mark_at).isNotNull()).select(
            keys, F.col(mark_at).alias("_t"), mark.alias("_mark")
        ),
        allowMissingColumns=True,
    )
    united = united.withColumn("_hour", hour_of(F.col("_t")))
    # latest first, so that the running minimum is the nearest mark ahead
    in_hour = Window.partitionBy("_by", "_hour").orderBy(F.desc("_t"))
    later = Window.partitionBy("_by").orderBy(F.desc("_hour")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    hours = (
        united.groupBy("_by", "_hour")
        .agg(F.min("_mark").alias("_first"))
        .select("_by", "_hour", F.min("_first").over(later).alias("_later"))
    )
    near = united.withColumn("_near", F.min("_mark").over(in_hour)).filter("_row IS NOT NULL")
    found = near.join(hours, ["_by", "_hour"], "left").withColumn(
        "_mark", F.coalesce("_near", "_later")
    )
    return found.select("_row.*", "_mark.*")
