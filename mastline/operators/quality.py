"""Checks that two tables agree, that keys are unique, that references resolve."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from mastline.operators.joins import union_all


def _both(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every distinct row of either side with how often each side has it.

    One aggregation serves both directions, and copies collapse before the shuffle.
    """
    sides = [
        a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")),
        b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")),
    ]
    return union_all(sides).groupBy(*columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))


def verify_equal(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of each side that the other lacks; equal sets give 0 and 0.

    A set difference does not see duplicates: use it together with verify_counts.
    """
    rows = _both(a, b, columns)
    count = lambda rule: F.coalesce(F.sum(F.when(F.expr(rule), 1).otherwise(0)), F.lit(0))
    return rows.agg(
        count("_a > 0 AND _b = 0").alias("mismatches"),
        count("_a = 0 AND _b > 0").alias("reverse_mismatches"),
    )


def snapshot_diff(new: DataFrame, old: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that appeared or went between two snapshots, with the number of copies."""
    change = F.col("_a") - F.col("_b")
    return (
        _both(new, old, columns)
        .filter(change != 0)
        .select(
            F.when(change > 0, "inserted").otherwise("deleted").alias("change_type"),
            *columns,
            F.abs(change).alias("copies"),
        )
    )


def verify_counts(rows: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Rows, distinct keys and the number expected, side by side; all three must agree."""
    unknown = F.lit(None).cast("long")
    parts = [
        rows.agg(
            F.count("*").alias("customers"),
            F.count_distinct(key).alias("distinct_customers"),
            unknown.alias("expected_customers"),
        ),
        expected.agg(
            unknown.alias("customers"),
            unknown.alias("distinct_customers"),
            F.count("*").alias("expected_customers"),
        ),
    ]
    names = ["customers", "distinct_customers", "expected_customers"]
    return union_all(parts).agg(*[F.max(name).alias(name) for name in names])


def check_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def check_reference(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child values with no parent and their row counts; NULL refers to nothing.

    Children are counted per value first, so a value shared by many rows joins once.
    """
    used = (
        child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    )
    return used.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def replayed_rows(raw: DataFrame) -> DataFrame:
    """Record versions loaded more than once from the same batch."""
    return check_key(raw, ["xdr_id", "record_version", "batch_id"])
