"""Base tables read as they are declared, and what differs from the declaration."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mastline.operators.joins import union_all
from mastline.schemas import BASE, KEYS

_REPORT = "table_name string, column_name string, problem string, declared string, found string, rows bigint"


def schema_problems(found: T.StructType, name: str) -> list[tuple]:
    """Columns that are missing, of another type, or not declared, in the order declared."""
    kinds = {field.name: field.dataType.simpleString() for field in found}
    problems = []
    for field in BASE[name]:
        declared, actual = field.dataType.simpleString(), kinds.pop(field.name, None)
        if actual is None:
            problems.append((name, field.name, "missing", declared, None))
        elif actual != declared:
            problems.append((name, field.name, "type", declared, actual))
    return problems + [(name, column, "extra", None, kind) for column, kind in kinds.items()]


def _opened(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # files of one table may have been written with different columns
    return spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}")


def read_base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table with exactly the declared columns.

    A missing column or another type raises an error instead of reading NULLs or casting;
    columns that are not declared are left out. Rows are not looked at, see ``drift``.
    """
    df = _opened(spark, folder, name)
    wrong = [p for p in schema_problems(df.schema, name) if p[2] != "extra"]
    if wrong:
        text = "; ".join(f"{c}: {kind}, declared {d}, found {f}" for _, c, kind, d, f in wrong)
        raise ValueError(f"{name} is not as declared: {text}")
    return df.select(*BASE[name].names)


def drift(spark: SparkSession, folder: str, names: Iterable[str] = tuple(BASE)) -> DataFrame:
    """Every difference from the declaration, one row each; an empty result means none.

    ``rows`` counts rows with a NULL key, and rows that share their key with another row;
    it is NULL for problems of a whole column. A table without files raises Spark's error.
    """
    found = []
    for name in names:
        df = _opened(spark, folder, name)
        problems = [(*problem, None) for problem in schema_problems(df.schema, name)]
        found.append(spark.createDataFrame(problems, _REPORT))
        missing = {column for _, column, kind, *_ in problems if kind == "missing"}
        if not missing.intersection(KEYS[name]):
            found.append(_key_problems(df, name))
    return union_all(found)


def _key_problems(df: DataFrame, name: str) -> DataFrame:
    keys = KEYS[name]
    unknown = " OR ".join(f"{key} IS NULL" for key in keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.sum(F.expr(f"IF({unknown}, n, 0)")).alias("null_key"),
        F.sum(F.expr(f"IF(NOT ({unknown}) AND n > 1, n, 0)")).alias("repeated_key"),
    )
    return totals.unpivot([], ["null_key", "repeated_key"], "problem", "rows").select(
        F.lit(name).alias("table_name"),
        F.lit(",".join(keys)).alias("column_name"),
        "problem",
        F.lit(None).cast("string").alias("declared"),
        F.lit(None).cast("string").alias("found"),
        "rows",
    ).filter("rows > 0")
