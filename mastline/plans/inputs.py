"""What the derived tables were last computed from, to notice inputs that were replaced.

An input is known by its files and by its content: the number of rows and the sum of their
hashes, which does not depend on their order. A declared change brings the content up to date
from the changed rows alone. Only an input that looks different is read as a whole: if its
content is still the known one, it was merely written anew.
"""

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mastline.operators.joins import union_all
from mastline.plans.base import BaseTables, Change

_SUM = "decimal(38,0)"


@dataclass(frozen=True)
class Content:
    """Number of rows and sum of row hashes."""

    rows: int
    digest: int

    def __add__(self, other: "Content") -> "Content":
        return Content(self.rows + other.rows, self.digest + other.digest)


@dataclass(frozen=True)
class Identity:
    files: str
    content: Content


def files_of(df: DataFrame) -> str:
    """The files a table is read from and how, without reading them."""
    text = "\n".join([*sorted(df.inputFiles()), str(df.semanticHash())])
    return hashlib.sha256(text.encode()).hexdigest()


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns by name; NULL differs from every value."""
    names = sorted(df.columns)
    return F.xxhash64(*names, *(F.col(n).isNull() for n in names)).cast(_SUM)


def content_of(df: DataFrame) -> Content:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_hash(df)).alias("s")).first()
    return Content(row["n"], int(row["s"] or 0))


def changed_content(changes: Sequence[Change]) -> dict[str, Content]:
    """What declared changes add to the content of each table, in one job over their rows."""
    images = [
        image.select(
            F.lit(change.table).alias("name"),
            F.lit(sign).alias("sign"),
            (_row_hash(image) * sign).cast(_SUM).alias("hash"),
        )
        for change in changes
        for image, sign in ((change.before, -1), (change.after, 1))
        if image is not None
    ]
    if not images:
        return {}
    sums = union_all(images).groupBy("name").agg(F.sum("sign").alias("n"), F.sum("hash").alias("s"))
    found = {change.table: Content(0, 0) for change in changes}
    return found | {r["name"]: Content(r["n"], int(r["s"])) for r in sums.collect()}


class InputLog:
    """The identity of every input, one folder for each version of the derived tables."""

    _SCHEMA = "name string, files string, rows bigint, digest string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: int) -> dict[str, Identity]:
        rows = self.spark.read.schema(self._SCHEMA).parquet(f"{self.path}/{version}").collect()
        return {r["name"]: Identity(r["files"], Content(r["rows"], int(r["digest"]))) for r in rows}

    def write(self, version: int, inputs: Mapping[str, Identity]) -> None:
        rows = [(n, i.files, i.content.rows, str(i.content.digest)) for n, i in inputs.items()]
        df = self.spark.createDataFrame(rows, self._SCHEMA).coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.path}/{version}")


def identities(base: BaseTables) -> dict[str, Identity]:
    """The inputs as they are, read as a whole."""
    return {
        name: Identity(files_of(df), content_of(df))
        for name, df in ((n, getattr(base, n)) for n in base.NAMES)
    }


def compared(
    known: Mapping[str, Identity], old: BaseTables, new: BaseTables, changes: Sequence[Change]
) -> tuple[dict[str, Identity], set[str]]:
    """The identities after the changes, and the inputs that were replaced.

    Replaced is an input whose old state is not the one known, or whose new state differs
    without any change declared for it.
    """
    declared = changed_content(changes)
    after, replaced = {}, set()
    for name in new.NAMES:
        before, now = getattr(old, name), getattr(new, name)
        found = known[name].content
        if files_of(before) != known[name].files:
            found = content_of(before)
        same = found == known[name].content
        files = files_of(now)
        if name in declared:
            found = found + declared[name]
        elif files != files_of(before):
            content = content_of(now)
            same, found = same and content == found, content
        if not same:
            replaced.add(name)
        after[name] = Identity(files, found)
    return after, replaced
