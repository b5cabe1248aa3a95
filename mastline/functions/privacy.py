"""Masking of identifiers and redaction of known values."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

REDACTED = "[REDACTED]"
READER = "spark.mastline.reader"  # session setting: the role that the session reads as
CLEAR = None  # in a reader's policy: the column may be shown
_SHORTEST_SECRET = 4


def masked(value: Column, keep: int = 0) -> Column:
    """Letters become X or x, digits become #; the first ``keep`` characters stay."""
    hidden = F.mask(
        F.substring(value, keep + 1, 2**31 - 1), F.lit("X"), F.lit("x"), F.lit("#")
    )
    return F.concat(F.substring(value, 1, keep), hidden) if keep else hidden


def mask_columns(df: DataFrame, policy: Mapping[str, int]) -> DataFrame:
    """The reader's projection: ``policy`` maps a column to the prefix it may show."""
    unknown = set(policy) - set(df.columns)
    if unknown:
        raise ValueError(f"masking policy names unknown columns: {sorted(unknown)}")
    return df.withColumns({name: masked(F.col(name), keep) for name, keep in policy.items()})


def reader_view(df: DataFrame, policies: Mapping[str, Mapping[str, int | None]]) -> DataFrame:
    """The table as the reader named in the session's ``READER`` setting may see it.

    ``policies`` maps each reader to its columns and the prefix shown of each, or ``CLEAR``.
    A column that any policy names is protected: a reader whose policy leaves it out sees it
    wholly masked. A session without a reader, or with one that has no policy, gets an error
    and never clear values; so do protected columns that are not text, or not in the table.
    The choice is made when the view is taken: a filter on a masked column compares masks.
    """
    reader = df.sparkSession.conf.get(READER, "")
    if reader not in policies:
        raise PermissionError(f"no masking policy for reader {reader!r}, see {READER}")
    kinds = dict(df.dtypes)
    protected = sorted({name for policy in policies.values() for name in policy})
    wrong = [name for name in protected if kinds.get(name) != "string"]
    if wrong:
        raise ValueError(f"protected columns must be text columns of the table: {wrong}")
    policy = {name: policies[reader].get(name, 0) for name in protected}
    return mask_columns(df, {name: keep for name, keep in policy.items() if keep is not CLEAR})


def redacted(text: Column, values: Iterable[str]) -> Column:
    """Replace each value, the longest first, so that no part of one survives another.

    Values of fewer than four characters would blot out ordinary text and are left alone.
    """
    secrets = {v for v in values if len(v) >= _SHORTEST_SECRET}
    for secret in sorted(secrets, key=lambda v: (-len(v), v)):
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return text


def redact_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    return df.withColumn(column, redacted(F.col(column), values))
