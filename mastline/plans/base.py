"""The base tables that feed the tags, and changes to them."""

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import ClassVar

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class BaseTables:
    """One consistent state of the six tables. A change gives a new state."""

    NAMES: ClassVar[tuple[str, ...]] = (
        "customer",
        "billing_account",
        "product_offering",
        "product_inventory",
        "customer_bill",
        "trouble_ticket",
    )

    customer: DataFrame
    billing_account: DataFrame
    product_offering: DataFrame
    product_inventory: DataFrame
    customer_bill: DataFrame
    trouble_ticket: DataFrame

    def with_table(self, name: str, df: DataFrame) -> "BaseTables":
        return replace(self, **{name: df})


@dataclass(frozen=True)
class Change:
    """Rows of one table as they were and as they are now (None: no such rows)."""

    table: str
    before: DataFrame | None = None
    after: DataFrame | None = None

    def images(self) -> Sequence[DataFrame]:
        return [image for image in (self.before, self.after) if image is not None]
