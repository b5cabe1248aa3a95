"""The source changes the tags are tested with. Each gives the new state and its changes."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from mastline.operators.changes import delete, update
from mastline.operators.joins import rows_of
from mastline.plans.base import BaseTables, Change

Outcome = tuple[BaseTables, list[Change]]
_KEY = "customer_id"


def noop(base: BaseTables, keys: DataFrame) -> Outcome:
    return base, []


def delta(base: BaseTables, keys: DataFrame) -> Outcome:
    """Toggle consent (unknown stays unknown) and raise charges by one."""
    toggled, consent = update(
        base, "customer", {"marketing_consent": ~F.col("marketing_consent")}, F.lit(True), keys, _KEY
    )
    raised, charge = update(
        toggled,
        "product_inventory",
        {"monthly_charge": F.col("monthly_charge") + 1},
        F.lit(True),
        keys,
        _KEY,
    )
    return raised, [consent, charge]


def payment(base: BaseTables, keys: DataFrame) -> Outcome:
    """Clear what is outstanding on the accounts of the selected customers."""
    accounts = rows_of(base.billing_account, keys, _KEY, spread=["account_id"])
    paid, change = update(
        base,
        "customer_bill",
        {"outstanding_amount": F.lit(0)},
        F.col("outstanding_amount") > 0,
        accounts,
        "account_id",
    )
    return paid, [change]


def care_close(base: BaseTables, keys: DataFrame) -> Outcome:
    closed, change = update(
        base, "trouble_ticket", {"status": F.lit("closed")}, F.col("status") == "open", keys, _KEY
    )
    return closed, [change]


def terminate(base: BaseTables, keys: DataFrame) -> Outcome:
    ended, change = update(
        base,
        "product_inventory",
        {"status": F.lit("terminated")},
        F.col("status") == "active",
        keys,
        _KEY,
    )
    return ended, [change]


def aging(base: BaseTables, as_of: str) -> Outcome:
    """Move the date flags on by one day. A second run for the same day changes nothing."""
    today = F.to_date(F.lit(as_of))
    enters = (F.col("contract_end") == F.date_add(today, 31)) & ~F.col("renewal_due")
    leaves = (F.col("contract_end") == today) & F.col("renewal_due")
    renewed, renewal = update(
        base, "product_inventory", {"renewal_due": ~F.col("renewal_due")}, enters | leaves
    )
    aged, overdue = update(
        renewed,
        "customer_bill",
        {"overdue_30": F.lit(True)},
        (F.col("due_date") == F.date_sub(today, 29)) & ~F.col("overdue_30"),
    )
    return aged, [renewal, overdue]


def catalog_fanout(base: BaseTables, where: str = "family = 'mobile'") -> Outcome:
    """Move catalogue rows to broadband: few rows, many customers."""
    moved, change = update(base, "product_offering", {"family": F.lit("broadband")}, F.expr(where))
    return moved, [change]


def delete_customer(base: BaseTables, keys: DataFrame) -> Outcome:
    left, change = delete(base, "customer", keys, _KEY)
    return left, [change]


BY_KEYS: dict[str, Callable[[BaseTables, DataFrame], Outcome]] = {
    "noop": noop,
    "delta": delta,
    "payment": payment,
    "care_close": care_close,
    "terminate": terminate,
    "delete_customer": delete_customer,
}


def run(name: str, base: BaseTables, keys: DataFrame, as_of: str) -> Outcome:
    """A change case by name."""
    if name == "aging":
        return aging(base, as_of)
    if name == "catalog_fanout":
        return catalog_fanout(base)
    return BY_KEYS[name](base, keys)
