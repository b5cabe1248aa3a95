"""Source changes as new snapshots, and what a change touches."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mastline.functions.usage import rated_amount
from mastline.operators.joins import rows_of, spread_join, union_all
from mastline.plans.base import BaseTables, Change
from mastline.schemas import FLAGS, KEYS

_HIT = "_hit"


def marked(
    df: DataFrame,
    where: Column,
    keys: DataFrame | None = None,
    key: str | None = None,
    spread: Sequence[str] = (),
) -> DataFrame:
    """Add whether a row qualifies: ``where`` holds and, if given, its key is in ``keys``.

    ``spread`` names the columns that tell the rows apart.
    """
    hit = F.coalesce(where, F.lit(False))
    if keys is None:
        return df.withColumn(_HIT, hit)
    wanted = (
        keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_found", F.lit(True))
    )
    if key in spread:  # the rows' own key: no value repeats, and the keys may be as many
        found = df.join(wanted.hint("merge"), key, "left")
    else:
        found = spread_join(df, wanted, [key], "left", spread)
    return found.select(*df.columns, (hit & F.col("_found").isNotNull()).alias(_HIT))


def apply_update(rows: DataFrame, assign: Mapping[str, Column]) -> DataFrame:
    """The whole table after an update of its marked rows. Reads each row once."""
    names = [name for name in rows.columns if name != _HIT]
    kinds = {field.name: field.dataType for field in rows.schema.fields}
    return rows.select(
        *[
            F.when(F.col(_HIT), assign[name].cast(kinds[name])).otherwise(F.col(name)).alias(name)
            if name in assign
            else F.col(name)
            for name in names
        ]
    )


def update_images(rows: DataFrame, assign: Mapping[str, Column], table: str) -> Change:
    """The marked rows before and after the update."""
    hits = rows.filter(_HIT)
    return Change(table, before=hits.drop(_HIT), after=apply_update(hits, assign))


def update(
    base: BaseTables,
    table: str,
    assign: Mapping[str, Column],
    where: Column,
    keys: DataFrame | None = None,
    key: str | None = None,
) -> tuple[BaseTables, Change]:
    """UPDATE table SET assign WHERE where AND key IN keys."""
    rows = marked(getattr(base, table), where, keys, key, spread=KEYS[table])
    changed = base.with_table(table, apply_update(rows, assign))
    return changed, update_images(rows, assign, table)


def delete(
    base: BaseTables, table: str, keys: DataFrame, key: str
) -> tuple[BaseTables, Change]:
    """DELETE FROM table WHERE key IN keys. Children stay behind."""
    rows = marked(getattr(base, table), F.lit(True), keys, key, spread=KEYS[table])
    kept = rows.filter(~F.col(_HIT)).drop(_HIT)
    gone = rows.filter(_HIT).drop(_HIT)
    return base.with_table(table, kept), Change(table, before=gone)


def qualifying_rows(changes: Sequence[Change]) -> DataFrame:
    """How many source rows each change touched, counted on the rows before it."""
    counts = [
        change.before.agg(F.count("*").alias("qualifying_source_rows")).select(
            F.lit(change.table).alias("source_table"), "qualifying_source_rows"
        )
        for change in changes
        if change.before is not None
    ]
    return union_all(counts)


# which feature table a change of a base table reaches
FEATURE_OF = {
    "customer": "customer_features",
    "product_inventory": "subscription_features",
    "product_offering": "subscription_features",
    "customer_bill": "billing_features",
    "billing_account": "billing_features",
    "trouble_ticket": "care_features",
}


def _customers_of(change: Change, states: Sequence[BaseTables]) -> list[DataFrame]:
    """Customer ids behind the changed rows, looked up in the old and the new state."""
    found = []
    for image in change.images():
        if "customer_id" in image.columns:
            found.append(image.select("customer_id"))
        elif change.table == "customer_bill":
            # as many as the bills that changed: sorted beside the accounts, never broadcast
            accounts = image.select("account_id").distinct().hint("merge")
            found += [
                state.billing_account.join(accounts, "account_id", "left_semi").select(
                    "customer_id"
                )
                for state in states
            ]
        elif change.table == "product_offering":
            found += [
                rows_of(
                    state.product_inventory.select("subscription_id", "customer_id", "offering_id"),
                    image,
                    "offering_id",
                    spread=["subscription_id"],
                ).select("customer_id")
                for state in states
            ]
        else:
            raise ValueError(f"no path from {change.table} to customers")
    return found


def _distinct_states(change: Change, old: BaseTables, new: BaseTables) -> list[BaseTables]:
    """Both states where the lookup table itself changed, else only one."""
    lookup = {"customer_bill": "billing_account", "product_offering": "product_inventory"}
    name = lookup.get(change.table)
    if name is None or getattr(old, name) is getattr(new, name):
        return [old]
    return [old, new]


def affected_by_feature(
    changes: Sequence[Change], old: BaseTables, new: BaseTables
) -> dict[str, DataFrame]:
    """Distinct customer ids to recompute, per feature table that reads a changed table.

    Counted on rows before and after: a row that moved touches both customers.
    """
    found: dict[str, list[DataFrame]] = {}
    for change in changes:
        ids = _customers_of(change, _distinct_states(change, old, new))
        found.setdefault(FEATURE_OF[change.table], []).extend(ids)
    return {name: union_all(ids).distinct() for name, ids in found.items() if ids}


def affected_customers(
    changes: Sequence[Change], old: BaseTables, new: BaseTables
) -> DataFrame:
    """Distinct customers whose features or tags a set of changes may alter."""
    return union_all(list(affected_by_feature(changes, old, new).values())).distinct()


def tag_transitions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Flags that switched, customers added and removed. A customer gone switches its set flags.

    Without any customer on either side, added and removed are NULL.
    """
    both = new.alias("n").join(
        old.alias("o"), F.col("n.customer_id") == F.col("o.customer_id"), "full"
    )
    flag = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), F.lit(0))
    switched = sum(
        (F.abs(flag("n", name) - flag("o", name)) for name in FLAGS), start=F.lit(0)
    )
    missing = lambda side: F.sum(F.when(F.col(f"{side}.customer_id").isNull(), 1).otherwise(0))
    return both.agg(
        F.coalesce(F.sum(switched), F.lit(0)).alias("flag_transitions"),
        missing("o").alias("added_customers"),
        missing("n").alias("removed_customers"),
    )


def with_lifecycle_flags(base: BaseTables, as_of: str) -> BaseTables:
    """Both date flags worked out for a day: renewal 0 to 30 days ahead, 30 or more overdue."""
    today = F.to_date(F.lit(as_of))
    return base.with_table(
        "product_inventory",
        base.product_inventory.withColumn(
            "renewal_due", F.datediff("contract_end", today).between(0, 30)
        ),
    ).with_table(
        "customer_bill",
        base.customer_bill.withColumn("overdue_30", F.datediff(today, "due_date") >= 30),
    )


def rate_usage(df: DataFrame) -> DataFrame:
    """Price usage records by duration, volume, type and roaming."""
    return df.withColumn(
        "rated_amount",
        rated_amount(
            F.col("duration_s"),
            F.col("bytes_ul") + F.col("bytes_dl"),
            F.col("record_type"),
            F.col("roaming_partner"),
        ),
    )


_HEX = "0123456789abcdef"


def correction_batch(
    issued: DataFrame, batch_id: int, ingest_ts: Column, share: float
) -> DataFrame:
    """Re-rate a share of the issued records as version 2: refunded, halved or raised by 25 %.

    Sample and factor come from a digest of batch and record, so a rerun gives the same
    batch. The whole row is replaced; access point and partner become empty.
    """
    below = f"{int(share * 16**8):08x}" if share < 1 else "g"
    digest = F.md5(F.concat(F.lit(f"{batch_id}:"), F.col("xdr_id")))
    lot = F.instr(F.lit(_HEX), F.substring("_digest", 1, 1)) % 3
    factor = F.when(lot == 0, F.lit("0.00")).when(lot == 1, F.lit("0.50")).otherwise("1.25")
    names = issued.columns
    return (
        issued.withColumn("_digest", digest)
        .filter(F.col("_digest") < below)
        .withColumns(
            {
                "record_version": F.lit(2),
                "apn": F.lit(""),
                "roaming_partner": F.lit(""),
                "ingest_ts": ingest_ts,
                "rated_amount": (F.col("rated_amount") * factor.cast("decimal(3,2)")).cast(
                    "decimal(12,4)"
                ),
                "batch_id": F.lit(batch_id),
                "batch_type": F.lit("CORRECTION"),
            }
        )
        .select(*names)
    )
