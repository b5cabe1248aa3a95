"""Customer features. Every child table is brought to customer grain before joining."""

from pyspark.sql import Column, DataFrame, functions as F

from mastline.operators.joins import spread_join

MONEY = "decimal(22,2)"


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def subscription_features(inventory: DataFrame, offering: DataFrame) -> DataFrame:
    """Active lines, spend and renewals per customer.

    One popular offering may carry a large share of all lines, so the lookup is spread
    over its subscriptions. An unknown offering drops its rows.
    """
    c = F.col
    known = spread_join(
        inventory.filter("offering_id IS NOT NULL").select(
            "subscription_id",
            "customer_id",
            "offering_id",
            (c("status") == "active").alias("active"),
            "monthly_charge",
            "renewal_due",
        ),
        offering.select("offering_id", "family"),
        ["offering_id"],
        "inner",
        spread=["subscription_id"],
    )
    return known.groupBy("customer_id").agg(
        _count_if(c("active")).alias("active_subscriptions"),
        F.sum(F.when(c("active"), c("monthly_charge")).otherwise(0)).alias("monthly_spend"),
        _count_if(c("active") & (c("family") == "mobile")).alias("mobile_lines"),
        _count_if(c("active") & (c("family") == "broadband")).alias("broadband_lines"),
        _count_if(c("active") & c("renewal_due")).alias("renewal_lines"),
    )


def billing_features(bill: DataFrame, account: DataFrame) -> DataFrame:
    """Overdue amount per customer; bills are summed per account before the join.

    There are about as many accounts as customers: they are sorted beside the sums, which are
    dealt by account already, and never broadcast by the size of their compressed file.
    """
    per_account = (
        bill.filter("account_id IS NOT NULL")
        .groupBy("account_id")
        .agg(
            F.sum(F.when(F.col("overdue_30"), F.col("outstanding_amount")).otherwise(0)).alias(
                "overdue"
            )
        )
    )
    owners = account.select("account_id", "customer_id").hint("merge")
    return (
        per_account.join(owners, "account_id")
        .groupBy("customer_id")
        .agg(F.sum("overdue").cast(MONEY).alias("overdue_amount"))
    )


def care_features(ticket: DataFrame) -> DataFrame:
    """Open high-priority tickets per customer."""
    complaint = (F.col("status") == "open") & (F.col("priority") == "high")
    return ticket.groupBy("customer_id").agg(_count_if(complaint).alias("open_complaints"))


def customer_features(
    customer: DataFrame, subscription: DataFrame, billing: DataFrame, care: DataFrame
) -> DataFrame:
    """One row per customer with all features; a customer without children has zeros.

    Every child has about as many rows as there are customers, and published in their order it
    takes a small file: the children are sorted beside the customers, never broadcast by its size.
    """
    joined = (
        customer.select("customer_id", "status", "marketing_consent")
        .join(subscription.hint("merge"), "customer_id", "left")
        .join(billing.hint("merge"), "customer_id", "left")
        .join(care.hint("merge"), "customer_id", "left")
    )
    zero_if_missing = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    money = lambda name: F.coalesce(name, F.lit(0)).cast(MONEY).alias(name)
    return joined.select(
        "customer_id",
        "status",
        "marketing_consent",
        zero_if_missing("active_subscriptions"),
        money("monthly_spend"),
        zero_if_missing("mobile_lines"),
        zero_if_missing("broadband_lines"),
        zero_if_missing("renewal_lines"),
        money("overdue_amount"),
        zero_if_missing("open_complaints"),
    )
