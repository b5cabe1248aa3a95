"""Versioned customer tags and what is read from them."""

from pyspark.sql import Column, DataFrame, functions as F

from mastline.schemas import FLAGS

# fixed values: the rule version and the thresholds it stands for
RULE_VERSION = "bss-v1"
HIGH_SPEND = 100
OVERDUE_RISK = 50
MULTI_LINE = 2


def customer_tags(features: DataFrame) -> DataFrame:
    """Six 0/1 flags per customer. Unknown status or consent suppresses campaigns."""
    c = F.col
    active = c("status") == "active"
    spends = c("monthly_spend") >= HIGH_SPEND
    complains = c("open_complaints") > 0
    flags: dict[str, Column] = {
        "high_value": active & spends,
        "multi_line": active & (c("active_subscriptions") >= MULTI_LINE),
        "payment_risk": active & (c("overdue_amount") >= OVERDUE_RISK),
        "retention_priority": active & spends & ((c("renewal_lines") > 0) | complains),
        "broadband_cross_sell": active
        & c("marketing_consent")
        & (c("mobile_lines") > 0)
        & (c("broadband_lines") == 0)
        & (c("overdue_amount") == 0)
        & (c("open_complaints") == 0),
        "campaign_suppressed": ~active
        | c("status").isNull()
        | ~c("marketing_consent")
        | c("marketing_consent").isNull()
        | (c("overdue_amount") > 0)
        | complains,
    }
    return features.select(
        "customer_id",
        F.lit(RULE_VERSION).alias("rule_version"),
        *[F.when(rule, 1).otherwise(0).alias(name) for name, rule in flags.items()],
    )


def tag_counts(tags: DataFrame) -> DataFrame:
    """How many customers carry each flag."""
    return tags.agg(*[F.sum(name).alias(name) for name in FLAGS])


def campaign_audience(tags: DataFrame, n: int = 100) -> DataFrame:
    """The first n customers to offer broadband to, in key order."""
    return (
        tags.filter("broadband_cross_sell = 1 AND campaign_suppressed = 0")
        .select("customer_id", "rule_version")
        .orderBy("customer_id")
        .limit(n)
    )
