"""Base tables to customer tags in one plan."""

from mastline.operators import features as f
from mastline.operators.tags import customer_tags
from mastline.plans.base import BaseTables
from pyspark.sql import DataFrame


def features_from_base(base: BaseTables) -> DataFrame:
    """All customer features, from base tables only."""
    return f.customer_features(
        base.customer,
        f.subscription_features(base.product_inventory, base.product_offering),
        f.billing_features(base.customer_bill, base.billing_account),
        f.care_features(base.trouble_ticket),
    )


def tags_from_base(base: BaseTables) -> DataFrame:
    """The full rebuild: every tag from base tables only."""
    return customer_tags(features_from_base(base))
