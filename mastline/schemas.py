"""Declared schemas of the input tables. Nothing is ever inferred."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_TS, _D, _MONEY = T.TimestampNTZType(), T.DateType(), T.DecimalType(12, 2)

XDR = _struct(
    xdr_id=_S,
    record_version=_I,
    record_type=_S,
    msisdn=_S,
    imsi=_S,
    cell_id=_S,
    rat=_S,
    apn=_S,
    roaming_partner=_S,
    event_ts=_TS,
    ingest_ts=_TS,
    duration_s=_I,
    bytes_ul=_L,
    bytes_dl=_L,
    rated_amount=T.DecimalType(12, 4),
    batch_id=_I,
    batch_type=_S,
)

BASE = {
    "party": _struct(party_id=_L, party_type=_S, display_name=_S),
    "customer": _struct(customer_id=_L, party_id=_L, status=_S, marketing_consent=_B),
    "billing_account": _struct(account_id=_L, customer_id=_L, currency=_S),
    "subscriber": _struct(subscriber_id=_L, party_id=_L, customer_id=_L),
    "product_offering": _struct(offering_id=_L, family=_S),
    "product_inventory": _struct(
        subscription_id=_L,
        customer_id=_L,
        account_id=_L,
        subscriber_id=_L,
        offering_id=_L,
        status=_S,
        monthly_charge=_MONEY,
        contract_end=_D,
        renewal_due=_B,
    ),
    "customer_bill": _struct(
        bill_id=_L, account_id=_L, due_date=_D, outstanding_amount=_MONEY, overdue_30=_B
    ),
    "trouble_ticket": _struct(ticket_id=_L, customer_id=_L, status=_S, priority=_S),
}

KEYS = {
    "party": ["party_id"],
    "customer": ["customer_id"],
    "billing_account": ["account_id"],
    "subscriber": ["subscriber_id"],
    "product_offering": ["offering_id"],
    "product_inventory": ["subscription_id"],
    "customer_bill": ["bill_id"],
    "trouble_ticket": ["ticket_id"],
}

# child table -> (column, parent table); checked by quality.check_reference, never enforced
REFERENCES = [
    ("customer", "party_id", "party"),
    ("billing_account", "customer_id", "customer"),
    ("subscriber", "party_id", "party"),
    ("subscriber", "customer_id", "customer"),
    ("product_inventory", "customer_id", "customer"),
    ("product_inventory", "account_id", "billing_account"),
    ("product_inventory", "subscriber_id", "subscriber"),
    ("product_inventory", "offering_id", "product_offering"),
    ("customer_bill", "account_id", "billing_account"),
    ("trouble_ticket", "customer_id", "customer"),
]

FLAGS = [
    "high_value",
    "multi_line",
    "payment_risk",
    "retention_priority",
    "broadband_cross_sell",
    "campaign_suppressed",
]
TAG_COLUMNS = ["customer_id", "rule_version", *FLAGS]
