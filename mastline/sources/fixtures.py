"""The two telecom models derived by formula: from the test tables, or from two counts.

``DEFINITIONS`` is one SQL text per table, written so that Spark and the comparison
database read it alike (``{STRING}`` is the only difference).
"""

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from mastline.operators.joins import union_all
from mastline.plans.base import BaseTables

AS_OF = "2026-09-10"

# name -> (tables it reads, SQL)
DEFINITIONS: dict[str, tuple[list[str], str]] = {
    "xdr_v1": (
        ["events"],
        """
select CAST(event_id AS {STRING}) AS xdr_id, CAST(1 AS INTEGER) AS record_version,
 CASE event_type WHEN 'purchase' THEN 'VOICE' WHEN 'signup' THEN 'SMS' ELSE 'DATA' END AS record_type,
 CONCAT('65', CAST(80000000 + user_id AS {STRING})) AS msisdn,
 CONCAT('52501', CAST(80000000 + user_id AS {STRING})) AS imsi,
 CONCAT('SG-C-', CAST(event_id % 4 AS {STRING})) AS cell_id,
 CASE WHEN event_id % 20 < 9 THEN '4G' ELSE '5G' END AS rat,
 CASE WHEN event_type IN ('click','view','error') THEN CASE event_id % 3 WHEN 0 THEN 'internet' WHEN 1 THEN 'ims' ELSE 'iot.m2m' END ELSE '' END AS apn,
 CASE WHEN event_id % 50 = 49 THEN 'MY-CELCOM' ELSE '' END AS roaming_partner,
 ts AS event_ts,
 CASE WHEN event_id % 50 = 49 THEN ts + INTERVAL 24 HOUR + INTERVAL 1 HOUR * (event_id % 48)
      WHEN event_id % 50 >= 45 THEN ts + INTERVAL 1 HOUR * (1 + event_id % 8) + INTERVAL 30 MINUTE
      ELSE ts + INTERVAL 1 SECOND * (event_id % 900) END AS ingest_ts,
 CAST(CASE WHEN event_type = 'purchase' THEN 5 + event_id % 1796 ELSE 0 END AS INTEGER) AS duration_s,
 CAST(CASE WHEN event_type IN ('click','view','error') THEN 1000 + event_id * 37 % 5000000 ELSE 0 END AS BIGINT) AS bytes_ul,
 CAST(CASE WHEN event_type IN ('click','view','error') THEN 10000 + event_id * 7919 % 80000000 ELSE 0 END AS BIGINT) AS bytes_dl,
 CAST(value AS DECIMAL(12,4)) AS rated_amount,
 CAST(0 AS INTEGER) AS batch_id, 'NORMAL' AS batch_type
from events""",
    ),
    "xdr": (
        ["xdr_v1"],
        """
select * from xdr_v1
union all
select xdr_id, 2, record_type, msisdn, imsi, cell_id, rat, '', '', event_ts, event_ts + INTERVAL 30 HOUR, duration_s, bytes_ul, bytes_dl,
 CAST(CASE CAST(xdr_id AS BIGINT) % 3 WHEN 0 THEN 0 WHEN 1 THEN rated_amount * 5 / 10 ELSE rated_amount * 125 / 100 END AS DECIMAL(12,4)), 1, 'CORRECTION'
from xdr_v1 where CAST(xdr_id AS BIGINT) % 40 = 0""",
    ),
    "product_offering": (
        ["part"],
        """
select p_partkey AS offering_id, CASE WHEN p_type IN ('PROMO','STANDARD','SMALL') THEN 'mobile' WHEN p_type = 'LARGE' THEN 'broadband' ELSE 'other' END AS family from part""",
    ),
    "telco_customer": (
        ["customer"],
        """
select c_custkey AS customer_id, CASE WHEN c_custkey % 13 = 0 THEN 'inactive' WHEN c_custkey % 97 = 1 THEN NULL ELSE 'active' END AS status,
 CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN FALSE ELSE TRUE END AS marketing_consent from customer""",
    ),
    "billing_account": (
        ["customer"],
        """
select c_custkey + 1000000 AS account_id, c_custkey AS customer_id, 'SGD' AS currency from customer where c_custkey % 17 <> 5""",
    ),
    "product_inventory": (
        ["orders", "part"],
        """
select o_orderkey AS subscription_id, o_custkey AS customer_id, o_custkey + 1000000 AS account_id, (o_orderkey * 7) % (SELECT COUNT(*) + 41 FROM part) AS offering_id,
 CASE WHEN o_orderstatus='O' AND o_orderkey % 3 <> 0 THEN 'active' ELSE 'terminated' END AS status,
 CAST(20 + o_orderkey % 60 AS DECIMAL(12,2)) AS monthly_charge, DATE '2026-09-10' + CAST(o_orderkey % 60 AS INTEGER) AS contract_end, (o_orderkey % 60 <= 30) AS renewal_due from orders""",
    ),
    "customer_bill": (
        ["orders"],
        """
select o_orderkey AS bill_id, o_custkey + 1000000 AS account_id, DATE '2026-09-10' - CAST(o_orderkey % 60 AS INTEGER) AS due_date,
 CAST(CASE WHEN o_orderkey % 29 = 0 THEN 30 + o_orderkey % 50 ELSE 0 END AS DECIMAL(12,2)) AS outstanding_amount, (o_orderkey % 60 >= 30) AS overdue_30 from orders""",
    ),
    "trouble_ticket": (
        ["events", "customer"],
        """
select event_id AS ticket_id, event_id % (SELECT COUNT(*) FROM customer) AS customer_id,
 CASE WHEN event_type='error' THEN 'open' ELSE 'closed' END AS status, CASE WHEN event_id % 9 = 0 THEN 'high' ELSE 'low' END AS priority from events""",
    ),
    # every fifteenth customer is touched by a change: the first n/15 keys, spread out
    "changed_customer": (
        ["customer"],
        """
select (c_custkey * 7919) % (SELECT COUNT(*) FROM customer) AS customer_id from customer where c_custkey < (SELECT COUNT(*) FROM customer) / 15""",
    ),
}


def table(
    spark: SparkSession, sf_dir: str, name: str, opened: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A derived table, or a given one read from its file. ``opened`` keeps what was read."""
    opened = {} if opened is None else opened
    if name not in opened:
        if name not in DEFINITIONS:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sources, text = DEFINITIONS[name]
            inputs = {source: table(spark, sf_dir, source, opened) for source in sources}
            text = text.replace("{STRING}", "STRING")
            for source in sources:
                text = text.replace(f"from {source}", f"from {{{source}}}")
                text = text.replace(f"FROM {source}", f"FROM {{{source}}}")
            opened[name] = spark.sql(text, **inputs)
    return opened[name]


def base_tables(
    spark: SparkSession, sf_dir: str, opened: dict[str, DataFrame] | None = None
) -> BaseTables:
    opened = {} if opened is None else opened
    return BaseTables(
        **{
            name: table(spark, sf_dir, "telco_customer" if name == "customer" else name, opened)
            for name in BaseTables.NAMES
        }
    )


def sequence(spark: SparkSession, n: int) -> DataFrame:
    """The numbers 1 to n in column ``n``."""
    return spark.range(1, n + 1).withColumnRenamed("id", "n")


def stride_for(customers: int, start: int = 7919) -> int:
    """The first odd step from ``start`` that shares no factor with the customer count."""
    stride = start
    while math.gcd(stride, customers) != 1:
        stride += 2
    return stride


def spread_keys(spark: SparkSession, n: int, customers: int) -> DataFrame:
    """n distinct customer ids of 1..customers, spread over the whole range."""
    if not 1 <= n <= customers:
        raise ValueError("the number of changed customers must lie in 1..customers")
    step = stride_for(customers)
    return sequence(spark, n).select(
        (F.pmod((F.col("n") - 1) * step, F.lit(customers)) + 1).alias("customer_id")
    )


def seed_tables(
    spark: SparkSession, customers: int, subscriptions: int, as_of: str = AS_OF
) -> dict[str, DataFrame]:
    """All eight base tables from two counts, by arithmetic on the row number."""
    if customers < 1 or subscriptions < customers:
        raise ValueError("require at least one customer and one subscription per customer")
    n = F.col("n")
    today = F.to_date(F.lit(as_of))
    owner = (n - 1) % customers + 1
    money = lambda amount: amount.cast("decimal(12,2)")
    per_customer, per_line = sequence(spark, customers), sequence(spark, subscriptions)
    return {
        "party": sequence(spark, customers + subscriptions).select(
            n.alias("party_id"),
            F.lit("individual").alias("party_type"),
            F.concat(F.lit("Synthetic party "), n.cast("string")).alias("display_name"),
        ),
        "customer": per_customer.select(
            n.alias("customer_id"),
            n.alias("party_id"),
            F.lit("active").alias("status"),
            (n % 7 != 0).alias("marketing_consent"),
        ),
        "billing_account": per_customer.select(
            n.alias("account_id"), n.alias("customer_id"), F.lit("SGD").alias("currency")
        ),
        "subscriber": per_line.select(
            n.alias("subscriber_id"),
            (n + customers).alias("party_id"),
            owner.alias("customer_id"),
        ),
        "product_offering": spark.sql(
            "SELECT CAST(offering_id AS BIGINT) AS offering_id, family"
            " FROM VALUES (1, 'mobile'), (2, 'broadband') AS v(offering_id, family)"
        ),
        "product_inventory": per_line.select(
            n.alias("subscription_id"),
            owner.alias("customer_id"),
            owner.alias("account_id"),
            n.alias("subscriber_id"),
            F.when(n % 5 == 0, 2).otherwise(1).cast("long").alias("offering_id"),
            F.lit("active").alias("status"),
            money(n % 100 + 40).alias("monthly_charge"),
            F.date_add(today, (n % 60).cast("int")).alias("contract_end"),
            (n % 60 <= 30).alias("renewal_due"),
        ),
        "customer_bill": per_customer.select(
            n.alias("bill_id"),
            n.alias("account_id"),
            F.date_sub(today, (n % 60).cast("int")).alias("due_date"),
            money(F.when(n % 9 == 0, 75).otherwise(0)).alias("outstanding_amount"),
            (n % 60 >= 30).alias("overdue_30"),
        ),
        "trouble_ticket": per_customer.filter(n % 20 == 0).select(
            n.alias("ticket_id"),
            n.alias("customer_id"),
            F.lit("open").alias("status"),
            F.lit("high").alias("priority"),
        ),
    }


def seed_base(
    spark: SparkSession, customers: int, subscriptions: int, as_of: str = AS_OF
) -> BaseTables:
    """The seeded tables that feed features."""
    tables = seed_tables(spark, customers, subscriptions, as_of)
    return BaseTables(**{name: tables[name] for name in BaseTables.NAMES})


def replayed(df: DataFrame) -> DataFrame:
    """The same rows twice, as after loading a file a second time."""
    return union_all([df, df])
