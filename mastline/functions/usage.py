"""Column expressions of the usage pipeline. None depends on the session time zone."""

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, functions as F

GIB = 1073741824.0
# fixed values: 0.05 per minute, 8 per 10^9 bytes, 0.05 per SMS, 2 for roaming
RATES = {
    "second": Fraction("0.05") / 60,
    "byte": Fraction(8, 10**9),
    "sms": Fraction("0.05"),
    "roaming": Fraction(2),
}
STEPS = 10_000  # of an amount, in one unit of money


def hour_of(ts: Column) -> Column:
    """Start of the hour of a zone-less timestamp."""
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.lit(0), F.lit(0)
    )


def hours_between(start: Column, end: Column) -> Column:
    """Complete hours from start to end, cut toward zero (-90 minutes is -1)."""
    return F.call_function("div", end - start, F.expr("INTERVAL '1' HOUR"))


def lateness_bucket(lateness_h: Column) -> Column:
    """Early and on-time records share a bucket; unknown lateness counts as the latest."""
    return (
        F.when(lateness_h < 1, "on_time")
        .when(lateness_h < 6, "late_1_6h")
        .when(lateness_h < 24, "late_6_24h")
        .otherwise("late_24h_plus")
    )


def rated_amount(
    duration_s: Column, bytes_total: Column, record_type: Column, roaming_partner: Column
) -> Column:
    """Price of a record by ``RATES``, rounded half up to four digits.

    Worked out in whole units so small that every rate is a whole number of them.
    """
    unit = lcm(*(rate.denominator for rate in RATES.values()), 2 * STEPS)
    whole = {name: int(rate * unit) for name, rate in RATES.items()}
    step = unit // STEPS
    units = (
        duration_s.cast("long") * whole["second"]
        + bytes_total.cast("long") * whole["byte"]
        + F.when(record_type == "SMS", F.lit(whole["sms"])).otherwise(0)
        + F.when(roaming_partner != "", F.lit(whole["roaming"])).otherwise(0)
    )
    steps = F.call_function("div", units + step // 2, F.lit(step))
    return (steps.cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast(
        "decimal(12,4)"
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Difference of two zone-less timestamps in seconds, to the microsecond."""
    micros = F.call_function("div", end - start, F.expr("INTERVAL '0.000001' SECOND"))
    return micros / F.lit(1e6)


def interval_seconds(months: Column, days: Column, nanos: Column) -> Column:
    """Seconds of a (months, days, nanoseconds) triple; months have no fixed length."""
    return F.when(
        months != 0, F.raise_error(F.lit("a duration with months has no length in seconds"))
    ).otherwise(days * F.lit(86400.0) + nanos / F.lit(1e9))
