import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from mastline.functions.usage import hour_of, hours_between, interval_seconds, lateness_bucket
from mastline.operators import rollups
from mastline.operators.changes import correction_batch, rate_usage
from mastline.operators.versions import latest_versions, sessions, version_order
from tests.records import HOUR, collected, xdr, xdr_frame

H, M = dt.timedelta(hours=1), dt.timedelta(minutes=1)


def test_lateness_is_cut_toward_zero(spark):
    late = [-30 * M, -90 * M, 0 * M, 59 * M, 119 * M, 24 * H, 72 * H]
    rows = [xdr(str(i), late=d) for i, d in enumerate(late)]
    found = {r.xdr_id: r.lateness_h for r in sessions(xdr_frame(spark, rows)).collect()}
    assert [found[str(i)] for i in range(len(late))] == [0, -1, 0, 0, 1, 24, 72]


def test_hours_do_not_depend_on_the_session_zone(spark):
    df = xdr_frame(spark, [xdr("a", event=dt.datetime(2026, 3, 29, 2, 30), late=H)])
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        row = df.select(
            hour_of(F.col("event_ts")).alias("hour"),
            hours_between(F.col("event_ts"), F.col("ingest_ts")).alias("late"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.hour == dt.datetime(2026, 3, 29, 2) and row.late == 1


def test_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (-5, 0, 1, 5, 6, 23, 24, None)], "h int")
    assert [r[0] for r in df.select(lateness_bucket(F.col("h"))).collect()] == [
        "on_time",
        "on_time",
        "late_1_6h",
        "late_1_6h",
        "late_6_24h",
        "late_6_24h",
        "late_24h_plus",
        "late_24h_plus",
    ]


def test_latest_version_wins_whole_row(spark):
    rows = [
        xdr("a", 1, apn="internet", roaming_partner="X", late=99 * H),
        xdr("a", 2, apn="", roaming_partner="", late=H, rated_amount=Decimal("0.7500")),
        xdr("b", 1, late=H, cell_id="old"),
        xdr("b", 1, late=2 * H, cell_id="new"),
        xdr("c", 1, batch_id=1, cell_id="first"),
        xdr("c", 1, batch_id=2, cell_id="second"),
    ]
    found = {r.xdr_id: r for r in latest_versions(xdr_frame(spark, rows)).collect()}
    assert found["a"].record_version == 2 and found["a"].apn == ""
    assert found["a"].rated_amount == Decimal("0.7500")
    assert found["b"].cell_id == "new" and found["c"].cell_id == "second"


def test_full_ties_give_the_same_row_in_any_order(spark):
    rows = [xdr("a", cell_id=f"SG-C-{i}", bytes_dl=i) for i in range(20)]
    one = collected(latest_versions(xdr_frame(spark, rows).repartition(3)))
    two = collected(latest_versions(xdr_frame(spark, rows[::-1]).repartition(7)))
    assert one == two and len(one) == 1


def test_hot_id_is_reduced_before_the_shuffle(spark, capsys):
    rows = [xdr("hot", v) for v in range(1, 400)] + [xdr(str(i)) for i in range(800)]
    latest = latest_versions(xdr_frame(spark, rows).repartition(4))
    assert latest.count() == 801
    assert latest.filter("xdr_id = 'hot'").first().record_version == 399
    latest.explain()
    assert "row_number(), 1, Partial" in capsys.readouterr().out


def test_hourly_usage(spark):
    rows = [
        xdr("1"),
        xdr("2", event=HOUR + 10 * M, msisdn="6580000002", bytes_dl=None),
        xdr("3", event=HOUR + 59 * M, late=30 * H),
        xdr("4", msisdn=None, bytes_dl=None, bytes_ul=None, rated_amount=None, rat="5G"),
        xdr("5", event=None),
    ]
    found = rollups.hourly_cell_usage(sessions(xdr_frame(spark, rows)))
    assert found.drop("uniq_subs_approx").count() == 3
    by = {(r.event_hour, r.rat): r for r in found.collect()}
    busy = by[HOUR, "4G"]
    assert (busy.sessions, busy.uniq_subs, busy.uniq_subs_approx) == (3, 2, 2)
    assert (busy.bytes_dl, busy.bytes_ul, busy.revenue) == (200, 30, Decimal("4.5000"))
    assert busy.very_late_records == 1
    silent = by[HOUR, "5G"]
    assert (silent.sessions, silent.uniq_subs, silent.bytes_dl, silent.revenue) == (1, 0, None, None)
    undated = by[None, "4G"]
    assert undated.sessions == 1 and undated.very_late_records == 0


def test_daily_and_audit(spark):
    rows = [
        xdr("1", duration_s=60),
        xdr("2", event=HOUR + 23 * H, late=H, duration_s=30),
        xdr("3", event=HOUR + 2 * M, late=8 * H),
        xdr("4", event=None),
    ]
    s = sessions(xdr_frame(spark, rows))
    daily = {r.event_date: r for r in rollups.subscriber_daily(s).collect()}
    assert daily[dt.date(2026, 9, 10)].voice_s == 60
    assert daily[dt.date(2026, 9, 10)].max_lateness_h == 8
    assert daily[dt.date(2026, 9, 11)].bytes_total == 110
    audit = {(r.ingest_hour, r.lateness_bucket): tuple(r[2:]) for r in rollups.late_arrival_audit(s).collect()}
    assert audit == {
        (HOUR, "on_time"): (1, 1),
        (HOUR + 24 * H, "late_1_6h"): (1, 1),
        (HOUR + 8 * H, "late_6_24h"): (1, 1),
        (None, "late_24h_plus"): (1, 0),
    }


def test_rating_is_exact(spark):
    rows = [
        xdr("v", record_type="VOICE", duration_s=90, bytes_ul=0, bytes_dl=0),
        xdr("d", bytes_ul=500_000_000, bytes_dl=500_000_000),
        xdr("s", record_type="SMS", bytes_ul=0, bytes_dl=0),
        xdr("r", bytes_ul=0, bytes_dl=0, roaming_partner="TH-AIS"),
    ]
    found = {r.xdr_id: r.rated_amount for r in rate_usage(xdr_frame(spark, rows)).collect()}
    assert found == {
        "v": Decimal("0.0750"),
        "d": Decimal("8.0000"),
        "s": Decimal("0.0500"),
        "r": Decimal("2.0000"),
    }


def test_corrections_replace_the_row_and_repeat(spark):
    issued = xdr_frame(spark, [xdr(str(i), rated_amount=Decimal("2.0000")) for i in range(500)])
    when = F.lit("2026-09-12 00:00:00").cast("timestamp_ntz")
    batch = correction_batch(issued, 3, when, share=0.4)
    rows = batch.collect()
    again = correction_batch(issued.repartition(5), 3, when, share=0.4).collect()
    assert 150 < len(rows) < 250 and {r.xdr_id: r for r in rows} == {r.xdr_id: r for r in again}
    assert correction_batch(issued, 3, when, share=1).count() == 500
    assert {r.rated_amount for r in rows} == {Decimal("0.0000"), Decimal("1.0000"), Decimal("2.5000")}
    assert {(r.record_version, r.apn, r.batch_type) for r in rows} == {(2, "", "CORRECTION")}
    assert batch.schema.names == issued.schema.names


def test_durations(spark):
    df = spark.createDataFrame([(0, 1, 500_000_000), (0, 0, 0)], "m int, d int, n long")
    found = df.select(interval_seconds(F.col("m"), F.col("d"), F.col("n"))).collect()
    assert [r[0] for r in found] == [86400.5, 0.0]


def test_months_have_no_length(spark):
    import pytest

    df = spark.createDataFrame([(1, 0, 0)], "m int, d int, n long")
    with pytest.raises(Exception, match="months"):
        df.select(interval_seconds(F.col("m"), F.col("d"), F.col("n"))).collect()


def tying_rows():
    """Forty ids, each with two different rows that agree in version, ingest time and batch."""
    return [
        xdr(str(i), rated_amount=Decimal(f"{amount}.0000"), msisdn=f"m{i % 7}{amount}", cell_id=f"c{i % 3}")
        for i in range(40)
        for amount in (1, 2)
    ]


def test_every_rollup_sees_the_same_winner_of_a_tie(spark):
    raw = xdr_frame(spark, tying_rows())
    whole = sessions(raw.withColumn("origin", F.monotonically_increasing_id()))
    revenue = lambda df, name: df.agg(F.sum(name)).first()[0]
    expected = revenue(whole, "rated_amount")
    assert whole.count() == 40
    hourly = rollups.hourly_cell_usage(sessions(raw, rollups.HOURLY_INPUT))
    daily = rollups.subscriber_daily(sessions(raw, rollups.DAILY_INPUT))
    assert revenue(hourly, "revenue") == expected
    assert revenue(daily, next(c for c in daily.columns if "revenue" in c or "amount" in c)) == expected
    streamed = raw.groupBy("xdr_id").agg(F.max_by("rated_amount", version_order()).alias("a"))
    assert revenue(streamed, "a") == expected
