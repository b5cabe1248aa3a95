import datetime as dt
from decimal import Decimal

from mastline.operators import quality, rollups
from mastline.operators.versions import latest_versions, sessions
from mastline.schemas import XDR
from mastline.sources import landing
from mastline.streaming.ingest import beyond_bound, ingest_stream, stream_xdr, within_bound
from mastline.streaming.latest import keep_latest, sessions_table
from mastline.streaming.rollup import UsageRollups, keep_rollups
from mastline.workspace import new_folder
from tests.records import HOUR, xdr, xdr_frame

H = dt.timedelta(hours=1)

# first load, then corrections: moved cell, moved hour and day, a stale and an equal replay,
# a changed subscriber, a lost event time, a record that only now gets one, very late arrivals
FIRST = [
    xdr("a"),
    xdr("b", msisdn="6580000002"),
    xdr("c", event=HOUR + H),
    xdr("d", event=HOUR + 2 * H, rat="5G"),
    xdr("e", bytes_dl=None, cell_id="SG-C-9"),
    xdr("f", event=None),
    xdr("g", cell_id="SG-C-3"),
    xdr("g", cell_id="SG-C-3", late=H),
    xdr(None, cell_id="SG-C-4"),
]
SECOND = [
    xdr("a", 2, cell_id="SG-C-2", batch_id=1),
    xdr("b", 2, msisdn="6580000001", rated_amount=Decimal("0.0000"), batch_id=1),
    xdr("c", 2, event=HOUR + 25 * H, batch_id=1),
    xdr("d", 0, event=HOUR + 50 * H, rat="5G", batch_id=1),
    xdr("e", bytes_dl=None, cell_id="SG-C-9"),
    xdr("f", 2, event=HOUR, batch_id=1),
    xdr("h", event=HOUR - 70 * H, late=70 * H, batch_id=1),
    xdr("a", 3, event=None, batch_id=1),
    xdr("new", event=HOUR - 70 * H, late=-H, batch_id=1),
]
THIRD = [
    xdr("a", 4, event=HOUR + 3 * H, batch_id=2),
    xdr("c", 3, event=HOUR + H, batch_id=2),
    xdr("h", 2, event=HOUR, late=25 * H, batch_id=2),
]
BATCHES = [FIRST, SECOND, THIRD]


def test_files_count_once(spark):
    folder, raw, state = (new_folder(spark, n) for n in ("landing", "raw", "state"))
    for rows in (FIRST, None, SECOND):
        if rows is not None:
            landing.write_landing(xdr_frame(spark, rows), folder)
        ingest_stream(stream_xdr(spark, folder), raw, state).awaitTermination()
    loaded = landing.read_raw(spark, raw)
    assert loaded.count() == len(FIRST) + len(SECOND)
    history = landing.load_history(loaded)
    files = landing.list_landing(spark, folder)
    assert history.count() == files.count()
    assert landing.unpurged_files(files, history).count() == files.count()


def test_consumed_files_leave_the_landing_folder(spark):
    folder, raw, state = (new_folder(spark, n) for n in ("landing", "raw", "state"))
    for rows in BATCHES:
        landing.write_landing(xdr_frame(spark, rows), folder)
        ingest_stream(stream_xdr(spark, folder, clean="delete"), raw, state).awaitTermination()
    loaded = landing.read_raw(spark, raw)
    assert loaded.count() == sum(map(len, BATCHES))
    left = landing.unpurged_files(landing.list_landing(spark, folder), landing.load_history(loaded))
    assert left.count() < landing.load_history(loaded).count()


def batch_rollups(raw):
    whole = sessions(raw)
    return {
        "hourly": rollups.hourly_cell_usage(whole),
        "daily": rollups.subscriber_daily(whole),
        "audit": rollups.late_arrival_audit(whole),
    }


def assert_current(tables, raw):
    for name, expected in batch_rollups(raw).items():
        found = tables.read(name)
        both = quality.verify_equal(found, expected, expected.columns)
        assert tuple(both.first()) == (0, 0), name
        assert found.count() == expected.count()


def test_streams_equal_batch_after_every_load(spark):
    folder = new_folder(spark, "landing")
    latest = sessions_table(spark, new_folder(spark, "latest"))
    path = new_folder(spark, "usage")
    tables = UsageRollups(spark, path)
    states = [new_folder(spark, "state") for _ in range(2)]
    seen = []
    for rows in BATCHES:
        seen += rows
        landing.write_landing(xdr_frame(spark, rows), folder)
        keep_latest(stream_xdr(spark, folder), latest, states[0]).awaitTermination()
        keep_rollups(stream_xdr(spark, folder), tables, states[1]).awaitTermination()
        raw = xdr_frame(spark, seen)
        assert tuple(
            quality.verify_equal(latest.read(), latest_versions(raw), XDR.names).first()
        ) == (0, 0)
        assert_current(tables, raw)
        if rows is SECOND:
            tables.compact()
            latest.compact()
    # a replayed micro-batch is ignored, and a reopened table reads the same
    tables.absorb(spark.range(1), 0)
    assert_current(UsageRollups(spark, path), raw)
    assert {r.table_name for r in tables.history().collect()} == {"hourly", "daily", "audit"}


def test_latest_keeps_no_state_and_old_versions_change_nothing(spark):
    """An old version that arrives after a newer one was folded into the base does not count."""
    folder, state = new_folder(spark, "landing"), new_folder(spark, "state")
    latest = sessions_table(spark, new_folder(spark, "latest"))
    loads = [
        [xdr("a", 3, cell_id="SG-C-7"), xdr("a", 2), xdr(None, 2, cell_id="SG-C-8"), xdr("b")],
        [xdr("a", 1, cell_id="SG-C-1"), xdr(None, 1), xdr("b", 2, event=None)],
        [xdr("a", 3, cell_id="SG-C-7"), xdr("b", 1)],
    ]
    seen = []
    for rows in loads:
        seen += rows
        landing.write_landing(xdr_frame(spark, rows), folder)
        query = keep_latest(stream_xdr(spark, folder, max_files=1), latest, state)
        query.awaitTermination()
        assert not any(p.stateOperators for p in query.recentProgress)
        expected = latest_versions(xdr_frame(spark, seen))
        assert tuple(quality.verify_equal(latest.read(), expected, XDR.names).first()) == (0, 0)
        assert latest.read().count() == 3
        latest.compact()


def test_touched_days_are_literal_partition_filters(spark):
    folder = new_folder(spark, "landing")
    tables = UsageRollups(spark, new_folder(spark, "usage"), compact_every=2)
    state = new_folder(spark, "state")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for rows in BATCHES:
            landing.write_landing(xdr_frame(spark, rows), folder)
            keep_rollups(stream_xdr(spark, folder), tables, state).awaitTermination()
        last = max(c.version for c in tables.log.commits() if c.kind == "changes")
        for name in tables.rollups:
            plan = tables._standing(last, name)._jdf.queryExecution().executedPlan().toString()
            filters = [x.split("PartitionFilters")[1] for x in plan.splitlines() if "PartitionFilters" in x]
            assert filters and not any("dynamicpruning" in x for x in filters)
            assert any("day#" in x and ("IN (" in x or "day#" in x and "= " in x) for x in filters)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert_current(tables, xdr_frame(spark, [row for rows in BATCHES for row in rows]))
    assert any(c.kind == "logs" for c in tables.log.commits())


def test_bound_splits_and_loses_nothing(spark):
    df = xdr_frame(spark, SECOND)
    near, far = within_bound(df, 69), beyond_bound(df, 69)
    assert {r.xdr_id for r in far.collect()} == {"h"}
    assert near.count() + far.count() == df.count() == within_bound(df, None).count()
