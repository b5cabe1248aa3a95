import json
import math
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mastline.functions.privacy import REDACTED, mask_columns, redact_values
from mastline.operators import quality, telemetry
from mastline.operators.features import billing_features, customer_features
from mastline.operators.joins import drop_keys, keep_keys, spread_join
from mastline.operators.semantic import NETWORK_USAGE, Metric, SemanticView, ask
from mastline.sources import landing, reports
from mastline.sources.fixtures import replayed, sequence
from mastline.sources.store import CommitLog, KeyedTable, Snapshots, publish
from mastline.streaming.rollup import HOURLY
from mastline.workspace import new_folder, shared_folder
from tests.records import HOUR, collected, xdr, xdr_frame


# --- joins


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join(spark, how):
    """One key has most rows, some rows are copies, some keys are missing on either side."""
    facts = spark.range(900).select(
        "id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("k")
    )
    facts = facts.unionByName(facts.filter("id < 300"))
    lookup = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (9, "w"), (None, "n")], "k int, v string")
    spread = spread_join(facts, lookup, ["k"], how, ["id"])
    plain = facts.join(lookup, ["k"], how)
    assert collected(spread.select(*plain.columns)) == collected(plain)


def test_spread_join_refuses_joins_it_would_multiply(spark):
    df = sequence(spark, 2)
    with pytest.raises(ValueError, match="right"):
        spread_join(df, df, ["n"], "right", ["n"])


def test_spread_join_counts_its_copies_before_a_broadcast(spark):
    """A lookup just below Spark's size limit is over it eight times."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    lookup = spark.range(5000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    spark.conf.set(name, 100_000)
    try:
        facts = spark.range(100_000).select("id", (F.col("id") % 5000).alias("k"))
        joined = spread_join(facts, lookup, ["k"], "inner", ["id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_spread_join_never_broadcasts_the_facts(spark, tmp_path):
    """Many rows may lie in a file below Spark's limit, smaller than the lookup's."""
    rows = spark.range(2000).select("id", (F.col("id") % 50).alias("k"))
    facts = publish(rows, f"{tmp_path}/facts")
    lookup = spark.range(40).select(F.col("id").alias("k"), F.repeat(F.lit("v"), 9000).alias("v"))
    joined = spread_join(facts, lookup, ["k"], "inner", ["id"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert joined.count() == 40 * 40


def test_accounts_are_not_broadcast_by_the_size_of_their_file(spark):
    """A million accounts may lie in a file below Spark's limit."""
    accounts = spark.range(50).select(F.col("id").alias("account_id"), (F.col("id") % 7).alias("customer_id"))
    bills = spark.range(200).select(
        (F.col("id") % 60).alias("account_id"),
        (F.col("id") % 2 == 0).alias("overdue_30"),
        F.lit(Decimal(1)).alias("outstanding_amount"),
    )
    found = billing_features(bills, accounts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.agg(F.sum("overdue_amount")).first()[0] == sum(i % 2 == 0 and i % 60 < 50 for i in range(200))


def test_children_of_customers_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    """Derived tables in the order of the customer take a tenth of what their rows take in memory."""
    ids = spark.range(5000).select(F.col("id").alias("customer_id"))
    child = lambda **columns: publish(
        ids.filter("customer_id % 3 = 0").withColumns({n: F.lit(v) for n, v in columns.items()}),
        f"{tmp_path}/{'-'.join(columns)}",
    )
    subscription = child(
        active_subscriptions=2,
        monthly_spend=Decimal(5),
        mobile_lines=1,
        broadband_lines=1,
        renewal_lines=0,
    )
    customer = ids.withColumns({"status": F.lit("active"), "marketing_consent": F.lit(True)})
    found = customer_features(
        customer, subscription, child(overdue_amount=Decimal(3)), child(open_complaints=4)
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    sums = found.agg(F.count("*"), F.sum("active_subscriptions"), F.sum("open_complaints")).first()
    assert tuple(sums) == (5000, 2 * 1667, 4 * 1667)


def test_null_is_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    keys = spark.createDataFrame([(None,)], "k int")
    assert collected(keep_keys(df, keys, ["k"])) == [(None, "b")]
    assert collected(drop_keys(df, keys, ["k"])) == [(1, "a")]


# --- quality


def test_equality_in_both_directions(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y"), (4, "z")], "k int, v string")
    assert tuple(quality.verify_equal(a, b, ["k", "v"]).first()) == (1, 2)
    assert tuple(quality.verify_equal(a, a.distinct(), ["k", "v"]).first()) == (0, 0)
    assert tuple(quality.verify_equal(a.limit(0), a.limit(0), ["k", "v"]).first()) == (0, 0)
    diff = {tuple(r) for r in quality.snapshot_diff(b, a, ["k", "v"]).collect()}
    assert diff == {
        ("deleted", 1, None, 1),
        ("deleted", 2, "x", 1),
        ("inserted", 3, "y", 1),
        ("inserted", 4, "z", 1),
    }


def test_counts_keys_references(spark):
    a = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "k int, p int")
    assert tuple(quality.verify_counts(a, "k", a.limit(2)).first()) == (3, 2, 2)
    assert collected(quality.check_key(a, ["k"])) == [(1, 2)]
    parent = spark.createDataFrame([(5,)], "id int")
    assert collected(quality.check_reference(a, "p", parent, "id")) == [(6, 1)]
    raw = replayed(xdr_frame(spark, [xdr("a"), xdr("b")]))
    assert {tuple(r) for r in quality.replayed_rows(raw).collect()} == {("a", 1, 0, 2), ("b", 1, 0, 2)}


# --- privacy


def test_masking(spark):
    df = spark.createDataFrame([("6581234567", "Ab-9"), (None, None), ("65", "")], "n string, t string")
    found = [tuple(r) for r in mask_columns(df, {"n": 4, "t": 0}).collect()]
    assert found == [("6581######", "Xx-#"), (None, None), ("65", "")]
    with pytest.raises(ValueError, match="unknown"):
        mask_columns(df, {"x": 0})


def test_redaction_takes_the_longest_first(spark):
    df = spark.createDataFrame([("abcdef abc 12 s.e.c",)], "t string")
    found = redact_values(df, "t", ["abc", "abcd", "bcdef", "s.e.c", "12"]).first()[0]
    assert found == f"a{REDACTED} abc 12 {REDACTED}"


# --- semantic view


@pytest.fixture(scope="module")
def hourly(spark):
    rows = [
        (HOUR, "c1", "4G", 2, 2, 2, 2**30, 0, Decimal("1.0000"), 0),
        (HOUR, "c1", "5G", 1, 1, 1, 2**29, 2**29, Decimal("2.0000"), 3),
        (HOUR, "c2", "4G", 4, 3, 3, 0, 0, None, 1),
    ]
    return spark.createDataFrame(rows, HOURLY)


def test_reliability_is_decided_before_grouping(hourly):
    found = NETWORK_USAGE.query(hourly, ["event_hour", "reliability"], ["sessions", "revenue"])
    assert {tuple(r)[1:] for r in found.collect()} == {
        ("SETTLED", 2, Decimal("1.0000")),
        ("PROVISIONAL", 5, Decimal("2.0000")),
    }
    raised = NETWORK_USAGE.query(
        hourly, ["reliability"], ["sessions"], variables={"late_threshold_records": 2}
    )
    assert {tuple(r) for r in raised.collect()} == {("SETTLED", 6), ("PROVISIONAL", 1)}


def test_names_synonyms_and_derived_metrics(hourly):
    found = NETWORK_USAGE.query(
        hourly, ["Cell ID", "usage.radio"], ["gb_per_session"], order_by=["cell", "radio DESC"]
    )
    assert found.columns == ["cell", "radio", "gb_per_session"]
    assert [tuple(r) for r in found.collect()] == [
        ("c1", "5G", 1.0),
        ("c1", "4G", 0.5),
        ("c2", "4G", 0.0),
    ]
    total = NETWORK_USAGE.query(hourly, [], ["unique_subscribers", "data_gb"]).first()
    assert tuple(total) == (6, 2.0)
    assert {r[0] for r in NETWORK_USAGE.query(hourly, ["technology"]).collect()} == {"4G", "5G"}


def test_outer_filter_order_and_default_limit(hourly):
    found = ask(NETWORK_USAGE, hourly, "usage.cell", "usage.sessions, usage.data_gb", "sessions > 3", "sessions DESC")
    assert [tuple(r) for r in found.collect()] == [("c2", 4, 0.0)]
    many = hourly.crossJoin(sequence(hourly.sparkSession, 40)).withColumn(
        "cell_id", F.concat("cell_id", F.col("n").cast("string"))
    )
    assert ask(NETWORK_USAGE, many, "cell", "sessions").count() == 24


@pytest.mark.parametrize(
    "arguments",
    [
        {"dimensions": ["nope"]},
        {"metrics": ["nope"]},
        {},
        {"metrics": ["sessions"], "variables": {"nope": 1}},
        {"metrics": ["sessions"], "order_by": ["sessions SIDEWAYS"]},
    ],
)
def test_bad_requests_fail_early(hourly, arguments):
    with pytest.raises(ValueError):
        NETWORK_USAGE.query(hourly, **arguments)


def test_view_declarations_are_checked(spark, hourly):
    twice = (Metric("m", "sum(sessions)"), Metric("m", "sum(revenue)"))
    with pytest.raises(ValueError, match="twice"):
        SemanticView("v", "v", (), (), twice)
    loop = (Metric("a", "b", over=("b",)), Metric("b", "a", over=("a",)))
    with pytest.raises(ValueError, match="itself"):
        SemanticView("v", "v", (), (), loop).query(hourly, [], ["a"])
    parts = {(r.kind, r.name) for r in NETWORK_USAGE.describe(spark).collect()}
    assert ("derived metric", "gb_per_session") in parts and ("key", "rat") in parts
    assert len(parts) == 1 + 3 + 1 + 4 + 5


# --- stores


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_publish_and_snapshots(spark):
    folder = new_folder(spark, "publish")
    one = publish(sequence(spark, 3), f"{folder}/t")
    assert publish(one, f"{folder}/t", "append").count() == 6
    with pytest.raises(PySparkException):
        publish(one, f"{folder}/t")
    with pytest.raises(ValueError, match="in place"):
        publish(one, f"{folder}/t", "overwrite")
    snapshots = Snapshots(spark, f"{folder}/s")
    with pytest.raises(ValueError, match="nothing"):
        snapshots.read()
    snapshots.replace(sequence(spark, 5))
    first = snapshots.read()
    snapshots.replace(first.filter("n > 3"))
    assert (first.count(), snapshots.read().count()) == (5, 2)
    assert Snapshots(spark, f"{folder}/s").read().count() == 2


def test_keyed_table_versions(spark):
    folder = new_folder(spark, "keyed")
    open_table = lambda: KeyedTable(
        f"{folder}/t", ["k"], "k bigint, v string", CommitLog(spark, f"{folder}/commits")
    )
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k bigint, v string")
    table = open_table()
    assert table.read().isEmpty()
    table.create(rows((1, "a"), (2, "b"), (3, "c")), 0)
    keys = rows((1, ""), (2, ""), (3, ""), (4, ""))
    done = table.apply(rows((1, "a"), (2, "B"), (4, "d")), keys, 1)
    assert (done.rows_inserted, done.rows_deleted) == (2, 2)
    assert collected(table.changes([1]).select("k")) == [(2,), (3,), (4,)]
    assert table.size() == 3
    # nobody else sees a version before its commits are written
    assert open_table().read().isEmpty()
    table.log.write()
    table.apply(rows((3, "C")), rows((3, "")), 2)
    table.log.write()
    expected = [(1, "a"), (2, "B"), (3, "C"), (4, "d")]
    assert collected(table.read()) == collected(open_table().read()) == expected
    nothing = table.apply(rows((1, "a")), rows((1, "")), 3)
    assert (nothing.rows_inserted, nothing.rows_deleted) == (0, 0)
    table.compact()
    assert collected(open_table().read()) == expected and open_table().size() == 4


def test_landing_layout_keeps_batches_together(spark):
    import datetime as dt

    folder = new_folder(spark, "landing")
    day = dt.timedelta(days=1)
    rows = [xdr("a"), xdr("b", late=day), xdr("c", event=HOUR + day, batch_id=1), xdr("d", batch_id=None)]
    landing.write_landing(xdr_frame(spark, rows), folder)
    assert collected(landing.scan_xdr(spark, folder)) == collected(xdr_frame(spark, rows))
    parts = spark.read.parquet(folder).select(F.col("dt").cast("string"), "hour", "xdr_id")
    assert ("2026-09-10", 8, "b") in {tuple(r) for r in parts.collect()}


# --- telemetry


def test_cost_scenarios(spark):
    names = ["rate", "cru", "active_seconds", "idle_seconds", "cadence_minutes", "days"]
    good = spark.createDataFrame(
        [(1.86, 1.0, 10.0, 60.0, 15.0, 30.0), (1.86, 1.0, 2000.0, 60.0, 15.0, 30.0)], names
    )
    short, long = telemetry.cost_scenarios(good).collect()
    assert short.vc_cost_period == pytest.approx(104.16) and short.stable_cadence
    assert short.always_on_period == pytest.approx(1339.2) and short.runs == 2880
    assert long.vc_cost_period == pytest.approx(1339.2) and not long.stable_cadence
    for i, value in [(0, float("nan")), (0, -1.0), (1, 0.0), (5, float("inf")), (2, None)]:
        row = [1.86, 1.0, 10.0, 60.0, 15.0, 30.0]
        row[i] = value
        bad = spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))
        with pytest.raises(PySparkException, match="invalid cost inputs"):
            telemetry.cost_scenarios(bad).collect()


def test_summary_is_exact_for_any_size_and_skew(spark):
    """Tiny groups, a group with most rows, many equal values, unknown values."""
    rows = [("one", 5.0), ("two", 1.0), ("two", 2.0), ("three", 3.0), ("three", 1.0), ("three", None), ("none", None)]
    rows += [("hot", float((i * 7919) % 6007)) for i in range(6007)]
    rows += [("flat", 4.0)] * 500 + [("flat", 9.0)] * 26
    found = {r.g: r for r in telemetry.summarise(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    values = {}
    for group, value in rows:
        if value is not None:
            values.setdefault(group, []).append(value)
    assert set(found) == set(values)
    for group, known in values.items():
        known.sort()
        n = len(known)
        row = found[group]
        assert row.n == n and (row.min, row.max) == (known[0], known[-1])
        assert row.median == (known[(n - 1) // 2] + known[n // 2]) / 2, group
        assert row.p95_nearest_rank == known[math.ceil(0.95 * n) - 1], group


def test_run_documents_to_rollup(spark, tmp_path):
    """Documents of two runs as files: missing counters and profiles stay unknown."""

    def write(folder, name, payload):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps(payload, indent=1))

    profile = lambda stats, meter: {"data": {"jobSummary": {"stats": {"inputOutputStats": stats}, "meter": {"measurements": meter}}}}
    ns = lambda value: {"key": "cpu_wall_time", "unit": "ns", "value": value}
    write("profiles_r1", "003_refresh_customer_tags.json", profile({"inputBytes": "7"}, [ns("500000000"), ns("250000000")]))
    write("profiles_r1", "004_full_recompute.json", profile({"inputBytes": "11"}, []))
    write("profiles_r2", "003_refresh_customer_tags.json", {"data": {"jobSummary": {}}})
    write("r1", "010_history.json", {"rows": [{"job_id": "2", "refresh_mode": "INCREMENTAL", "duration_s": 1.5, "end_time": "2026-09-10T00:00:30"}]})
    profiles = telemetry.profile_metrics(reports.scan_profiles(spark, f"{tmp_path}/profiles_*/*.json"))
    history = reports.scan_rows(
        spark, f"{tmp_path}/r*/*_history.json", "job_id: string, refresh_mode: string, duration_s: double, end_time: timestamp_ntz"
    ).drop("file")
    manifest = spark.createDataFrame(
        [
            ("r1", 1, "change_0", "source_change", "1", True),
            ("r1", 2, "refresh_customer_tags", "incremental", "2", True),
            ("r1", 3, "full_recompute", "full", "3", True),
            ("r2", 1, "refresh_customer_tags", "incremental", "4", False),
        ],
        "run_id string, seq int, label string, category string, job_id string, ok boolean",
    )
    jobs = spark.createDataFrame(
        [("1", 2.0, "2026-09-10 00:00:10"), ("3", 4.0, "2026-09-10 00:01:00")], "job_id string, execution_s double, t string"
    ).selectExpr("job_id", "execution_s", "CAST(t AS TIMESTAMP_NTZ) AS end_time")
    runs = {r.run_id: r for r in telemetry.run_rollup(manifest, history, jobs, profiles).collect()}
    one, two = runs["r1"], runs["r2"]
    assert one.incremental_server_seconds == 1.5 and one.full_server_seconds == 4.0
    assert one.incremental_inputBytes == 7 and one.incremental_cpu_wall_seconds == 0.75
    assert one.incremental_outputBytes is None and one.full_cpu_wall_seconds is None
    assert one.source_change_inputBytes is None and one.source_change_job_count == 1
    assert one.consumption_server_seconds == 0 and one.consumption_job_count == 0
    assert one.refresh_modes == "customer_tags:INCREMENTAL"
    assert one.last_source_commit_to_tags_seconds == 20.0 and one.all_statements_ok
    assert two.incremental_server_seconds is None and two.refresh_modes == ""
    assert two.last_source_commit_to_tags_seconds is None and not two.all_statements_ok


def test_a_null_group_is_summarised_too(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", None)], "g string, v double")
    rows = {r.g: (r.n, r.median, r.max) for r in telemetry.summarise(df, ["g"], "v").collect()}
    assert rows == {"a": (2, 1.5, 2.0), None: (1, 3.0, 3.0)}


def test_documents_collected_twice_count_once(spark):
    manifest = spark.createDataFrame(
        [("r", 2, "refresh_b", "incremental", "2", True), ("r", 1, "refresh_other", "incremental", "1", True), ("r", 3, "q", "full", "3", True)],
        "run_id string, seq int, label string, category string, job_id string, ok boolean",
    )
    history = spark.createDataFrame(
        [("r", "1", "RUNNING", 9.0, 0), ("r", "1", "FULL", 1.0, 1), ("r", "2", "INCREMENTAL", 2.0, 0), ("r", "2", "INCREMENTAL", 2.0, 0)],
        "run_id string, job_id string, refresh_mode string, duration_s double, snapshot int",
    ).selectExpr("*", "TIMESTAMP_NTZ '2026-09-10 00:00:00' AS end_time")
    jobs = spark.createDataFrame([("3", 1.5, 1), ("3", 1.0, 0), ("3", 1.5, 1)], "job_id string, execution_s double, snapshot int").selectExpr(
        "*", "TIMESTAMP_NTZ '2026-09-10 00:00:00' AS end_time"
    )
    stats = spark.createDataFrame([("r", "q", {"inputBytes": "7"}, [])] * 2, "run_id string, label string, stats map<string,string>, meter array<struct<key:string,unit:string,value:string>>")
    run = telemetry.run_rollup(manifest, history, jobs, telemetry.profile_metrics(stats)).first()
    assert (run.full_server_seconds, run.full_job_count, run.full_inputBytes) == (1.5, 1, 7)
    assert (run.incremental_server_seconds, run.incremental_job_count) == (3.0, 2)
    assert run.refresh_modes == "other:FULL;b:INCREMENTAL"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2)], "run_id string, n int").coalesce(1)
    reports.write_report(df, f"{tmp_path}/csv")
    reports.write_report(df, f"{tmp_path}/json", "json")
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()
    assert text == ["run_id,n", "a,", "b,2"]
    lines = next((tmp_path / "json").glob("part-*.json")).read_text().splitlines()
    assert [json.loads(line) for line in lines] == [{"run_id": "a"}, {"run_id": "b", "n": 2}]
    with pytest.raises(ValueError):
        reports.write_report(df, f"{tmp_path}/x", "xml")


def test_storage(spark):
    rows = [("s", "TABLE", 2**30), ("s", "DYNAMIC_TABLE", 2**30), ("t", "TABLE", 0)]
    found = {r.table_schema: r for r in telemetry.storage_rollup(spark.createDataFrame(rows, "table_schema string, table_type string, bytes long")).collect()}
    assert (found["s"].all_object_bytes, found["s"].derived_bytes) == (2**31, 2**30)
    assert found["s"].all_object_month_cost == 0.05 and found["t"].derived_bytes == 0
