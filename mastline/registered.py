"""Every operator as a query over the test tables: name -> (session, folder) -> DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mastline.functions.privacy import CLEAR, READER, mask_columns, reader_view, redact_values
from mastline.operators import changes as ch
from mastline.operators import features as feat
from mastline.operators import quality, rollups, semantic, sketches, telemetry
from mastline.operators.joins import union_all
from mastline.operators.tags import campaign_audience, tag_counts
from mastline.operators.versions import sessions
from mastline.plans import scenarios
from mastline.plans.base import Change
from mastline.plans.refresh import TagTables
from mastline.plans.tagging import features_from_base, tags_from_base
from mastline.schemas import TAG_COLUMNS
from mastline.sources import fixtures as fx
from mastline.sources import base_tables, landing, run_documents, run_fixtures
from mastline.sources.store import Snapshots, publish
from mastline.streaming.ingest import ingest_stream, stream_xdr
from mastline.streaming.latest import keep_latest, sessions_table
from mastline.streaming.rollup import ROLLUPS, UsageRollups, keep_rollups
from mastline.workspace import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CASES = [
    "delta",
    "payment",
    "care_close",
    "terminate",
    "aging",
    "catalog_fanout",
    "delete_customer",
]
# texts to redact from documents; the two-letter one is too short to count
SECRETS = ["ation", "eaux", "ment", "tion", "re"]
LATE_THRESHOLD = 2


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _xdr(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "xdr")


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.hourly_cell_usage(sessions(_xdr(spark, sf), rollups.HOURLY_INPUT))


def _outcome(spark: SparkSession, sf: str, case: str):
    """Base state, changed state and changes. The keys are a table, as a change feed's are."""
    opened: dict[str, DataFrame] = {}
    base = fx.base_tables(spark, sf, opened)
    keys = fx.table(spark, sf, "changed_customer", opened)
    if case in scenarios.BY_KEYS:
        keys = publish(keys, new_folder(spark, "changed"))
    return base, *scenarios.run(case, base, keys, fx.AS_OF)


# --- usage pipeline


@registered
def latest_sessions(spark, sf):
    return sessions(_xdr(spark, sf))


@registered
def hourly_cell_usage(spark, sf):
    return _hourly(spark, sf).drop("uniq_subs_approx")


@registered
def approx_subscribers(spark, sf):
    """The sketch must come within its error of the exact number."""
    gap = F.abs(F.col("uniq_subs_approx") - F.col("uniq_subs"))
    return _hourly(spark, sf).select(
        *rollups.CELL_HOUR, (gap <= F.col("uniq_subs") * 0.15 + 1).alias("close")
    )


@registered
def subscriber_daily(spark, sf):
    return rollups.subscriber_daily(sessions(_xdr(spark, sf), rollups.DAILY_INPUT))


@registered
def late_arrival_audit(spark, sf):
    return rollups.late_arrival_audit(sessions(_xdr(spark, sf), []))


@registered
def batch_type_counts(spark, sf):
    return _xdr(spark, sf).groupBy("batch_type").agg(F.count("*").alias("records"))


@registered
def ingest_dates(spark, sf):
    """Records per day of arrival."""
    day = F.to_date("ingest_ts").alias("ingest_date")
    return _xdr(spark, sf).groupBy(day).agg(F.count("*").alias("records"))


@registered
def newest_records(spark, sf):
    return rollups.newest_records(_xdr(spark, sf))


@registered
def rate_usage(spark, sf):
    return ch.rate_usage(_xdr(spark, sf)).select("xdr_id", "record_version", "rated_amount")


@registered
def correction_batch(spark, sf):
    issued = fx.table(spark, sf, "xdr_v1")
    when = F.lit("2026-09-10 00:00:00").cast("timestamp_ntz")
    return ch.correction_batch(issued, 7, when, share=1 / 40)


@registered
def sketch_totals(spark, sf):
    """Distinct subscribers by day and by cell from sketches kept per cell-hour.

    The first batch is loaded, then corrections arrive and the days they touch are rebuilt.
    The totals must come within the sketches' error of the exact numbers.
    """
    records = _xdr(spark, sf)
    first = F.col("batch_id").eqNullSafe(0)
    before, after = sessions(records.filter(first)), sessions(records)
    table = sketches.SketchTable(spark, new_folder(spark, "sketches"))
    table.build(before)
    table.rebuild(after, sketches.touched_days(before, records.filter(~first)))
    return union_all(
        [
            _close_totals(level, key, table.read(), after)
            for level, key in [("day", F.to_date("event_hour")), ("cell", F.col("cell_id"))]
        ]
    )


def _close_totals(level: str, key, hours: DataFrame, whole: DataFrame) -> DataFrame:
    key = key.cast("string").alias("total_of")
    exact = whole.groupBy(key).agg(F.count_distinct("msisdn").alias("exact"))
    found = sketches.merged(hours, [key]).withColumnRenamed("total_of", "found_of")
    gap = F.abs(F.col("subscribers_approx") - F.col("exact"))
    return found.join(exact, F.col("found_of").eqNullSafe(F.col("total_of")), "full").select(
        F.lit(level).alias("level"),
        "total_of",
        "sessions",
        "bytes",
        "revenue",
        (gap <= F.col("exact") * 0.08 + 1).alias("close"),
    )


# --- landing, loading, streaming


def _landed(spark: SparkSession, sf: str) -> str:
    folder = new_folder(spark, "landing")
    landing.write_landing(_xdr(spark, sf), folder)
    return folder


@registered
def landing_scan(spark, sf):
    """Records read back from the landing files through the declared schema."""
    return landing.scan_xdr(spark, _landed(spark, sf))


@registered
def landing_layout(spark, sf):
    """Which dt= and hour= folder each batch went to."""
    return (
        spark.read.parquet(_landed(spark, sf))
        .groupBy(
            F.col("dt").cast("string").alias("dt"),
            F.col("hour").cast("int").alias("hour"),
            "batch_type",
        )
        .agg(F.count("*").alias("records"))
    )


@registered
def landing_files(spark, sf):
    """Listed files against scanned files: both must be the same set."""
    folder = _landed(spark, sf)
    listed = landing.list_landing(spark, folder)
    scanned = landing.load_history(landing.with_origin(landing.scan_xdr(spark, folder)))
    return listed.join(scanned, F.col("path") == F.col("file"), "full").agg(
        F.sum("rows_loaded").alias("records"),
        F.count_if(F.col("path").isNull() | F.col("file").isNull()).alias("unmatched_files"),
        F.count_if(F.col("length") <= 0).alias("empty_files"),
    )


def _copied_twice(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    folder, raw = _landed(spark, sf), new_folder(spark, "raw")
    landing.copy_append(spark, folder, raw)
    landing.copy_append(spark, folder, raw)
    return folder, landing.read_raw(spark, raw)


@registered
def copy_replay(spark, sf):
    """A second load doubles the raw rows and leaves current sessions as they were."""
    _, raw = _copied_twice(spark, sf)
    kept = sessions(raw.drop(landing.FILE, landing.LOADED))
    return (
        raw.groupBy("batch_type")
        .agg(F.count("*").alias("raw_records"))
        .join(kept.groupBy("batch_type").agg(F.count("*").alias("sessions")), "batch_type", "left")
    )


@registered
def replayed_rows(spark, sf):
    _, raw = _copied_twice(spark, sf)
    return quality.replayed_rows(raw)


@registered
def load_audit(spark, sf):
    """Rows loaded per batch according to the load history."""
    _, raw = _copied_twice(spark, sf)
    return (
        landing.load_history(raw)
        .groupBy("first_batch", "last_batch")
        .agg(F.sum("rows_loaded").alias("rows_loaded"))
    )


@registered
def unpurged_files(spark, sf):
    """All files are still in the landing folder; their loaded rows add up."""
    folder, raw = _copied_twice(spark, sf)
    history = landing.load_history(raw)
    left = landing.unpurged_files(landing.list_landing(spark, folder), history)
    return left.join(history, F.col("path") == F.col("file")).agg(
        F.sum("rows_loaded").alias("rows_at_risk")
    )


@registered
def ingest_once(spark, sf):
    """The first batch and the others arrive, three runs load them: each file counts once."""
    xdr = _xdr(spark, sf)
    folder, raw, state = (new_folder(spark, name) for name in ("landing", "raw", "ingest"))
    first = F.col("batch_id").eqNullSafe(0)
    for arrived in (first, None, ~first):
        if arrived is not None:
            landing.write_landing(xdr.filter(arrived), folder)
        ingest_stream(stream_xdr(spark, folder), raw, state).awaitTermination()
    return (
        landing.read_raw(spark, raw)
        .groupBy("batch_type")
        .agg(F.count("*").alias("records"), F.sum("rated_amount").alias("revenue"))
    )


def _streamed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    table = sessions_table(spark, new_folder(spark, "latest"))
    records = stream_xdr(spark, _landed(spark, sf), max_files=1)
    keep_latest(records, table, new_folder(spark, "latest-state")).awaitTermination()
    return table.read()


@registered
def stream_latest(spark, sf):
    return _streamed_sessions(spark, sf)


@registered
def stream_late(spark, sf):
    """Very late records and corrections reach the audit; nothing is cut off."""
    return rollups.late_arrival_audit(sessions(_streamed_sessions(spark, sf)))


def _streamed_rollup(spark: SparkSession, sf: str, name: str) -> DataFrame:
    wanted = [rollup for rollup in ROLLUPS if rollup.name == name]
    tables = UsageRollups(spark, new_folder(spark, name), wanted)
    records = stream_xdr(spark, _landed(spark, sf), max_files=1)
    keep_rollups(records, tables, new_folder(spark, f"{name}-state")).awaitTermination()
    return tables.read(name)


@registered
def stream_hourly(spark, sf):
    return _streamed_rollup(spark, sf, "hourly").drop("uniq_subs_approx")


@registered
def stream_daily(spark, sf):
    return _streamed_rollup(spark, sf, "daily")


@registered
def stream_audit(spark, sf):
    return _streamed_rollup(spark, sf, "audit")


# --- semantic queries


@registered
def semantic_top_cells(spark, sf):
    return semantic.NETWORK_USAGE.query(
        _hourly(spark, sf),
        ["cell", "radio"],
        ["sessions", "data_gb", "revenue"],
        order_by=["data_gb DESC", "cell", "radio"],
        limit=10,
    )


@registered
def semantic_hour_reliability(spark, sf):
    return semantic.NETWORK_USAGE.query(
        _hourly(spark, sf),
        ["usage.event_hour", "usage.reliability"],
        ["usage.sessions", "usage.revenue"],
        order_by=["event_hour DESC", "reliability"],
        limit=24,
    )


@registered
def semantic_filtered(spark, sf):
    """Synonyms, a derived metric, and a filter on the result."""
    return semantic.NETWORK_USAGE.query(
        _hourly(spark, sf),
        ["site", "technology", "reliability"],
        ["unique_subscribers", "gb_per_session"],
        where="unique_subscribers > 100 AND reliability = 'SETTLED'",
    )


@registered
def semantic_threshold(spark, sf):
    """The same dimension under another threshold."""
    return semantic.NETWORK_USAGE.query(
        _hourly(spark, sf),
        ["reliability"],
        ["sessions", "revenue"],
        variables={"late_threshold_records": LATE_THRESHOLD},
    )


@registered
def semantic_ask(spark, sf):
    return semantic.ask(
        semantic.NETWORK_USAGE,
        _hourly(spark, sf),
        "usage.event_hour, usage.reliability",
        "usage.sessions, usage.data_gb",
        where="sessions >= 2",
        order_by="sessions DESC, event_hour, reliability",
    )


# --- features and tags


@registered
def subscription_features(spark, sf):
    base = fx.base_tables(spark, sf)
    return feat.subscription_features(base.product_inventory, base.product_offering)


@registered
def billing_features(spark, sf):
    base = fx.base_tables(spark, sf)
    return feat.billing_features(base.customer_bill, base.billing_account)


@registered
def care_features(spark, sf):
    return feat.care_features(fx.table(spark, sf, "trouble_ticket"))


@registered
def customer_features(spark, sf):
    return features_from_base(fx.base_tables(spark, sf))


@registered
def customer_tags_full(spark, sf):
    return tags_from_base(fx.base_tables(spark, sf))


@registered
def tag_totals(spark, sf):
    return tag_counts(tags_from_base(fx.base_tables(spark, sf)))


@registered
def audience(spark, sf):
    return campaign_audience(tags_from_base(fx.base_tables(spark, sf)))


# --- changes


def _stored_outcome(spark: SparkSession, sf: str, case: str):
    """As ``_outcome``, with what changed written down, as a change feed hands it over."""
    old, new, changes = _outcome(spark, sf, case)
    folder = new_folder(spark, f"changes-{case}")

    def stored(df: DataFrame | None, name: str) -> DataFrame | None:
        return None if df is None else publish(df, f"{folder}/{name}")

    for table in {change.table for change in changes}:
        new = new.with_table(table, stored(getattr(new, table), table))
    return old, new, [
        Change(c.table, stored(c.before, f"{i}-before"), stored(c.after, f"{i}-after"))
        for i, c in enumerate(changes)
    ]


def _change_query(case: str) -> Query:
    def query(spark, sf):
        _, new, _ = _outcome(spark, sf, case)
        return tags_from_base(new)

    return query


def _incremental_query(case: str) -> Query:
    def query(spark, sf):
        old, new, changes = _stored_outcome(spark, sf, case)
        tables = TagTables(spark, new_folder(spark, f"tags-{case}"))
        tables.build(old)
        tables.refresh(old, new, changes)
        return tables.read()

    return query


for _case in CASES:
    QUERIES[f"change_{_case}"] = _change_query(_case)
    QUERIES[f"incremental_{_case}"] = _incremental_query(_case)


@registered
def refresh_noop(spark, sf):
    """A cycle without changes leaves all five tables alone."""
    old, new, changes = _stored_outcome(spark, sf, "noop")
    tables = TagTables(spark, new_folder(spark, "tags-noop"))
    tables.build(old)
    tables.refresh(old, new, changes)
    return tables.history().filter("version = 1").select(
        "table_name", "refresh_mode", "affected_keys", "rows_inserted", "rows_deleted"
    )


@registered
def refresh_history(spark, sf):
    """What a refresh after the delta change did to each table."""
    old, new, changes = _stored_outcome(spark, sf, "delta")
    tables = TagTables(spark, new_folder(spark, "tags-history"))
    tables.build(old)
    tables.refresh(old, new, changes)
    return tables.history().filter("version = 1").select(
        "table_name", "refresh_mode", "affected_keys", "rows_inserted", "rows_deleted"
    )


@registered
def refresh_replaced(spark, sf):
    """Bills are truncated and loaded anew, a change of consent is declared besides."""
    old, new, changes = _stored_outcome(spark, sf, "delta")
    tables = TagTables(spark, new_folder(spark, "tags-replaced"), watched=True)
    tables.build(old)
    folder = new_folder(spark, "reloaded")
    reloaded = old.customer_bill.filter("outstanding_amount > 40 OR NOT overdue_30")
    bills = publish(reloaded, f"{folder}/bills")
    consent = [change for change in changes if change.table == "customer"]
    old = old.with_table("customer_bill", bills)
    # written anew with the same content: no reason to rebuild
    old = old.with_table("trouble_ticket", publish(old.trouble_ticket, f"{folder}/tickets"))
    tables.refresh(old, old.with_table("customer", new.customer), consent)
    return tables.history().filter("version = 1").select(
        "table_name", "refresh_mode", "affected_keys", "rows_inserted", "rows_deleted"
    )


@registered
def affected_customers(spark, sf):
    """Customers behind every change case: directly, through accounts, through offerings."""
    found = []
    for case in CASES:
        old, new, changes = _outcome(spark, sf, case)
        ids = ch.affected_customers(changes, old, new)
        found.append(ids.select(F.lit(case).alias("change_case"), "customer_id"))
    return union_all(found)


@registered
def qualifying_rows(spark, sf):
    found = []
    for case in CASES:
        _, _, changes = _outcome(spark, sf, case)
        found.append(ch.qualifying_rows(changes).withColumn("change_case", F.lit(case)))
    return union_all(found)


@registered
def tag_transitions(spark, sf):
    found = []
    for case in CASES:
        old, new, _ = _outcome(spark, sf, case)
        moved = ch.tag_transitions(tags_from_base(new), tags_from_base(old))
        found.append(moved.withColumn("change_case", F.lit(case)))
    return union_all(found)


@registered
def snapshot_diff(spark, sf):
    old, new, _ = _outcome(spark, sf, "delta")
    return quality.snapshot_diff(tags_from_base(new), tags_from_base(old), TAG_COLUMNS)


@registered
def lifecycle_flags(spark, sf):
    """Both date flags for the next day, counted by value."""
    base = ch.with_lifecycle_flags(fx.base_tables(spark, sf), "2026-09-11")
    flags = [
        base.product_inventory.select(F.lit("renewal_due").alias("flag"), F.col("renewal_due").alias("value")),
        base.customer_bill.select(F.lit("overdue_30").alias("flag"), F.col("overdue_30").alias("value")),
    ]
    return union_all(flags).groupBy("flag", "value").agg(F.count("*").alias("rows"))


@registered
def publish_versions(spark, sf):
    """A table written, appended to, and one replaced while its old version stays readable."""
    tags = tags_from_base(fx.base_tables(spark, sf))
    folder = new_folder(spark, "published")
    appended = publish(publish(tags, f"{folder}/tags"), f"{folder}/tags", "append")
    snapshots = Snapshots(spark, f"{folder}/snapshots")
    snapshots.replace(appended)
    before = snapshots.read()
    snapshots.replace(before.distinct())
    sides = [("appended", before), ("replaced", snapshots.read())]
    return union_all(
        [
            df.groupBy("campaign_suppressed")
            .agg(F.count("*").alias("customers"))
            .withColumn("state", F.lit(state))
            for state, df in sides
        ]
    )


# --- quality


@registered
def verify_mismatches(spark, sf):
    """The maintained tags against the rebuild, and against the tags before the change."""
    old, new, changes = _stored_outcome(spark, sf, "terminate")
    tables = TagTables(spark, new_folder(spark, "tags-verify"))
    tables.build(old)
    tables.refresh(old, new, changes)
    sides = [("rebuild", tags_from_base(new)), ("before", tags_from_base(old))]
    return union_all(
        [
            quality.verify_equal(tables.read(), other, TAG_COLUMNS).withColumn(
                "against", F.lit(name)
            )
            for name, other in sides
        ]
    )


@registered
def verify_counts(spark, sf):
    base = fx.base_tables(spark, sf)
    return quality.verify_counts(tags_from_base(base), "customer_id", base.customer)


@registered
def key_duplicates(spark, sf):
    return quality.check_key(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@registered
def orphan_rows(spark, sf):
    """References that do not resolve, with the number of rows behind each."""
    base = fx.base_tables(spark, sf)
    checks = [
        ("product_inventory", "offering_id", "product_offering"),
        ("customer_bill", "account_id", "billing_account"),
        ("billing_account", "customer_id", "customer"),
        ("trouble_ticket", "customer_id", "customer"),
        ("product_inventory", "customer_id", "customer"),
        ("product_inventory", "account_id", "billing_account"),
    ]
    return union_all(
        [
            quality.check_reference(
                getattr(base, child), column, getattr(base, parent), column
            ).select(F.lit(child).alias("child"), F.col(column).alias("missing"), "rows")
            for child, column, parent in checks
        ]
    )


@registered
def base_drift(spark, sf):
    """Tables written with columns of another type, missing and undeclared ones, unknown and
    repeated keys, against their declaration."""
    base, folder = fx.base_tables(spark, sf), new_folder(spark, "drift")
    changed = fx.table(spark, sf, "changed_customer").select(
        F.col("customer_id").alias("changed_id")
    )
    customer = base.customer.join(
        changed, F.col("customer_id") == F.col("changed_id"), "left"
    ).select(
        F.when(F.col("changed_id").isNull(), F.col("customer_id")).alias("customer_id"),
        F.lit(None).cast("bigint").alias("party_id"),
        "status",
        "marketing_consent",
    )
    written = {
        "customer": customer,
        "billing_account": base.billing_account.withColumn("region", F.lit("north")),
        "product_offering": base.product_offering.union(base.product_offering),
        "customer_bill": base.customer_bill.withColumn(
            "outstanding_amount", F.col("outstanding_amount").cast("double")
        ),
        "trouble_ticket": base.trouble_ticket.drop("priority"),
    }
    for name, df in written.items():
        publish(df, f"{folder}/{name}")
    return base_tables.drift(spark, folder, list(written))


# --- governance


@registered
def mask_msisdn(spark, sf):
    reader = mask_columns(_xdr(spark, sf), {"msisdn": 4, "imsi": 0})
    return reader.select("xdr_id", "record_version", "msisdn", "imsi", "cell_id")


READERS = {
    "billing": {"msisdn": CLEAR, "roaming_partner": CLEAR},
    "network": {"msisdn": 4, "imsi": 5, "roaming_partner": CLEAR},
    "analyst": {"msisdn": 2},
}


def _reader_query(reader: str) -> Query:
    def query(spark, sf):
        # a session of its own: the setting must not reach other queries
        session = spark.newSession()
        session.conf.set(READER, reader)
        return reader_view(_xdr(session, sf), READERS).select(
            "xdr_id", "record_version", "msisdn", "imsi", "roaming_partner", "cell_id"
        )

    return query


for _reader in READERS:
    QUERIES[f"reader_{_reader}"] = _reader_query(_reader)


@registered
def redact_documents(spark, sf):
    documents = fx.table(spark, sf, "documents")
    return redact_values(documents, "text", SECRETS).select("doc_id", "text")


# --- telemetry


_SCENARIOS = ["measured2_delta_0", "measured2_noop_0", "scale1m_delta_0"]


def _run_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of all runs, written to an archive and read from there."""
    folder = new_folder(spark, "run-documents")
    run_documents.write_archive(run_fixtures.documents(spark, sf), folder)
    return run_documents.scan_archive(spark, folder)


def _report(documents: DataFrame) -> DataFrame:
    return telemetry.run_report(documents, ("measured2_", "scale1m_"), ("explain", "init"))


def _scenarios(documents: DataFrame) -> DataFrame:
    runs = telemetry.scenarios_of(_report(documents), _SCENARIOS)
    # three scans of the summary read the runs, not their documents
    folder = new_folder(documents.sparkSession, "runs")
    runs = publish(runs.select("scenario", *telemetry.SUMMARY_METRICS), folder)
    return telemetry.summarise_metrics(runs, ["scenario"], telemetry.SUMMARY_METRICS)


@registered
def run_rollup(spark, sf):
    """Every verified run in one row, from the documents it left."""
    return _report(_run_documents(spark, sf))


@registered
def run_summary(spark, sf):
    """Twelve metrics per scenario; a run counts where it has the metric."""
    return _scenarios(_run_documents(spark, sf))


@registered
def freshness(spark, sf):
    """Voice records stand for refreshes of a cell's data, all others for its commits."""
    records = _xdr(spark, sf)
    voice = F.col("record_type") == "VOICE"
    end = F.col("ingest_ts") + F.make_dt_interval(secs=F.col("duration_s"))
    return telemetry.freshness_of(
        records.filter(~voice).select(
            "xdr_id", "record_version", F.col("cell_id").alias("source"),
            F.col("ingest_ts").alias("committed_at"),
        ),
        records.filter(voice).select(
            F.col("cell_id").alias("source"), F.col("ingest_ts").alias("started_at"),
            end.alias("finished_at"),
        ),
    )


@registered
def metric_summary(spark, sf):
    return telemetry.summarise(fx.table(spark, sf, "events"), ["event_type"], "value")


@registered
def cost_scenarios(spark, sf):
    key = F.col("o_orderkey")
    return telemetry.cost_scenarios(
        fx.table(spark, sf, "orders").select(
            key,
            (key % 5 + 1).cast("double").alias("rate"),
            (key % 3 + 1).cast("double").alias("cru"),
            (key % 1000).cast("double").alias("active_seconds"),
            F.lit(60.0).alias("idle_seconds"),
            (key % 4 * 5 + 5).cast("double").alias("cadence_minutes"),
            F.lit(30.0).alias("days"),
        )
    )


@registered
def cost_projection(spark, sf):
    """Cost of each scenario and method from the run summaries and the observed price."""
    documents = _run_documents(spark, sf)
    return telemetry.cost_projection(_scenarios(documents), run_documents.prices(documents))


@registered
def storage_rollup(spark, sf):
    """Parts as stored objects: the brand is the schema, the type says what is derived."""
    tables = (
        fx.table(spark, sf, "part")
        .filter(F.col("p_brand").like("Brand#%"))
        .select(
            F.col("p_brand").alias("table_schema"),
            F.when(F.col("p_type") == "PROMO", "DYNAMIC_TABLE")
            .when(F.col("p_type") == "LARGE", "MATERIALIZED_VIEW")
            .otherwise("TABLE")
            .alias("table_type"),
            (F.col("p_size").cast("long") * 1048576).alias("bytes"),
        )
    )
    return telemetry.storage_rollup(tables)


@registered
def distinct_rates(spark, sf):
    """Distinct combinations, as read from a price list."""
    return fx.table(spark, sf, "part").select("p_brand", "p_type").distinct()
