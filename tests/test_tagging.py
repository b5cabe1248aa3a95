import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mastline.operators import changes as ch
from mastline.operators import joins, quality
from mastline.operators.tags import campaign_audience, tag_counts
from mastline.plans import scenarios
from mastline.plans.base import BaseTables, Change
from mastline.plans import refresh as refresh_module
from mastline.plans.inputs import Content, content_of
from mastline.plans.refresh import Keys, TagTables, freshness
from mastline.plans.tagging import features_from_base, tags_from_base
from mastline.schemas import KEYS, REFERENCES, TAG_COLUMNS
from mastline.sources import fixtures as fx
from mastline.sources.store import in_ranges, publish, publish_clustered, range_bounds
from mastline.workspace import new_folder
from tests.records import expected_tags, frame, tags_by_customer

CUSTOMERS, SUBSCRIPTIONS, CHANGED = 100, 150, 10
CASES = ["delta", "payment", "care_close", "terminate", "aging", "catalog_fanout", "delete_customer"]


def stored(spark, base, name="base"):
    folder = new_folder(spark, name)
    return BaseTables(
        **{n: publish(getattr(base, n).coalesce(1), f"{folder}/{n}") for n in BaseTables.NAMES}
    )


@pytest.fixture(scope="module")
def base(spark):
    return stored(spark, fx.seed_base(spark, CUSTOMERS, SUBSCRIPTIONS))


@pytest.fixture(scope="module")
def keys(spark):
    return publish(fx.spread_keys(spark, CHANGED, CUSTOMERS), new_folder(spark, "keys"))


def test_seed_sizes_keys_and_references(spark):
    tables = fx.seed_tables(spark, CUSTOMERS, SUBSCRIPTIONS)
    sizes = {name: df.count() for name, df in tables.items()}
    assert (sizes["customer"], sizes["product_inventory"], sizes["party"]) == (100, 150, 250)
    assert (sizes["subscriber"], sizes["trouble_ticket"]) == (150, 5)
    for name in ("customer", "product_inventory", "party"):
        assert quality.check_key(tables[name], KEYS[name]).isEmpty()
    for child, column, parent in REFERENCES:
        missing = quality.check_reference(tables[child], column, tables[parent], KEYS[parent][0])
        assert missing.isEmpty(), (child, column)


@pytest.mark.parametrize("customers", [100, 7919, 15838])
def test_spread_keys_are_distinct(spark, customers):
    rows = [r.customer_id for r in fx.spread_keys(spark, 50, customers).collect()]
    assert len(set(rows)) == 50 and min(rows) >= 1 and max(rows) <= customers


def test_tags_match_the_rules(base):
    tags = tags_from_base(base)
    assert tags_by_customer(tags) == expected_tags(base)
    assert tags.columns == TAG_COLUMNS
    counts = quality.verify_counts(tags, "customer_id", base.customer).first()
    assert tuple(counts) == (100, 100, 100)
    audience = [r.customer_id for r in campaign_audience(tags, 5).collect()]
    assert audience == sorted(audience) and len(audience) == 5


def test_children_do_not_multiply(spark, base):
    """A second bill and ticket, unknown consent and status, orphans, a lost last line."""
    bills = frame(spark, "customer_bill", [(1000, 1, None, Decimal(50), True), (1001, 999, None, Decimal(70), True)])
    tickets = frame(spark, "trouble_ticket", [(1000, 1, "open", "high"), (1001, 1, "open", "high")])
    lines = base.product_inventory.filter("customer_id <> 3").unionByName(
        base.product_inventory.limit(1).withColumns(
            {"subscription_id": F.lit(1000).cast("long"), "offering_id": F.lit(77).cast("long")}
        )
    )
    customers = base.customer.withColumns(
        {
            "marketing_consent": F.when(F.col("customer_id") != 2, F.col("marketing_consent")),
            "status": F.when(F.col("customer_id") != 5, F.col("status")),
        }
    )
    edited = (
        base.with_table("customer_bill", base.customer_bill.unionByName(bills))
        .with_table("trouble_ticket", base.trouble_ticket.unionByName(tickets))
        .with_table("product_inventory", lines)
        .with_table("customer", customers)
    )
    assert tags_by_customer(tags_from_base(edited)) == expected_tags(edited)
    one = features_from_base(edited).filter("customer_id = 1").first()
    was = features_from_base(base).filter("customer_id = 1").first()
    assert one.monthly_spend == was.monthly_spend and one.overdue_amount == was.overdue_amount + 50
    assert one.open_complaints == 2
    tags = tags_by_customer(tags_from_base(edited))
    assert tags[2][-1] == 1 and tags[5][-1] == 1


def test_no_children_at_all(base):
    bare = base
    for name in ("product_inventory", "customer_bill", "trouble_ticket"):
        bare = bare.with_table(name, getattr(base, name).limit(0))
    tags = tags_from_base(bare)
    assert tags.count() == 100
    assert tag_counts(tags).first().asDict()["high_value"] == 0


def test_hot_offering_account_and_customer(spark, base):
    """A third of all lines, bills and tickets behind one key changes no result."""
    more = spark.range(2000).select((F.col("id") + 5000).alias("n"))
    lines = more.select(
        F.col("n").alias("subscription_id"),
        F.lit(7).cast("long").alias("customer_id"),
        F.lit(7).cast("long").alias("account_id"),
        F.col("n").alias("subscriber_id"),
        F.lit(1).cast("long").alias("offering_id"),
        F.lit("active").alias("status"),
        F.lit(1).cast("decimal(12,2)").alias("monthly_charge"),
        F.lit(None).cast("date").alias("contract_end"),
        F.lit(None).cast("boolean").alias("renewal_due"),
    )
    hot = base.with_table("product_inventory", base.product_inventory.unionByName(lines))
    row = features_from_base(hot).filter("customer_id = 7").first()
    was = features_from_base(base).filter("customer_id = 7").first()
    assert row.active_subscriptions == was.active_subscriptions + 2000
    assert row.monthly_spend == was.monthly_spend + 2000
    assert row.renewal_lines == was.renewal_lines


def test_change_sequence_keeps_refresh_equal_to_rebuild(spark, base, keys):
    tables = TagTables(spark, new_folder(spark, "sequence"))
    tables.build(base)
    state = base
    for case in CASES:
        lazily, changes = scenarios.run(case, state, keys, fx.AS_OF)
        before_tags, before = tables.read(), state
        affected = ch.affected_customers(changes, before, lazily).count()
        state = stored(spark, lazily, case)
        steps = {s.table_name: s for s in tables.refresh(before, state, changes)}
        full = tags_from_base(state)
        assert tuple(quality.verify_equal(tables.read(), full, TAG_COLUMNS).first()) == (0, 0), case
        assert tags_by_customer(full) == expected_tags(state), case
        if case in ("delta", "care_close"):
            assert steps["billing_features"].refresh_mode == "NO_DATA"
        if case == "catalog_fanout":
            assert steps["customer_features"].refresh_mode == "FULL" and affected > 50
        if case == "delete_customer":
            moved = ch.tag_transitions(full, before_tags).first()
            assert (moved.added_customers, moved.removed_customers) == (0, 10)
    counts = quality.verify_counts(tables.read(), "customer_id", state.customer).first()
    assert tuple(counts) == (90, 90, 90)
    size = tables.tables["customer_tags"].size()
    tables.tables["customer_tags"].compact()
    assert size == 90 and tables.read().count() == 90
    reopened = TagTables(spark, tables.path)
    assert tuple(quality.verify_equal(reopened.read(), full, TAG_COLUMNS).first()) == (0, 0)


def test_nothing_to_do(spark, base):
    tables = TagTables(spark, new_folder(spark, "noop"))
    tables.build(base)
    steps = tables.refresh(base, base, [])
    assert {s.refresh_mode for s in steps} == {"NO_DATA"}
    # a change that qualifies no rows is no change either
    aged, first = scenarios.aging(base, fx.AS_OF)
    again, second = scenarios.aging(aged, fx.AS_OF)
    assert [r.qualifying_source_rows for r in ch.qualifying_rows(second).collect()] == [0, 0]
    steps = tables.refresh(aged, again, second)
    assert {s.refresh_mode for s in steps} == {"NO_DATA"}
    history = tables.history()
    assert history.count() == 15
    committed = spark.createDataFrame([(1,)], "version long").select(
        "version", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("committed_at")
    )
    assert freshness(history, committed).first().seconds > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes(spark, base, seed):
    """Moved lines, bills and tickets, new and removed customers: refresh equals rebuild."""
    rng = random.Random(seed)
    pick = lambda salt, share: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "customer_id"), F.lit(100)) < share
    inv = base.product_inventory
    moved = inv.filter(pick("m", 15))
    after = moved.withColumns(
        {
            "customer_id": F.pmod(F.col("customer_id") * rng.choice([3, 7]), F.lit(CUSTOMERS)) + 1,
            "monthly_charge": (F.col("monthly_charge") * 2).cast("decimal(12,2)"),
        }
    )
    accounts = base.billing_account.filter(pick("a", 20))
    handed = accounts.withColumn("customer_id", F.pmod("customer_id", F.lit(CUSTOMERS)) + 1)
    gone = base.customer.filter(pick("g", 5))
    born = spark.range(200, 205).select(
        F.col("id").alias("customer_id"),
        F.col("id").alias("party_id"),
        F.lit("active").alias("status"),
        F.lit(None).cast("boolean").alias("marketing_consent"),
    )
    replace = lambda df, old, new, key: df.join(old, key, "left_anti").unionByName(new)
    state = stored(
        spark,
        base.with_table("product_inventory", replace(inv, moved, after, "subscription_id"))
        .with_table("billing_account", replace(base.billing_account, accounts, handed, "account_id"))
        .with_table("customer", replace(base.customer, gone, born, "customer_id")),
        "random",
    )
    changes = [
        Change("product_inventory", moved, after),
        Change("billing_account", accounts, handed),
        Change("customer", gone, born),
    ]
    tables = TagTables(spark, new_folder(spark, "random"), full_ratio=rng.choice([0.3, 2.0]))
    tables.build(base)
    tables.refresh(base, state, changes)
    found = quality.verify_equal(tables.read(), tags_from_base(state), TAG_COLUMNS).first()
    assert tuple(found) == (0, 0)


def test_lifecycle_flags_equal_a_day_of_aging(base):
    aged, _ = scenarios.aging(base, fx.AS_OF)
    dated = ch.with_lifecycle_flags(base, "2026-09-11")
    for name in ("product_inventory", "customer_bill"):
        a, b = getattr(aged, name), getattr(dated, name)
        assert tuple(quality.verify_equal(a, b, a.columns).first()) == (0, 0), name


def test_transitions_of_nothing(base):
    none = tags_from_base(base).limit(0)
    row = ch.tag_transitions(none, none).first()
    assert tuple(row) == (0, None, None)


def test_rows_without_a_customer_survive_a_refresh(spark, base):
    lost = F.col("customer_id") % 5 == 1
    without = lambda df: df.withColumn("customer_id", F.when(~lost, F.col("customer_id")))
    old = base.with_table("product_inventory", without(base.product_inventory))
    old = old.with_table("trouble_ticket", without(old.trouble_ticket))
    tables = TagTables(spark, new_folder(spark, "tags"), full_ratio=1e9)
    tables.build(old)
    before = old.product_inventory
    raised = before.withColumn("monthly_charge", (F.col("monthly_charge") + 1).cast("decimal(12,2)"))
    picked = F.col("subscription_id") % 3 == 0
    new = old.with_table("product_inventory", raised.filter(picked).unionByName(before.filter(~picked)))
    tables.refresh(old, new, [Change("product_inventory", before.filter(picked), raised.filter(picked))])
    rebuilt = TagTables(spark, new_folder(spark, "tags"))
    rebuilt.build(new)
    for name in tables.tables:
        both = quality.verify_equal(tables.read(name), rebuilt.read(name), rebuilt.read(name).columns)
        assert tuple(both.first()) == (0, 0), name
    assert tables.read("subscription_features").filter("customer_id IS NULL").count() == 1


def scanned_rows(df):
    """Rows that came out of the scans of a query without a shuffle, by its own metrics."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_few_keys_are_read_by_the_page(spark):
    """Clustered tables: a hundred of 40,000 customers take a tenth of the rows at most."""
    customers = 40_000
    folder = new_folder(spark, "clustered")
    seed = fx.seed_base(spark, customers, customers * 3 // 2)
    base = BaseTables(
        **{
            name: publish_clustered(getattr(seed, name), f"{folder}/{name}", key)
            for name, key in [
                *((n, "customer_id") for n in ("customer", "billing_account", "product_inventory", "trouble_ticket")),
                ("customer_bill", "account_id"), ("product_offering", "offering_id"),
            ]
        }
    )
    tables = TagTables(spark, f"{folder}/tags")
    tables.build(base)
    few = Keys(spark.createDataFrame([(20_000 + i,) for i in range(100)], "customer_id long"), 100)
    for df in (base.product_inventory, base.customer, tables.read("customer_features")):
        everything = df.count()
        found = few.cut(df, ["customer_id"])
        assert scanned_rows(found) <= everything / 10
        assert found.count() == df.filter("customer_id BETWEEN 20000 AND 20099").count() >= 100


@pytest.mark.parametrize("named", [0, 10_000])
def test_named_and_joined_keys_agree(spark, base, keys, monkeypatch, named):
    monkeypatch.setattr(refresh_module, "NAMED_KEYS", named)
    tables = TagTables(spark, new_folder(spark, "named"), full_ratio=2.0)
    tables.build(base)
    state, changes = scenarios.payment(base, keys)
    state = stored(spark, state, "named-state")
    tables.refresh(base, state, changes)
    assert tuple(quality.verify_equal(tables.read(), tags_from_base(state), TAG_COLUMNS).first()) == (0, 0)


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("case", ["payment", "terminate", "delete_customer"])
def test_many_changed_keys_are_never_broadcast(spark, base, keys, monkeypatch, case):
    """However small their files: here any number of keys counts as many."""
    monkeypatch.setattr(refresh_module, "NAMED_KEYS", 0)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    tables = TagTables(spark, new_folder(spark, "many"), full_ratio=2.0)
    tables.build(base)
    state, changes = scenarios.run(case, base, keys, fx.AS_OF)
    state = stored(spark, state, "many-state")
    tables.refresh(base, state, changes)
    assert not any(broadcasts(table.read()) for table in tables.tables.values())
    assert tuple(quality.verify_equal(tables.read(), tags_from_base(state), TAG_COLUMNS).first()) == (0, 0)


def test_rows_of_many_keys_are_sorted(spark, base, keys):
    many = Keys(keys, joins.BROADCAST_ROWS + 1)
    lines = many.cut(base.product_inventory, ["subscription_id"])
    customers = many.cut(base.customer, [])
    assert not broadcasts(lines) and not broadcasts(customers)
    assert customers.count() == CHANGED
    wanted = {row[0] for row in keys.collect()}
    expected = [r for r in base.product_inventory.collect() if r.customer_id in wanted]
    assert lines.count() == len(expected) > 0


def test_keys_of_a_change_are_not_broadcast(spark, base, keys):
    """They grow with the table that changes, and lie in small files."""
    state, changes = scenarios.delta(base, keys)
    assert not broadcasts(state.customer)
    paid, bills = scenarios.payment(base, keys)
    bills = [Change(c.table, publish(c.before, new_folder(spark, "bills"))) for c in bills]
    found = ch.affected_by_feature(bills, base, paid)["billing_features"]
    assert not broadcasts(found) and found.count() > 0


def test_a_null_customer_is_named_too(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "customer_id long, x string")
    keys = Keys(spark.createDataFrame([(None,), (1,)], "customer_id long"), 2)
    assert {r.x for r in keys.cut(df, ["x"]).collect()} == {"a", "b"}


def test_a_hot_key_spreads_over_files(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep small files apart
    try:
        back = publish_clustered(df, new_folder(spark, "hot"), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = back.filter("k = 7").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 1 and back.count() == 4000


@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_ranges_of_a_key(spark, parts):
    df = spark.range(1000).select((F.col("id") * 3 - 500).alias("k")).unionAll(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    bounds = range_bounds(df, "k", parts)
    assert len(bounds) == parts - 1
    dealt = in_ranges(df, "k", bounds).withColumn("p", F.spark_partition_id()).collect()
    assert len(dealt) == 1001
    for row in dealt:
        assert row.p == (0 if row.k is None else sum(b <= row.k for b in bounds))
    assert range_bounds(df.where("false"), "k", parts) == []


def modes(steps):
    return {s.table_name: s.refresh_mode for s in steps}


FULL_BILLING = {
    "subscription_features": "NO_DATA", "billing_features": "FULL", "care_features": "NO_DATA",
    "customer_features": "FULL", "customer_tags": "FULL",
}


def test_a_replaced_input_is_noticed(spark, base, keys):
    """Reloaded with other rows, or with one row changed and nothing declared."""
    tables = TagTables(spark, new_folder(spark, "replaced"), watched=True)
    tables.build(base)
    state = base
    one = F.when(F.col("bill_id") == 7, 80).otherwise(F.col("outstanding_amount")).cast("decimal(12,2)")
    for name, bills in (
        ("reloaded", base.customer_bill.filter("bill_id % 3 = 0")),
        ("one", base.customer_bill.withColumn("outstanding_amount", one)),
    ):
        state = state.with_table("customer_bill", publish(bills, new_folder(spark, name)))
        assert modes(tables.refresh(state, state, [])) == FULL_BILLING
        assert tuple(quality.verify_equal(tables.read(), tags_from_base(state), TAG_COLUMNS).first()) == (0, 0)
        # known from now on
        assert set(modes(tables.refresh(state, state, [])).values()) == {"NO_DATA"}
    # a new state that differs without a declared change
    later = state.with_table("customer_bill", publish(base.customer_bill, new_folder(spark, "later")))
    assert modes(tables.refresh(state, later, [])) == FULL_BILLING


def test_an_input_written_anew_is_not_replaced(spark, base, keys):
    tables = TagTables(spark, new_folder(spark, "anew"), watched=True)
    tables.build(base)
    again = stored(spark, base, "again")
    assert set(modes(tables.refresh(again, again, [])).values()) == {"NO_DATA"}
    # declared changes keep the known content up to date, without reading the table
    state, changes = scenarios.delta(again, keys)
    state = stored(spark, state, "again-delta")
    steps = modes(tables.refresh(again, state, changes))
    assert steps["customer_features"] == "INCREMENTAL" and steps["billing_features"] == "NO_DATA"
    moved = stored(spark, state, "again-moved")
    assert set(modes(tables.refresh(moved, moved, [])).values()) == {"NO_DATA"}
    reopened = TagTables(spark, tables.path, watched=True)
    assert set(modes(reopened.refresh(moved, moved, [])).values()) == {"NO_DATA"}


def test_content_tells_rows_apart(spark):
    one = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert content_of(one) == content_of(one.select("b", "a").select("b", "a"))
    assert content_of(one) != content_of(one.select(F.col("b").alias("a"), F.col("a").alias("b")).limit(1))
    assert content_of(one.limit(1)) != content_of(spark.createDataFrame([(None, 1)], "a int, b int"))
    assert content_of(one.where("false")) == Content(0, 0)
