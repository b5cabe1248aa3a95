"""Time the headline queries and the refresh against a full rebuild; print one JSON line.

The bss_* entries repeat the published fixture (100 changed customers) at the published
sizes: rebuild, refresh, and a cycle without changes.
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from mastline.operators.quality import verify_equal  # noqa: E402
from mastline.plans import scenarios  # noqa: E402
from mastline.plans.base import BaseTables, Change  # noqa: E402
from mastline.plans.refresh import TagTables  # noqa: E402
from mastline.plans.tagging import tags_from_base  # noqa: E402
from mastline.registered import QUERIES  # noqa: E402
from mastline.schemas import TAG_COLUMNS  # noqa: E402
from mastline.session import configured  # noqa: E402
from mastline.sources import fixtures as fx  # noqa: E402
from mastline.sources.store import publish, publish_clustered  # noqa: E402
from mastline.workspace import new_folder  # noqa: E402

HEADLINE = [
    "latest_sessions",
    "hourly_cell_usage",
    "subscriber_daily",
    "late_arrival_audit",
    "semantic_top_cells",
    "semantic_hour_reliability",
    "customer_features",
    "customer_tags_full",
    "audience",
    "change_delta",
    "metric_summary",
    "run_rollup",
    "incremental_delta",
    "stream_latest",
    "stream_hourly",
]
# runs that write tables or streams are timed once, the others take the better of two
ONCE = {"incremental_delta", "stream_latest", "stream_hourly"}
SIZES = {"100k": 100_000, "1m": 1_000_000}
CHANGED = 100
CYCLES = 5  # the first one warms up


def drain(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


CLUSTERED_BY = {"customer_bill": "account_id", "product_offering": "offering_id"}


def kept(base: BaseTables, folder: str, names=BaseTables.NAMES) -> dict[str, DataFrame]:
    """Tables as the source keeps them: in the order of the customer, bills of the account."""
    return {
        name: publish_clustered(
            getattr(base, name), f"{folder}/{name}", CLUSTERED_BY.get(name, "customer_id")
        )
        for name in names
    }


def tagging_cycles(spark: SparkSession, label: str, customers: int) -> dict[str, float]:
    """Medians over repeated cycles of the delta change on stored tables."""
    folder = new_folder(spark, f"bench-{label}")
    base = BaseTables(**kept(fx.seed_base(spark, customers, customers * 3 // 2), f"{folder}/base"))
    keys = publish(fx.spread_keys(spark, CHANGED, customers), f"{folder}/keys")
    tables = TagTables(spark, f"{folder}/tags")
    out = {f"bss_build_{label}": timed(lambda: tables.build(base))}
    full, refreshed, idle = [], [], []
    for cycle in range(CYCLES):
        lazily, changes = scenarios.delta(base, keys)
        changed = base
        for name, table in kept(lazily, f"{folder}/{cycle}", [c.table for c in changes]).items():
            changed = changed.with_table(name, table)
        changes = [
            Change(
                c.table,
                publish(c.before, f"{folder}/{cycle}/before-{c.table}"),
                publish(c.after, f"{folder}/{cycle}/after-{c.table}"),
            )
            for c in changes
        ]
        old, base = base, changed
        refreshed.append(timed(lambda: tables.refresh(old, base, changes)))
        full.append(timed(lambda: publish(tags_from_base(base), f"{folder}/full-{cycle}")))
        idle.append(timed(lambda: tables.refresh(base, base, [])))
    out[f"bss_refresh_delta_{label}"] = statistics.median(refreshed[1:])
    out[f"bss_full_rebuild_{label}"] = statistics.median(full[1:])
    out[f"bss_refresh_noop_{label}"] = statistics.median(idle[1:])
    check = verify_equal(tables.read(), tags_from_base(base), TAG_COLUMNS).first()
    if check.mismatches or check.reverse_mismatches:
        raise AssertionError(f"refresh and rebuild differ at {label}: {check}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configured(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["batch_type_counts"](spark, sf_dir))  # start-up is not a query
    results = {}
    for name in HEADLINE:
        runs = 1 if name in ONCE else 2
        results[name] = min(timed(lambda: drain(QUERIES[name](spark, sf_dir))) for _ in range(runs))
        print(f"{name} {results[name]:.2f}s", file=sys.stderr, flush=True)
    for label, customers in SIZES.items():
        results.update(tagging_cycles(spark, label, customers))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in results.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
