"""Run telemetry: one row per run, summaries, cost scenarios and storage."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from mastline.functions.usage import seconds_between
from mastline.operators.joins import first_after, spread_join
from mastline.sources import run_documents

# fixed values: job categories, counters of a job profile
CATEGORIES = ["incremental", "full", "source_change", "consumption"]
COUNTERS = [
    "inputRowCount",
    "inputBytes",
    "inputDeltaBytes",
    "inputDiskBytes",
    "inputCacheBytes",
    "outputRowCount",
    "outputBytes",
    "spillingBytes",
]
METRICS = [*COUNTERS, "cpu_wall_seconds", "job_meter_cru"]
DERIVED_TYPES = ["DYNAMIC_TABLE", "MATERIALIZED_VIEW"]
STORAGE_RATE = 0.025


def profile_metrics(profiles: DataFrame) -> DataFrame:
    """Counters and meters of job profile documents; what is absent stays NULL.

    Input columns: run_id, label, stats (map of counter text) and meter (array of structs
    key, unit, value). CPU time arrives in nanoseconds.
    """

    def metered(unit: str) -> Column:
        readings = F.filter(
            "meter", lambda m: (m["key"] == "cpu_wall_time") & (m["unit"] == unit)
        )
        total = F.aggregate(
            readings, F.lit(0.0), lambda acc, m: acc + m["value"].cast("double")
        )
        return F.when(F.size(readings) > 0, total)

    return profiles.select(
        "run_id",
        "label",
        *[F.try_element_at("stats", F.lit(name)).cast("bigint").alias(name) for name in COUNTERS],
        (metered("ns") / 1e9).alias("cpu_wall_seconds"),
        metered("cru").alias("job_meter_cru"),
    )


def _sum_if_complete(value: Column, member: Column) -> Column:
    """Sum over the members, or NULL as soon as one of them has no value. No members: 0."""
    complete = F.count_if(member & value.isNull()) == 0
    return F.when(complete, F.coalesce(F.sum(F.when(member, value)), F.lit(0)))


def _last_seen(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key of documents collected again and again: that of the last snapshot.

    Without a ``snapshot`` column, or within one, the latest end and then a fingerprint
    decide, so that reruns agree.
    """
    order = [name for name in ("snapshot", "end_time") if name in df.columns]
    last = F.max_by(F.struct(*df.columns), F.struct(*order, F.xxhash64(*df.columns)))
    return df.groupBy(*key).agg(last.alias("_last")).select("_last.*").drop("snapshot")


def run_rollup(
    manifest: DataFrame, history: DataFrame, jobs: DataFrame, profiles: DataFrame
) -> DataFrame:
    """One row per run from its statements, refresh history, jobs and job profiles.

    manifest: run_id, seq, label, category, job_id, ok; history: run_id, job_id,
    refresh_mode, duration_s, end_time; jobs: job_id, execution_s, end_time; profiles as
    given by ``profile_metrics``. The last three may hold a document several times, with
    the number of its ``snapshot``; the last one counts. A refresh takes its time from the
    history, any other statement from its job. Statement totals are kept in one row per
    run, so a run of any length is aggregated in parts; only the refresh modes, which the
    result lists in statement order, are gathered.
    """
    history = _last_seen(history, ["run_id", "job_id"])
    jobs = _last_seen(jobs, ["job_id"])
    profiles = _last_seen(profiles, ["run_id", "label"])
    lookup = (
        manifest.join(
            history.select(
                "run_id",
                "job_id",
                "refresh_mode",
                F.col("duration_s").alias("_history_s"),
                F.col("end_time").alias("_history_end"),
                F.lit(True).alias("_in_history"),
            ),
            ["run_id", "job_id"],
            "left",
        )
        .join(
            jobs.select(
                "job_id",
                F.col("execution_s").alias("_job_s"),
                F.col("end_time").alias("_job_end"),
            ),
            "job_id",
            "left",
        )
        .join(profiles.withColumn("_profiled", F.lit(True)), ["run_id", "label"], "left")
    )
    refreshed = F.col("_in_history") & (F.col("category") == "incremental")
    timed = lookup.withColumn(
        "_seconds", F.when(refreshed, F.col("_history_s")).otherwise(F.col("_job_s"))
    )
    outputs: list[Column] = []
    for category in CATEGORIES:
        member = F.col("category") == category
        outputs += [
            _sum_if_complete(F.col("_seconds"), member).alias(f"{category}_server_seconds"),
            F.count_if(member & F.col("_profiled")).alias(f"{category}_profile_count"),
            F.count_if(member).alias(f"{category}_job_count"),
        ]
        outputs += [
            _sum_if_complete(F.col(metric), member).alias(f"{category}_{metric}")
            for metric in METRICS
        ]
    mode = F.concat(F.regexp_replace("label", "^refresh_", ""), F.lit(":"), "refresh_mode")
    listed = F.when(refreshed & mode.isNotNull(), F.struct("seq", mode.alias("mode")))
    outputs.append(F.sort_array(F.collect_list(listed)).alias("_modes"))
    last_change = F.when(F.col("category") == "source_change", F.col("seq"))
    outputs += [
        F.max_by("_job_end", last_change).alias("_committed"),
        F.max(
            F.when(F.col("label") == "refresh_customer_tags", F.col("_history_end"))
        ).alias("_ready"),
        F.bool_and("ok").alias("all_statements_ok"),
    ]
    rolled = timed.groupBy("run_id").agg(*outputs)
    hidden = [c for c in rolled.columns if c.startswith("_")]
    return rolled.withColumns(
        {
            "refresh_modes": F.array_join(F.col("_modes")["mode"], ";"),
            "last_source_commit_to_tags_seconds": (
                F.unix_micros(F.col("_ready").cast("timestamp"))
                - F.unix_micros(F.col("_committed").cast("timestamp"))
            )
            / 1e6,
        }
    ).drop(*hidden)


#: metrics that are summarised per scenario, for both methods
SUMMARY_METRICS = [
    f"{method}_{metric}"
    for metric in (
        "server_seconds", "cpu_wall_seconds", "inputRowCount", "inputBytes", "outputBytes",
        "job_meter_cru",
    )
    for method in ("incremental", "full")
]
_DETAILS = [
    "customers", "subscriptions", "selected_customers", "affected_customers", "tag_transitions",
    "verify", "verify_reverse", "verify_counts", "changed_source_rows",
]


def run_report(
    documents: DataFrame, named: Sequence[str] = (), unnamed: Sequence[str] = ()
) -> DataFrame:
    """One row per verified run, from its documents (path, content).

    A run counts if its manifest has a ``verify_counts`` statement, its name begins with one
    of ``named`` (if there are any) and ends with none of ``unnamed``. Plan and result
    documents that were not collected leave their columns NULL.
    """
    manifest = run_documents.manifests(documents)
    wanted = F.lit(True)
    if named:
        wanted = reduce(or_, (F.col("run_id").startswith(n) for n in named))
    for suffix in unnamed:
        wanted = wanted & ~F.col("run_id").endswith(suffix)
    verified = manifest.filter((F.col("label") == "verify_counts") & wanted).select("run_id").distinct()
    runs = run_rollup(
        manifest.join(verified, "run_id", "left_semi"),
        run_documents.histories(documents),
        run_documents.jobs(documents),
        profile_metrics(run_documents.profiles(documents)),
    )
    found = runs.join(run_documents.plans(documents), "run_id", "left").join(
        run_documents.results(documents), "run_id", "left"
    )
    found = found.withColumn("changed_source_rows", F.coalesce("changed_source_rows", F.lit(0)))
    return found.select("run_id", *_DETAILS, *(c for c in runs.columns if c != "run_id"))


def scenarios_of(runs: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """``runs`` with ``scenario``, a row for every prefix that a run's name begins with."""
    matching = F.filter(
        F.array(*(F.lit(p) for p in prefixes)), lambda p: F.col("run_id").startswith(p)
    )
    return runs.withColumn("scenario", F.explode(matching))


# the sketch is off by at most this share of the rows of a group; brackets are five times wider
_RANK_ERROR = 1e-5
_MARGIN = 5 * _RANK_ERROR
# a bracket is cut into so many buckets of equal width
_BUCKETS = 1000


def summarise(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n, exact median, nearest-rank p95, min and max per group; see ``summarise_metrics``."""
    return summarise_metrics(df, group, [value]).drop("metric")


def summarise_metrics(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """n, exact median, nearest-rank p95, min and max per group and metric, in three scans.

    The metrics are columns of numbers; the result has a row for each group and ``metric``
    that has a value, NULL values do not count. A NULL group is a group like any other:
    groups are compared as structs.

    No group is gathered or ranked in one place. A sketch brackets the wanted ranks, values
    outside the brackets are only counted, brackets are cut into buckets of equal width. The
    bucket totals, at most a few thousand a group, tell which bucket holds a rank, and only the
    values of that bucket are put in order, equal ones as one row. Should a rank ever fall
    outside its bracket, the query fails rather than answer wrongly.
    """
    listed = F.array(
        *(F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics)
    )
    present = (
        df.select(F.struct(*group).alias("_g"), F.explode(listed).alias("_x"))
        .select("_g", F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
        .filter("_v IS NOT NULL")
        .select(F.struct("_g", "_m").alias("_k"), "_v")
    )
    brackets = [p + side * _MARGIN for p in (0.5, 0.95) for side in (-1, 1)]
    sketch = present.groupBy("_k").agg(
        F.percentile_approx("_v", brackets, int(1 / _RANK_ERROR)).alias("_b"),
        F.count("*").alias("n"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    # equal rows of a hot group are told apart by where they were read
    spread = present.withColumn("_row", F.monotonically_increasing_id())
    v, b = F.col("_v"), F.col("_b")
    zone = (
        F.when(v < b[0], 0).when(v <= b[1], 1).when(v < b[2], 2).when(v <= b[3], 3).otherwise(4)
    )
    low = F.when(F.col("_zone") == 1, b[0]).otherwise(b[2])
    width = F.when(F.col("_zone") == 1, b[1]).otherwise(b[3]) - low
    bucket = F.when(
        F.col("_zone").isin(1, 3) & (width > 0) & (width < float("inf")),
        F.floor((v - low) / width * _BUCKETS),
    ).otherwise(F.lit(0))
    dealt = (
        spread_join(spread, sketch.select("_k", "_b"), ["_k"], "inner", spread=["_row"])
        .withColumn("_zone", zone)
        .withColumn("_bucket", bucket.cast("int"))
    )
    before = Window.partitionBy("_k").orderBy("_zone", "_bucket")
    totals = (
        dealt.groupBy("_k", "_zone", "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(before))
    )
    n = F.col("n")
    ranks = F.array(
        F.floor((n + 1) / F.lit(2)), F.floor((n + 2) / F.lit(2)), F.ceil(n * F.lit(0.95))
    )
    asked = sketch.select("_k", F.posexplode(ranks).alias("_which", "_rank"))
    places = (
        totals.join(asked, "_k")
        .filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        .filter(F.col("_zone").isin(1, 3))
        .select(
            "_k",
            "_zone",
            "_bucket",
            "_which",
            (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_inside"),
        )
    )
    inside = ["_k", "_zone", "_bucket"]
    within = Window.partitionBy(*inside).orderBy("_v")
    counted = (
        spread_join(dealt, places.select(*inside).distinct(), inside, "inner", spread=["_row"])
        .groupBy(*inside, "_v")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(within))
    )
    at = lambda which: F.max(F.when(F.col("_which") == which, F.col("_v")))
    exact = (
        counted.join(places, inside)
        .filter((F.col("_inside") <= F.col("_upto")) & (F.col("_inside") > F.col("_upto") - F.col("_n")))
        .groupBy("_k")
        .agg(((at(0) + at(1)) / 2).alias("median"), at(2).alias("p95_nearest_rank"))
    )
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    return sketch.join(exact, "_k", "left").select(
        *[F.col("_k._g")[name].alias(name) for name in group],
        F.col("_k._m").alias("metric"),
        "n",
        F.coalesce("median", missed).alias("median"),
        F.coalesce("p95_nearest_rank", missed).alias("p95_nearest_rank"),
        "min",
        "max",
    )


def cost_scenarios(df: DataFrame) -> DataFrame:
    """What a refresh cadence would cost; bad inputs fail the query.

    Input columns: rate, cru, active_seconds, idle_seconds, cadence_minutes, days. A cycle
    is charged for at least a minute and at most its interval. An estimate, not a bill.
    """
    inputs = ["rate", "cru", "active_seconds", "idle_seconds", "cadence_minutes", "days"]
    c = F.col
    bad = F.lit(False)
    for name in inputs:
        bad = bad | c(name).isNull() | F.isnan(name) | (F.abs(name) == float("inf"))
    for name in ("rate", "active_seconds", "idle_seconds"):
        bad = bad | (c(name) < 0)
    for name in ("cru", "cadence_minutes", "days"):
        bad = bad | (c(name) <= 0)
    checked = df.withColumns({name: c(name).cast("double") for name in inputs}).withColumn(
        "rate", F.when(bad, F.raise_error(F.lit("invalid cost inputs"))).otherwise(c("rate"))
    )
    interval = c("cadence_minutes") * 60
    seconds = F.least(interval, F.greatest(F.lit(60.0), c("active_seconds") + c("idle_seconds")))
    runs = c("days") * 86400 / interval
    return checked.select(
        *df.columns,
        F.lit("ILLUSTRATIVE_NOT_MEASURED").alias("status"),
        runs.alias("runs"),
        (c("rate") * c("cru") * c("active_seconds") / 3600).alias("active_work_proxy_per_cycle"),
        (c("rate") * c("cru") * seconds / 3600).alias("vc_cost_per_cycle"),
        (c("rate") * c("cru") * seconds * runs / 3600).alias("vc_cost_period"),
        (c("rate") * c("cru") * c("days") * 24).alias("always_on_period"),
        (c("active_seconds") < interval).alias("stable_cadence"),
    )


#: the price that refreshes are charged by, and the unit it must be in
COMPUTE_SKU, COMPUTE_UNIT = "vc_gp_event", "CRU*hour"
CYCLES = 2880


def cost_projection(summary: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of every scenario and method from its median server seconds and the price rows.

    ``summary`` has scenario, metric and median, as from ``summarise_metrics``; ``prices``
    has sku_code, measurements_unit, price_rate and discount_rate. One unit of compute, an
    idle tail of a minute, ``CYCLES`` cycles in 30 days. A price in another unit, several
    different ones, or none, fail the query.
    """
    rate = (
        prices.filter(F.col("sku_code") == COMPUTE_SKU)
        .groupBy("sku_code")
        .agg(
            F.collect_set(F.struct("measurements_unit", "price_rate", "discount_rate")).alias("p")
        )
        .select("sku_code", F.col("p")[0].alias("p"), F.size("p").alias("different"))
    )
    method = F.regexp_extract("metric", "^(incremental|full)_server_seconds$", 1)
    priced = (
        summary.withColumn("method", method)
        .filter("method <> ''")
        .withColumn("sku_code", F.lit(COMPUTE_SKU))
        .join(rate, "sku_code", "left")
    )
    wrong = lambda text: F.raise_error(F.lit(text)).cast("double")
    charged = (
        F.when(F.col("p").isNull(), wrong("no compute price"))
        .when(F.col("different") > 1, wrong("several compute prices"))
        .when(F.col("p.measurements_unit") != COMPUTE_UNIT, wrong("unknown compute billing unit"))
        .otherwise(F.col("p.price_rate") * F.col("p.discount_rate"))
    )
    seconds = F.col("measured_server_seconds_median")
    cycle = F.greatest(F.lit(60.0), seconds + 60) * F.col("usd_per_cru_hour") / 3600
    return priced.select(
        "scenario",
        "method",
        F.col("median").alias("measured_server_seconds_median"),
        charged.alias("usd_per_cru_hour"),
    ).withColumns(
        {
            "busy_capacity_proxy_usd": seconds * F.col("usd_per_cru_hour") / 3600,
            "modeled_vc_usd_per_cycle": cycle,
            "modeled_vc_usd_per_30_days": cycle * CYCLES,
        }
    )


def storage_rollup(tables: DataFrame) -> DataFrame:
    """Bytes and monthly cost per schema, all objects and derived ones."""
    per_schema = tables.groupBy("table_schema").agg(
        F.sum("bytes").alias("all_object_bytes"),
        F.sum(F.when(F.col("table_type").isin(DERIVED_TYPES), F.col("bytes")).otherwise(0)).alias(
            "derived_bytes"
        ),
    )
    month = lambda name: F.col(name) / F.lit(2.0**30) * F.lit(STORAGE_RATE)
    return per_schema.withColumns(
        {
            "all_object_month_cost": month("all_object_bytes"),
            "derived_month_cost": month("derived_bytes"),
        }
    )


def freshness_of(commits: DataFrame, refreshes: DataFrame) -> DataFrame:
    """Every source commit with the first refresh of its source that started after it.

    Commits need ``source`` and ``committed_at``, refreshes ``source``, ``started_at`` and
    ``finished_at``. ``seconds`` runs from the commit to the end of that refresh; it is NULL
    while no refresh has started, or the one that has is not finished.
    """
    pairs = first_after(
        commits,
        refreshes.select("source", "started_at", "finished_at"),
        "committed_at",
        "started_at",
        ["source"],
    )
    return pairs.withColumn(
        "seconds", seconds_between(F.col("committed_at"), F.col("finished_at"))
    )
