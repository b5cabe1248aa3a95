"""Run documents as files and archives, the report over them, summaries and costs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from mastline.operators import telemetry
from mastline.sources import run_documents, run_fixtures


def profile(stats, meter=()):
    summary = {"stats": {"inputOutputStats": stats}, "meter": {"measurements": list(meter)}}
    return {"data": {"jobSummary": summary, "stageSummary": {"ignored": {"inputBytes": "999"}}}}


def statement(label, category, job, ok=True):
    return {"label": label, "category": category, "job_ids": [job, "later"], "ok": ok}


def run_files(name, verified=True):
    manifest = [
        statement("change_0", "source_change", f"{name}-1"),
        statement("refresh_customer_tags", "incremental", f"{name}-2"),
        statement("full_recompute", "full", f"{name}-3", ok=verified),
        statement("verify_counts" if verified else "verify", "validation", f"{name}-4"),
    ]
    return {
        f"{name}/manifest.json": manifest,
        f"{name}/plan.json": {"config": {"customers": 100, "subscriptions": 150, "changed": 10}},
        f"{name}/020_history.json": {
            "rows": [{"job_id": f"{name}-2", "refresh_mode": "INCREMENTAL", "duration": [0, 1, 1423000000], "end_time": "2026-09-10T00:00:30"}]
        },
        f"{name}/021_recent_jobs.json": {
            "rows": [
                {"job_id": f"{name}-1", "execution_time": 2.5, "end_time": "2026-09-10T00:00:10"},
                {"job_id": f"{name}-3", "execution_time": [0, 0, 4000000000], "end_time": "2026-09-10T00:01:00"},
            ]
        },
        f"{name}/005_affected_customers.json": {"rows": [{"affected_customers": 7}, {"affected_customers": 8}]},
        f"{name}/006_tag_transitions.json": {"rows": []},
        f"{name}/046_tag_transitions.json": {"rows": [{"flag_transitions": 5}]},
        f"{name}/007_verify.json": {"rows": [{"mismatches": 0}]},
        f"{name}/009_verify_counts.json": {"rows": [{"customers": 100}]},
        f"{name}/010_qualifying_rows_customer.json": {"rows": [{"qualifying_source_rows": 3}]},
        f"{name}/011_qualifying_rows_bill.json": {"rows": [{"qualifying_source_rows": 4}]},
        f"profiles_{name}/002_refresh_customer_tags.json": profile(
            {"inputRowCount": "11"}, [{"key": "cpu_wall_time", "unit": "ns", "value": "2500000"}]
        ),
    }


def documents(spark, files):
    rows = [(f"any/where/{path}", json.dumps(content, indent=1)) for path, content in files.items()]
    return spark.createDataFrame(rows, run_documents.ARCHIVE)


def test_report_of_files_and_archive(spark, tmp_path):
    files = {
        **run_files("measured2_a"), **run_files("measured2_b", verified=False),
        **run_files("measured2_c_init"), **run_files("other_d"),
    }
    for path, content in files.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(json.dumps(content, indent=1))
    read = run_documents.scan_files(spark, f"{tmp_path}/*/*.json")
    run_documents.write_archive(read, f"{tmp_path}/archive")
    for docs in (read, run_documents.scan_archive(spark, f"{tmp_path}/archive")):
        rows = telemetry.run_report(docs, ("measured2_",), ("init",)).collect()
        assert [r.run_id for r in rows] == ["measured2_a"]
    run = rows[0]
    assert (run.customers, run.subscriptions, run.selected_customers) == (100, 150, 10)
    assert (run.affected_customers, run.tag_transitions, run.verify) == (7, None, 0)
    assert (run.verify_reverse, run.verify_counts, run.changed_source_rows) == (None, 100, 7)
    assert run.incremental_server_seconds == 86400 + 1.423
    assert (run.source_change_server_seconds, run.full_server_seconds) == (2.5, 4.0)
    assert run.incremental_inputRowCount == 11 and run.incremental_cpu_wall_seconds == 0.0025
    assert run.refresh_modes == "customer_tags:INCREMENTAL"
    assert run.last_source_commit_to_tags_seconds == 20.0 and run.all_statements_ok
    assert run.asDict().keys() >= {f"full_{m}" for m in telemetry.METRICS}


def test_report_without_results_or_documents(spark):
    files = {p: c for p, c in run_files("r").items() if p in ("r/manifest.json",)}
    run = telemetry.run_report(documents(spark, files)).first()
    assert run.customers is None and run.verify_counts is None and run.changed_source_rows == 0
    assert run.incremental_server_seconds is None and run.incremental_job_count == 1
    assert telemetry.run_report(documents(spark, files).where("false")).count() == 0


def test_paths_and_durations(spark):
    rows = [("a/run_1/003_refresh_x.json", ""), ("run_2/manifest.json", ""), ("run_3/12_34.json", "")]
    found = run_documents.located(spark.createDataFrame(rows, run_documents.ARCHIVE)).collect()
    assert [(r.run_id, r.sequence, r.label) for r in found] == [
        ("run_1", 3, "refresh_x"), ("run_2", None, "manifest"), ("run_3", 12, "34"),
    ]
    texts = spark.createDataFrame([("[0, 0, 1423000000]",), ("[0,1,0]",), ("2.5",), (None,)], "d string")
    seconds = texts.select(run_documents.duration_seconds(F.col("d")).alias("s"))
    assert [r.s for r in seconds.collect()] == [1.423, 86400.0, 2.5, None]
    months = spark.createDataFrame([("[1, 0, 0]",)], "d string")
    with pytest.raises(Exception, match="months"):
        months.select(run_documents.duration_seconds(F.col("d"))).collect()


def test_a_broken_document_fails(spark):
    broken = spark.createDataFrame([("r/manifest.json", "[{")], run_documents.ARCHIVE)
    with pytest.raises(Exception, match="MALFORMED"):
        run_documents.manifests(broken).collect()


def test_metrics_of_any_skew(spark):
    """A group full of one value, one with most rows, unknown values, infinities."""
    rows = [("one", 5.0, None), (None, 1.0, 2.0), (None, 4.0, 2.0), ("none", None, None)]
    rows += [("flat", 4.0, float(i % 3)) for i in range(3000)]
    rows += [("hot", float((i * 7919) % 60_007) ** 3, -float(i)) for i in range(60_007)]
    rows += [("wide", float("inf") if i % 3 else -float("inf"), 1e300 * (i % 7 - 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    found = {(r.g, r.metric): r for r in telemetry.summarise_metrics(df, ["g"], ["a", "b"]).collect()}
    values = {}
    for g, a, b in rows:
        for metric, v in (("a", a), ("b", b)):
            if v is not None:
                values.setdefault((g, metric), []).append(v)
    assert found.keys() == values.keys()
    for key, known in values.items():
        known.sort()
        n, row = len(known), found[key]
        middle = (known[(n - 1) // 2] + known[n // 2]) / 2
        assert (row.n, row.min, row.max) == (n, known[0], known[-1])
        assert row.median == middle or (math.isnan(row.median) and math.isnan(middle)), key
        assert row.p95_nearest_rank == known[math.ceil(0.95 * n) - 1], key


def test_no_group_is_ranked_in_one_task(spark):
    """Windows run over bucket totals and over the values of one bucket, never over a group."""
    df = spark.range(1000).selectExpr("'g' AS g", "CAST(id AS DOUBLE) AS v")
    plan = telemetry.summarise_metrics(df, ["g"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in line for line in windows)


def test_scenarios(spark):
    runs = spark.createDataFrame([("ab1",), ("a2",), ("c",)], "run_id string")
    found = {(r.run_id, r.scenario) for r in telemetry.scenarios_of(runs, ["a", "ab"]).collect()}
    assert found == {("ab1", "a"), ("ab1", "ab"), ("a2", "a")}


def price_rows(spark, *rows):
    return documents(
        spark,
        {"observed_prices/000_observed_rates.json": {"rows": [
            dict(zip(("sku_code", "measurements_unit", "price_rate", "discount_rate"), r)) for r in rows
        ]}},
    )


def test_a_long_price_list_comes_in_pages(spark, tmp_path):
    """No document grows with the table, whatever the keys; every price is there once."""
    events = spark.range(32).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2026-09-10 00:00:00' AS ts", "'view' AS event_type"
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    n = 7 * run_fixtures.PAGE + 50
    key = f"CASE WHEN id < {n - 9} THEN 1 WHEN id > {n - 4} THEN id END AS p_partkey"
    part = spark.range(n).coalesce(1).selectExpr(key, "CAST(id % 50 AS INT) AS p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    part.limit(7).coalesce(1).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    found = run_fixtures.documents(spark, str(tmp_path))
    pages = [r for r in found.collect() if r.path.endswith("_observed_rates.json")]
    sizes = [len(json.loads(r.content)["rows"]) for r in pages]
    assert sum(sizes) == n + 7 and max(sizes) <= run_fixtures.PAGE
    assert max(len(r.content) for r in pages) < 16_000  # a reader's batch holds thousands of them
    assert len({r.path for r in pages}) == len(pages)
    expected = spark.read.parquet(f"{tmp_path}/part.parquet").selectExpr(
        "CASE WHEN p_partkey = 1 THEN 'vc_gp_event' ELSE 'sku_' || p_partkey END",
        "CASE WHEN p_partkey % 2 = 1 THEN 'CRU*hour' ELSE 'GiB*month' END",
        "p_size / 8D",
        "0.75D",
    )
    read = run_documents.prices(found)
    assert sorted(map(str, map(tuple, read.collect()))) == sorted(map(str, map(tuple, expected.collect())))
    part.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    empty = run_fixtures.documents(spark, str(tmp_path)).filter("path LIKE '%rates.json'").collect()
    assert [tuple(r) for r in empty] == [("observed_prices/000_observed_rates.json", '{"rows":[]}')]


def test_projection_from_prices(spark):
    summary = spark.createDataFrame(
        [("s", "incremental_server_seconds", 10.0), ("s", "full_server_seconds", 3600.0), ("s", "full_inputBytes", 1.0)],
        "scenario string, metric string, median double",
    )
    prices = price_rows(spark, ("vc_gp_event", "CRU*hour", "2.48", 0.75), ("other", "GiB", "9", 1.0))
    found = {r.method: r for r in telemetry.cost_projection(summary, run_documents.prices(prices)).collect()}
    assert found.keys() == {"incremental", "full"}
    rate = 2.48 * 0.75
    assert found["full"].busy_capacity_proxy_usd == pytest.approx(rate)
    assert found["incremental"].modeled_vc_usd_per_cycle == pytest.approx(70 * rate / 3600)
    assert found["incremental"].modeled_vc_usd_per_30_days == pytest.approx(70 * rate / 3600 * 2880)
    for rows, text in (
        ([("vc_gp_event", "GiB", "1", 1.0)], "unit"),
        ([("other", "CRU*hour", "1", 1.0)], "no compute price"),
        ([("vc_gp_event", "CRU*hour", "1", 1.0), ("vc_gp_event", "CRU*hour", "2", 1.0)], "several"),
    ):
        with pytest.raises(Exception, match=text):
            telemetry.cost_projection(summary, run_documents.prices(price_rows(spark, *rows))).collect()
