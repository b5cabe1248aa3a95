"""Run documents derived from the test events: sixteen statements make one run.

Some jobs and refreshes were collected twice; the older snapshot says something else. Some
runs were never verified, some folders are no measured runs, some results are missing.
"""

from pyspark.sql import DataFrame, SparkSession

_RUN = """CONCAT(CASE (event_id {DIV} 16) % 4 WHEN 0 THEN 'measured2_delta_0' WHEN 1 THEN 'measured2_noop_0'
  WHEN 2 THEN 'scale1m_delta_0' ELSE 'measured2_aging' END, '_', CAST(event_id {DIV} 16 AS {STRING}),
 CASE WHEN (event_id {DIV} 16) % 23 = 5 THEN '_init' WHEN (event_id {DIV} 16) % 29 = 7 THEN '_explain' ELSE '' END)"""

# name -> SQL over events; durations are quarters of a second, so sums are exact
DEFINITIONS: dict[str, str] = {
    "manifest": """
select {RUN} AS run_id, event_id AS seq,
 CASE event_id % 16 WHEN 0 THEN 'change_0' WHEN 1 THEN 'change_1' WHEN 2 THEN 'refresh_subscription_features'
  WHEN 3 THEN 'refresh_billing_features' WHEN 4 THEN 'refresh_care_features' WHEN 5 THEN 'refresh_customer_features'
  WHEN 6 THEN 'refresh_customer_tags' WHEN 7 THEN 'full_recompute' WHEN 8 THEN 'tag_counts'
  WHEN 9 THEN 'affected_customers' WHEN 10 THEN 'tag_transitions' WHEN 11 THEN 'verify' WHEN 12 THEN 'verify_reverse'
  WHEN 13 THEN CASE WHEN (event_id {DIV} 16) % 10 = 3 THEN 'verify_skipped' ELSE 'verify_counts' END
  ELSE CONCAT('qualifying_rows_', CAST(event_id % 2 AS {STRING})) END AS label,
 CASE WHEN event_id % 16 <= 1 THEN 'source_change' WHEN event_id % 16 <= 6 THEN 'incremental'
  WHEN event_id % 16 = 7 THEN 'full' WHEN event_id % 16 = 8 THEN 'consumption' ELSE 'validation' END AS category,
 CAST(event_id AS {STRING}) AS job_id, event_id % 97 <> 0 AS ok
from events""",
    "history": """
select {RUN} AS run_id, CAST(event_id AS {STRING}) AS job_id,
 CASE event_type WHEN 'click' THEN 'NO_DATA' WHEN 'view' THEN 'FULL' ELSE 'INCREMENTAL' END AS refresh_mode,
 CAST(event_id % 400 AS DOUBLE) / 4 AS duration_s, ts + INTERVAL 15 SECOND AS end_time, 1 AS snapshot
from events where event_id % 16 between 2 and 6 and event_id % 11 <> 0
union all select {RUN}, CAST(event_id AS {STRING}), 'RUNNING',
 CAST(event_id % 30 AS DOUBLE), ts + INTERVAL 60 SECOND, 0
from events where event_id % 16 between 2 and 6 and event_id % 11 <> 0 and event_id % 7 = 0""",
    "jobs": """
select {RUN} AS run_id, CAST(event_id AS {STRING}) AS job_id, CAST(event_id % 80 AS DOUBLE) / 4 AS execution_s, ts AS end_time, 1 AS snapshot
from events where event_id % 13 <> 0
union all select {RUN}, CAST(event_id AS {STRING}), CAST(event_id % 50 AS DOUBLE), ts + INTERVAL 90 SECOND, 0
from events where event_id % 13 <> 0 and event_id % 3 = 0""",
    "plan": """
select {RUN} AS run_id, 100000 + event_id AS customers, 150000 + event_id AS subscriptions, 100 + event_id % 7 AS selected_customers
from events where event_id % 16 = 0""",
    # a result without rows says nothing; one that was asked for again counts as first answered
    "result": """
select {RUN} AS run_id, event_id % 16 AS place, event_id % 5 <> 0 AS answered, event_id % 41 AS value, 0 AS asked
from events where event_id % 16 >= 9 and event_id % 19 <> 0
union all select {RUN}, event_id % 16, TRUE, 7000, 1
from events where event_id % 16 between 9 and 13 and event_id % 19 <> 0 and event_id % 4 = 1""",
}

_PROFILES = """
select {RUN} AS run_id, label,
 map_filter(map('inputRowCount', CAST(event_id * 3 AS STRING), 'inputBytes', CAST(event_id * 1000 AS STRING),
  'outputRowCount', CAST(event_id % 100 AS STRING), 'outputBytes', CAST(event_id % 100 * 37 AS STRING),
  'spillingBytes', CASE WHEN event_id % 7 <> 0 THEN '0' END), (k, v) -> v IS NOT NULL) AS stats,
 CASE WHEN event_id % 5 = 0 THEN array() ELSE array(
  named_struct('key', 'cpu_wall_time', 'unit', 'ns', 'value', CAST(event_id % 40 * 250000000 AS STRING)),
  named_struct('key', 'cpu_wall_time', 'unit', 'cru', 'value', CAST(event_id % 8 AS STRING)),
  named_struct('key', 'wall_time', 'unit', 'ns', 'value', '1')) END AS meter
from {events} JOIN {manifest} ON seq = event_id where event_id % 17 <> 0"""

# a price list of any length comes in pages, so no document grows with the table: a page is a
# stretch of what one task read, whatever the keys; the first one is there without prices too.
# Readers of the archive hold 4,096 documents at a time: 40 MB of pages of this many prices
PAGE = 100
_PRICES = f"""
select shiftright(place, 33) AS reader, (place & {2**33 - 1}) DIV {PAGE} AS page, price
from (select monotonically_increasing_id() AS place, struct(
 CASE p_partkey WHEN 1 THEN 'vc_gp_event' ELSE CONCAT('sku_', CAST(p_partkey AS STRING)) END AS sku_code,
 CASE p_partkey % 2 WHEN 1 THEN 'CRU*hour' ELSE 'GiB*month' END AS measurements_unit,
 CAST(CAST(p_size AS DOUBLE) / 8 AS STRING) AS price_rate, CAST(0.75 AS DOUBLE) AS discount_rate) AS price
 from {{part}})
union all select 0, 0, NULL"""

# what the documents of each kind look like; a duration is a triple or a number
_DOCUMENTS = """
select CONCAT('runs/', run_id, '/manifest.json') AS path,
 to_json(transform(array_sort(collect_list(struct(seq, label, category, array(job_id) AS job_ids, ok))),
  s -> struct(s.label, s.category, s.job_ids, s.ok))) AS content
from {manifest} group by run_id
union all select CONCAT('runs/', run_id, '/plan.json'),
 to_json(struct(struct(customers, subscriptions, selected_customers AS changed) AS config)) from {plan}
union all select CONCAT('runs/', run_id, '/', CASE snapshot WHEN 1 THEN '090' ELSE '017' END, '_history.json'),
 to_json(struct(collect_list(struct(job_id, refresh_mode,
  array(0, CAST(duration_s AS BIGINT) DIV 50, CAST((duration_s - CAST(duration_s AS BIGINT) DIV 50 * 86400) * 1000000000 AS BIGINT)) AS duration,
  date_format(end_time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS end_time)) AS rows))
from {history} group by run_id, snapshot
union all select CONCAT('runs/', run_id, '/', CASE snapshot WHEN 1 THEN '091' ELSE '018' END, '_recent_jobs.json'),
 to_json(struct(collect_list(struct(job_id, execution_s AS execution_time,
  date_format(end_time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS end_time)) AS rows))
from {jobs} group by run_id, snapshot
union all select CONCAT('runs/', run_id, '/', lpad(CAST(place + asked * 40 AS STRING), 3, '0'), '_',
  CASE place WHEN 9 THEN 'affected_customers' WHEN 10 THEN 'tag_transitions' WHEN 11 THEN 'verify'
   WHEN 12 THEN 'verify_reverse' WHEN 13 THEN 'verify_counts' ELSE CONCAT('qualifying_rows_', CAST(place % 2 AS STRING)) END, '.json'),
 CASE WHEN NOT answered AND place < 14 THEN '{"rows": []}' ELSE to_json(struct(array(map(
  CASE place WHEN 9 THEN 'affected_customers' WHEN 10 THEN 'flag_transitions' WHEN 11 THEN 'mismatches'
   WHEN 12 THEN 'mismatches' WHEN 13 THEN 'customers' ELSE 'qualifying_source_rows' END, value)) AS rows)) END
from {result}
union all select CONCAT('profiles/profiles_', run_id, '/', lpad(CAST(abs(hash(label)) % 1000 AS STRING), 3, '0'), '_', label, '.json'),
 to_json(struct(struct(struct(struct(stats AS inputOutputStats) AS stats, struct(meter AS measurements) AS meter) AS jobSummary) AS data))
from {profiles}
union all select CONCAT('observed_prices', CASE reader WHEN 0 THEN '' ELSE CONCAT('_', CAST(reader AS STRING)) END,
  '/', format_string('%03d', page), '_observed_rates.json'), to_json(struct(collect_list(price) AS rows))
from {prices} group by reader, page"""


def definition(name: str, string: str, div: str) -> str:
    """The SQL of a table, in the words of one dialect or the other."""
    text = DEFINITIONS[name].replace("{RUN}", _RUN)
    return text.replace("{STRING}", string).replace("{DIV}", div).strip()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as (path, content)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tables = {
        name: spark.sql(
            definition(name, "STRING", "DIV").replace("from events", "from {events}"), events=events
        )
        for name in DEFINITIONS
    }
    run = _RUN.replace("{STRING}", "STRING").replace("{DIV}", "DIV")
    tables["profiles"] = spark.sql(
        _PROFILES.replace("{RUN}", run), events=events, manifest=tables["manifest"]
    )
    tables["prices"] = spark.sql(_PRICES, part=part)
    text = _DOCUMENTS.replace('{"rows": []}', '{{"rows": []}}')
    return spark.sql(text, **tables)
