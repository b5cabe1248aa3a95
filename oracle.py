"""The registered queries as SQL for the comparison database, written independently.

Each text starts with the shared definitions of the derived input tables.
"""

from mastline.registered import CASES, LATE_THRESHOLD, SECRETS
from mastline.schemas import FLAGS
from mastline.sources import fixtures, run_fixtures

_TAGS = "customer_id, rule_version, " + ", ".join(FLAGS)


def _inputs(*names: str) -> dict[str, str]:
    """Input definitions with everything they read, in order."""
    found: dict[str, str] = {}
    for name in names:
        if name not in fixtures.DEFINITIONS:
            continue
        sources, text = fixtures.DEFINITIONS[name]
        found.update(_inputs(*sources))
        found[name] = text.replace("{STRING}", "VARCHAR").strip()
    return found


def _sql(ctes: dict[str, str], body: str) -> str:
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


_XDR = _inputs("xdr")
_SESSIONS = {
    **_XDR,
    "sessions": """
SELECT x.*, date_trunc('hour', event_ts) AS event_hour, datesub('hour', event_ts, ingest_ts) AS lateness_h
FROM xdr x QUALIFY row_number() OVER (PARTITION BY xdr_id ORDER BY record_version DESC, ingest_ts DESC) = 1""",
}
_HOURLY = {
    **_SESSIONS,
    "hourly": """
SELECT event_hour, cell_id, rat, COUNT(*) AS sessions, COUNT(DISTINCT msisdn) AS uniq_subs,
 CAST(SUM(bytes_dl) AS BIGINT) AS bytes_dl, CAST(SUM(bytes_ul) AS BIGINT) AS bytes_ul,
 CAST(SUM(rated_amount) AS DECIMAL(22,4)) AS revenue,
 COUNT(*) FILTER (WHERE lateness_h >= 24) AS very_late_records
FROM sessions GROUP BY ALL""",
}
_AUDIT = """
SELECT date_trunc('hour', ingest_ts) AS ingest_hour,
 CASE WHEN lateness_h >= 24 OR lateness_h IS NULL THEN 'late_24h_plus' WHEN lateness_h >= 6 THEN 'late_6_24h'
  WHEN lateness_h >= 1 THEN 'late_1_6h' ELSE 'on_time' END AS lateness_bucket,
 COUNT(*) AS records, COUNT(DISTINCT event_hour) AS event_hours_touched
FROM sessions GROUP BY ALL"""

# --- features and tags over any set of base tables

_BASE = {
    "customer": "telco_customer",
    "billing_account": "billing_account",
    "product_offering": "product_offering",
    "product_inventory": "product_inventory",
    "customer_bill": "customer_bill",
    "trouble_ticket": "trouble_ticket",
}
_BASE_INPUTS = _inputs(*_BASE.values(), "changed_customer")


def _tag_ctes(suffix: str = "", **tables: str) -> dict[str, str]:
    t = {**_BASE, **tables}
    money = "DECIMAL(22,2)"
    return {
        f"sub{suffix}": f"""
SELECT i.customer_id, CAST(SUM(CAST(i.status = 'active' AS INT)) AS BIGINT) AS active_subscriptions,
 CAST(COALESCE(SUM(i.monthly_charge) FILTER (WHERE i.status = 'active'), 0) AS {money}) AS monthly_spend,
 COUNT(*) FILTER (WHERE i.status = 'active' AND o.family = 'mobile') AS mobile_lines,
 COUNT(*) FILTER (WHERE i.status = 'active' AND o.family = 'broadband') AS broadband_lines,
 COUNT(*) FILTER (WHERE i.status = 'active' AND i.renewal_due) AS renewal_lines
FROM {t['product_inventory']} i, {t['product_offering']} o WHERE o.offering_id = i.offering_id GROUP BY i.customer_id""",
        f"bil{suffix}": f"""
SELECT a.customer_id, CAST(COALESCE(SUM(b.outstanding_amount) FILTER (WHERE b.overdue_30), 0) AS {money}) AS overdue_amount
FROM {t['billing_account']} a, {t['customer_bill']} b WHERE a.account_id = b.account_id GROUP BY a.customer_id""",
        f"car{suffix}": f"""
SELECT customer_id, COUNT(*) FILTER (WHERE status = 'open' AND priority = 'high') AS open_complaints
FROM {t['trouble_ticket']} GROUP BY customer_id""",
        f"cf{suffix}": f"""
SELECT customer_id, c.status, c.marketing_consent, COALESCE(active_subscriptions, 0) AS active_subscriptions,
 CAST(COALESCE(monthly_spend, 0) AS {money}) AS monthly_spend, COALESCE(mobile_lines, 0) AS mobile_lines,
 COALESCE(broadband_lines, 0) AS broadband_lines, COALESCE(renewal_lines, 0) AS renewal_lines,
 CAST(COALESCE(overdue_amount, 0) AS {money}) AS overdue_amount, COALESCE(open_complaints, 0) AS open_complaints
FROM {t['customer']} c LEFT JOIN sub{suffix} USING (customer_id) LEFT JOIN bil{suffix} USING (customer_id)
 LEFT JOIN car{suffix} USING (customer_id)""",
        f"tags{suffix}": f"""
SELECT customer_id, 'bss-v1' AS rule_version,
 CAST(is_active AND spender AS INT) AS high_value, CAST(is_active AND active_subscriptions > 1 AS INT) AS multi_line,
 CAST(is_active AND overdue_amount >= 50 AS INT) AS payment_risk,
 CAST(is_active AND spender AND (renewal_lines > 0 OR open_complaints > 0) AS INT) AS retention_priority,
 CAST(is_active AND consents AND mobile_lines > 0 AND broadband_lines = 0 AND clean AS INT) AS broadband_cross_sell,
 CAST(NOT (is_active AND consents AND clean) AS INT) AS campaign_suppressed
FROM (SELECT *, status IS NOT DISTINCT FROM 'active' AS is_active, marketing_consent IS NOT DISTINCT FROM TRUE AS consents,
  monthly_spend >= 100 AS spender, overdue_amount = 0 AND open_complaints = 0 AS clean FROM cf{suffix})""",
    }


_PICKED = "customer_id IN (SELECT customer_id FROM changed_customer)"
_THEIR_BILL = f"account_id IN (SELECT account_id FROM billing_account WHERE {_PICKED})"
_RENEWAL = (
    "(contract_end = DATE '2026-09-10' + 31 AND NOT renewal_due)"
    " OR (contract_end = DATE '2026-09-10' AND renewal_due)"
)
_OVERDUE = "due_date = DATE '2026-09-10' - 29 AND NOT overdue_30"

# case -> [(base table, condition, column, new value)]; a case without column deletes rows
_CHANGES = {
    "delta": [
        ("customer", _PICKED, "marketing_consent", "NOT marketing_consent"),
        ("product_inventory", _PICKED, "monthly_charge", "CAST(monthly_charge + 1 AS DECIMAL(12,2))"),
    ],
    "payment": [
        ("customer_bill", f"{_THEIR_BILL} AND outstanding_amount > 0", "outstanding_amount", "CAST(0 AS DECIMAL(12,2))")
    ],
    "care_close": [("trouble_ticket", f"{_PICKED} AND status = 'open'", "status", "'closed'")],
    "terminate": [("product_inventory", f"{_PICKED} AND status = 'active'", "status", "'terminated'")],
    "aging": [
        ("product_inventory", _RENEWAL, "renewal_due", "NOT renewal_due"),
        ("customer_bill", _OVERDUE, "overdue_30", "TRUE"),
    ],
    "catalog_fanout": [("product_offering", "family = 'mobile'", "family", "'broadband'")],
    "delete_customer": [("customer", _PICKED, None, None)],
}


def _changed_ctes(case: str) -> dict[str, str]:
    """The changed base tables of a case and the tags over them (suffix: the case)."""
    ctes, tables = {}, {}
    for table, where, column, value in _CHANGES[case]:
        name = tables[table] = f"{table}_{case}"
        if column is None:
            ctes[name] = f"SELECT * FROM {_BASE[table]} WHERE NOT ({where})"
        else:
            ctes[name] = (
                f"SELECT * REPLACE (CASE WHEN {where} THEN {value} ELSE {column} END AS {column})"
                f" FROM {_BASE[table]}"
            )
    return {**ctes, **_tag_ctes(f"_{case}", **tables)}


def _affected(case: str) -> str:
    parts = []
    for table, where, _, _ in _CHANGES[case]:
        if table == "customer_bill":
            parts.append(
                f"SELECT customer_id FROM billing_account WHERE account_id IN (SELECT account_id FROM customer_bill WHERE {where})"
            )
        elif table == "product_offering":
            parts.append(
                f"SELECT customer_id FROM product_inventory WHERE offering_id IN (SELECT offering_id FROM product_offering WHERE {where})"
            )
        else:
            parts.append(f"SELECT customer_id FROM {_BASE[table]} WHERE {where}")
    return " UNION ".join(parts)


def _transitions(case: str) -> str:
    moved = " + ".join(f"abs(COALESCE(n.{f}, 0) - COALESCE(o.{f}, 0))" for f in FLAGS)
    return f"""
SELECT '{case}' AS change_case, CAST(COALESCE(SUM({moved}), 0) AS BIGINT) AS flag_transitions,
 COUNT(*) FILTER (WHERE o.customer_id IS NULL) AS added_customers,
 COUNT(*) FILTER (WHERE n.customer_id IS NULL) AS removed_customers
FROM tags_{case} n FULL JOIN tags o ON n.customer_id = o.customer_id"""


def _mismatch(a: str, b: str) -> str:
    return f"(SELECT COUNT(*) FROM (SELECT {_TAGS} FROM {a} EXCEPT SELECT {_TAGS} FROM {b}))"


_ALL_CASES = {k: v for case in CASES for k, v in _changed_ctes(case).items()}
_BASE_TAGS = {**_BASE_INPUTS, **_tag_ctes()}


def _refresh_step(table: str, key_count: str, old: str, new: str) -> str:
    """A history row: rows of ``new`` not in ``old`` went in, the reverse went out."""
    return f"""
SELECT '{table}' AS table_name, 'INCREMENTAL' AS refresh_mode, {key_count} AS affected_keys,
 (SELECT COUNT(*) FROM (FROM {new} EXCEPT FROM {old})) AS rows_inserted,
 (SELECT COUNT(*) FROM (FROM {old} EXCEPT FROM {new})) AS rows_deleted"""


def _idle(table: str) -> str:
    return f"SELECT '{table}', 'NO_DATA', 0, 0, 0"


# --- telemetry

_RUN = {
    name: run_fixtures.definition(name, "VARCHAR", "//") for name in run_fixtures.DEFINITIONS
}
_COUNTERS = {
    "inputRowCount": "e.event_id * 3",
    "inputBytes": "e.event_id * 1000",
    "inputDeltaBytes": "CAST(NULL AS BIGINT)",
    "inputDiskBytes": "CAST(NULL AS BIGINT)",
    "inputCacheBytes": "CAST(NULL AS BIGINT)",
    "outputRowCount": "e.event_id % 100",
    "outputBytes": "e.event_id % 100 * 37",
    "spillingBytes": "CASE WHEN e.event_id % 7 <> 0 THEN 0 END",
    "cpu_wall_seconds": "CASE WHEN e.event_id % 5 <> 0 THEN CAST(e.event_id % 40 AS DOUBLE) / 4 END",
    "job_meter_cru": "CASE WHEN e.event_id % 5 <> 0 THEN CAST(e.event_id % 8 AS DOUBLE) END",
}


def _run_rollup() -> str:
    profile = ", ".join(f"{expr} AS {name}" for name, expr in _COUNTERS.items())
    labels = ["affected_customers", "tag_transitions", "verify", "verify_reverse", "verify_counts"]
    answers = ", ".join(
        f"MAX(value) FILTER (WHERE place = {place} AND asked = 0 AND answered) AS {label}"
        for place, label in enumerate(labels, 9)
    )
    ctes = {
        **_RUN,
        "statements": f"""
SELECT m.*, h.refresh_mode, h.job_id IS NOT NULL AND m.category = 'incremental' AS refreshed,
 CASE WHEN h.job_id IS NOT NULL AND m.category = 'incremental' THEN h.duration_s ELSE j.execution_s END AS seconds,
 h.end_time AS history_end, j.end_time AS job_end, p.*
FROM (FROM manifest WHERE run_id IN (SELECT run_id FROM manifest WHERE label = 'verify_counts')
  AND run_id NOT LIKE '%init' AND run_id NOT LIKE '%explain') m LEFT JOIN (FROM history QUALIFY snapshot = max(snapshot) OVER (PARTITION BY run_id, job_id)) h
 ON h.run_id = m.run_id AND h.job_id = m.job_id
 LEFT JOIN (FROM jobs QUALIFY snapshot = max(snapshot) OVER (PARTITION BY job_id)) j ON j.job_id = m.job_id
 LEFT JOIN (SELECT e.event_id AS profile_of, {profile} FROM events e WHERE e.event_id % 17 <> 0) p ON p.profile_of = m.seq""",
        "results": f"""
SELECT run_id, {answers}, CAST(COALESCE(SUM(value) FILTER (WHERE place >= 14), 0) AS BIGINT) AS changed_source_rows
FROM result GROUP BY run_id""",
    }
    columns = []
    for category in ("incremental", "full", "source_change", "consumption"):
        of = f"FILTER (WHERE category = '{category}')"
        whole = lambda x: (
            f"CASE WHEN COUNT(*) {of} = COUNT({x}) {of} THEN COALESCE(SUM({x}) {of}, 0) END"
        )
        columns += [
            f"{whole('seconds')} AS {category}_server_seconds",
            f"COUNT(profile_of) {of} AS {category}_profile_count",
            f"COUNT(*) {of} AS {category}_job_count",
        ]
        for name in _COUNTERS:
            kind = "DOUBLE" if name in ("cpu_wall_seconds", "job_meter_cru") else "BIGINT"
            columns.append(f"CAST({whole(name)} AS {kind}) AS {category}_{name}")
    columns += [
        "COALESCE(string_agg(replace(label, 'refresh_', '') || ':' || refresh_mode, ';' ORDER BY seq)"
        " FILTER (WHERE refreshed), '') AS refresh_modes",
        "(epoch_us(max(history_end) FILTER (WHERE label = 'refresh_customer_tags'))"
        " - epoch_us(max_by(COALESCE(job_end, TIMESTAMP '1900-01-01'), seq) FILTER (WHERE category = 'source_change'))) / 1e6"
        " AS gap",
        "bool_and(COALESCE(job_end, TIMESTAMP '1900-01-01') <> TIMESTAMP '1900-01-01') FILTER (WHERE label = 'change_1') AS known",
        "bool_and(ok) AS all_statements_ok",
    ]
    return _sql(
        ctes,
        "SELECT * EXCLUDE (gap, known, changed), CASE WHEN known THEN gap END AS last_source_commit_to_tags_seconds"
        ", COALESCE(changed, 0) AS changed_source_rows"
        " FROM (SELECT run_id, " + ",\n ".join(columns) + " FROM statements GROUP BY run_id)"
        " LEFT JOIN plan USING (run_id)"
        " LEFT JOIN (SELECT * RENAME (changed_source_rows AS changed) FROM results) USING (run_id)",
    )


def _summary(group: str, value: str, source: str) -> str:
    return f"""
SELECT {group}, COUNT(*) AS n, median({value}) AS median,
 max({value}) FILTER (WHERE place = CAST(ceil(CAST(0.95 AS DOUBLE) * total) AS BIGINT)) AS p95_nearest_rank,
 min({value}) AS min, max({value}) AS max
FROM (SELECT {group}, {value}, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS place,
  COUNT(*) OVER (PARTITION BY {group}) AS total FROM {source} WHERE {value} IS NOT NULL) GROUP BY {group}"""


def _run_summary() -> str:
    """The runs of each scenario, one row per metric and run that has it."""
    kinds = ["server_seconds", "cpu_wall_seconds", "inputRowCount", "inputBytes", "outputBytes", "job_meter_cru"]
    metrics = [f"{method}_{kind}" for kind in kinds for method in ("incremental", "full")]
    values = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in metrics)
    scenario = (
        "CASE WHEN starts_with(run_id, 'measured2_delta_0') THEN 'measured2_delta_0'"
        " WHEN starts_with(run_id, 'measured2_noop_0') THEN 'measured2_noop_0'"
        " WHEN starts_with(run_id, 'scale1m_delta_0') THEN 'scale1m_delta_0' END"
    )
    runs = f"(SELECT {scenario} AS scenario, {values} FROM ({_run_rollup()}) WHERE {scenario} IS NOT NULL)"
    long = f"(UNPIVOT {runs} ON {', '.join(metrics)} INTO NAME metric VALUE value)"
    return _summary("scenario, metric", "value", long)


_SUMMARY = _summary("event_type", "value", "events")


def _redacted(expr: str) -> str:
    for word in sorted((w for w in SECRETS if len(w) >= 4), key=lambda w: (-len(w), w)):
        expr = f"replace({expr}, '{word}', '[REDACTED]')"
    return expr


def _totals() -> str:
    return ", ".join(f"CAST(SUM({flag}) AS BIGINT) AS {flag}" for flag in FLAGS)


def _orphans() -> str:
    checks = [
        ("product_inventory", "offering_id", "product_offering"),
        ("customer_bill", "account_id", "billing_account"),
        ("billing_account", "customer_id", "telco_customer"),
        ("trouble_ticket", "customer_id", "telco_customer"),
        ("product_inventory", "customer_id", "telco_customer"),
        ("product_inventory", "account_id", "billing_account"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{child}' AS child, {col} AS missing, COUNT(*) AS rows FROM {child} c"
        f" WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{col} = c.{col}) GROUP BY {col}"
        for child, col, parent in checks
    )


_USAGE = "CAST(SUM(bytes_dl + bytes_ul) AS DOUBLE) / 1073741824.0"
_MONEY4 = "CAST(SUM(revenue) AS DECIMAL(32,4)) AS revenue"
_SUMS = "CAST(SUM(sessions) AS BIGINT) AS sessions"


def _reliability(threshold: int = 1) -> str:
    return f"CASE WHEN very_late_records >= {threshold} THEN 'PROVISIONAL' ELSE 'SETTLED' END AS reliability"


def oracle_sql() -> dict[str, str]:
    sql = {
        "latest_sessions": _sql(_SESSIONS, "SELECT * FROM sessions"),
        "hourly_cell_usage": _sql(_HOURLY, "SELECT * FROM hourly"),
        "approx_subscribers": _sql(_HOURLY, "SELECT event_hour, cell_id, rat, TRUE AS close FROM hourly"),
        "sketch_totals": _sql(
            _SESSIONS,
            " UNION ALL ".join(
                f"""SELECT '{level}' AS level, CAST({key} AS VARCHAR) AS total_of, COUNT(*) AS sessions,
 CAST(SUM(COALESCE(bytes_dl, 0) + COALESCE(bytes_ul, 0)) AS BIGINT) AS bytes,
 CAST(SUM(rated_amount) AS DECIMAL(22,4)) AS revenue, TRUE AS close FROM sessions GROUP BY {key}"""
                for level, key in [("day", "CAST(event_ts AS DATE)"), ("cell", "cell_id")]
            ),
        ),
        "freshness": _sql(
            {
                **_XDR,
                "refresh": """
SELECT cell_id AS of_cell, ingest_ts AS started_at, MIN(ingest_ts + INTERVAL 1 SECOND * duration_s) AS finished_at
FROM xdr WHERE record_type = 'VOICE' AND ingest_ts IS NOT NULL GROUP BY ALL""",
                "written": "SELECT * FROM xdr WHERE record_type <> 'VOICE'",
            },
            """SELECT xdr_id, record_version, cell_id AS source, ingest_ts AS committed_at, started_at, finished_at,
 date_diff('microsecond', ingest_ts, finished_at) / CAST(1000000 AS DOUBLE) AS seconds
FROM written ASOF LEFT JOIN refresh ON cell_id = of_cell AND ingest_ts <= started_at""",
        ),
        "base_drift": _sql(
            _BASE_INPUTS,
            f"""SELECT 'customer' AS table_name, 'customer_id' AS column_name, 'null_key' AS problem,
 CAST(NULL AS VARCHAR) AS declared, CAST(NULL AS VARCHAR) AS found, COUNT(*) AS rows FROM telco_customer
 WHERE {_PICKED} HAVING COUNT(*) > 0
UNION ALL SELECT 'product_offering', 'offering_id', 'repeated_key', NULL, NULL, 2 * COUNT(*) FROM product_offering
UNION ALL SELECT 'billing_account', 'region', 'extra', NULL, 'string', NULL
UNION ALL SELECT 'customer_bill', 'outstanding_amount', 'type', 'decimal(12,2)', 'double', NULL
UNION ALL SELECT 'trouble_ticket', 'priority', 'missing', 'string', NULL, NULL""",
        ),
        "subscriber_daily": _sql(
            _SESSIONS,
            """SELECT CAST(event_ts AS DATE) AS event_date, msisdn, CAST(SUM(bytes_dl + bytes_ul) AS BIGINT) AS bytes_total,
 CAST(SUM(duration_s) AS BIGINT) AS voice_s, CAST(SUM(rated_amount) AS DECIMAL(22,4)) AS revenue, MAX(lateness_h) AS max_lateness_h
FROM sessions GROUP BY ALL""",
        ),
        "late_arrival_audit": _sql(_SESSIONS, _AUDIT),
        "batch_type_counts": _sql(_XDR, "SELECT batch_type, COUNT(*) AS records FROM xdr GROUP BY ALL"),
        "ingest_dates": _sql(
            _XDR, "SELECT CAST(ingest_ts AS DATE) AS ingest_date, COUNT(*) AS records FROM xdr GROUP BY ALL"
        ),
        "newest_records": _sql(
            _XDR, "SELECT * FROM xdr ORDER BY ingest_ts DESC, xdr_id, record_version DESC LIMIT 1000"
        ),
        "rate_usage": _sql(
            _XDR,
            # 0.05 a minute, 8 per 10^9 bytes, 0.05 an SMS, 2 for roaming: sixty times the price is exact
            """SELECT xdr_id, record_version,
 CAST((CAST(sixty * 100000000 AS HUGEINT) + 300000) // 600000 AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS rated_amount
FROM (SELECT *, CAST(duration_s AS DECIMAL(18,0)) * 0.05 + CAST(bytes_ul + bytes_dl AS DECIMAL(18,0)) * 0.00000048
  + CASE record_type WHEN 'SMS' THEN 3.0 ELSE 0.0 END + CASE roaming_partner WHEN '' THEN 0.0 ELSE 120.0 END AS sixty FROM xdr)""",
        ),
        "correction_batch": _sql(
            _inputs("xdr_v1"),
            """SELECT * EXCLUDE digest REPLACE (CAST(2 AS INTEGER) AS record_version, '' AS apn, '' AS roaming_partner,
 TIMESTAMP '2026-09-10 00:00:00' AS ingest_ts, CAST(7 AS INTEGER) AS batch_id, 'CORRECTION' AS batch_type,
 CAST(rated_amount * CASE instr('0123456789abcdef', digest[1]) % 3 WHEN 0 THEN 0.00 WHEN 1 THEN 0.50 ELSE 1.25 END AS DECIMAL(12,4)) AS rated_amount)
FROM (SELECT *, md5('7:' || xdr_id) AS digest FROM xdr_v1) WHERE digest < '06666666'""",
        ),
        "landing_scan": _sql(_XDR, "SELECT * FROM xdr"),
        "landing_layout": _sql(
            _XDR,
            """SELECT strftime(MIN(ingest_ts), '%Y-%m-%d') AS dt, CAST(hour(MIN(ingest_ts)) AS INTEGER) AS hour, batch_type,
 COUNT(*) AS records FROM xdr GROUP BY batch_id, batch_type""",
        ),
        "landing_files": _sql(
            _XDR, "SELECT COUNT(*) AS records, CAST(0 AS BIGINT) AS unmatched_files, CAST(0 AS BIGINT) AS empty_files FROM xdr"
        ),
        "copy_replay": _sql(
            _SESSIONS,
            """SELECT batch_type, 2 * COUNT(*) AS raw_records, (SELECT COUNT(*) FROM sessions s WHERE s.batch_type = x.batch_type) AS sessions
FROM xdr x GROUP BY batch_type""",
        ),
        "replayed_rows": _sql(
            _XDR, "SELECT xdr_id, record_version, batch_id, 2 * COUNT(*) AS rows FROM xdr GROUP BY ALL"
        ),
        "load_audit": _sql(
            _XDR,
            "SELECT batch_id AS first_batch, batch_id AS last_batch, 2 * COUNT(*) AS rows_loaded FROM xdr GROUP BY batch_id",
        ),
        "unpurged_files": _sql(_XDR, "SELECT 2 * COUNT(*) AS rows_at_risk FROM xdr"),
        "ingest_once": _sql(
            _XDR,
            "SELECT batch_type, COUNT(*) AS records, CAST(SUM(rated_amount) AS DECIMAL(22,4)) AS revenue FROM xdr GROUP BY ALL",
        ),
        "stream_latest": _sql(_SESSIONS, "SELECT * EXCLUDE (event_hour, lateness_h) FROM sessions"),
        "stream_late": _sql(_SESSIONS, _AUDIT),
        "stream_hourly": _sql(_HOURLY, "SELECT * FROM hourly"),
        "stream_daily": _sql(
            _SESSIONS,
            """SELECT CAST(event_ts AS DATE) AS event_date, msisdn, CAST(SUM(bytes_dl + bytes_ul) AS BIGINT) AS bytes_total,
 CAST(SUM(duration_s) AS BIGINT) AS voice_s, CAST(SUM(rated_amount) AS DECIMAL(22,4)) AS revenue, MAX(lateness_h) AS max_lateness_h
FROM sessions GROUP BY ALL""",
        ),
        "stream_audit": _sql(_SESSIONS, _AUDIT),
        "semantic_top_cells": _sql(
            _HOURLY,
            f"""SELECT cell_id AS cell, rat AS radio, {_SUMS}, {_USAGE} AS data_gb, {_MONEY4}
FROM hourly GROUP BY ALL ORDER BY data_gb DESC, cell, radio LIMIT 10""",
        ),
        "semantic_hour_reliability": _sql(
            _HOURLY,
            f"""SELECT event_hour, {_reliability()}, {_SUMS}, {_MONEY4}
FROM hourly GROUP BY ALL ORDER BY event_hour DESC, reliability LIMIT 24""",
        ),
        "semantic_filtered": _sql(
            _HOURLY,
            f"""SELECT * FROM (SELECT cell_id AS cell, rat AS radio, {_reliability()},
 CAST(SUM(uniq_subs) AS BIGINT) AS unique_subscribers, {_USAGE} / SUM(sessions) AS gb_per_session FROM hourly GROUP BY ALL)
WHERE unique_subscribers > 100 AND reliability = 'SETTLED'""",
        ),
        "semantic_threshold": _sql(
            _HOURLY, f"SELECT {_reliability(LATE_THRESHOLD)}, {_SUMS}, {_MONEY4} FROM hourly GROUP BY ALL"
        ),
        "semantic_ask": _sql(
            _HOURLY,
            f"""SELECT * FROM (SELECT event_hour, {_reliability()}, {_SUMS}, {_USAGE} AS data_gb FROM hourly GROUP BY ALL)
WHERE sessions >= 2 ORDER BY sessions DESC, event_hour, reliability LIMIT 24""",
        ),
        "subscription_features": _sql(_BASE_TAGS, "SELECT * FROM sub"),
        "billing_features": _sql(_BASE_TAGS, "SELECT * FROM bil"),
        "care_features": _sql(_BASE_TAGS, "SELECT * FROM car"),
        "customer_features": _sql(_BASE_TAGS, "SELECT * FROM cf"),
        "customer_tags_full": _sql(_BASE_TAGS, "SELECT * FROM tags"),
        "tag_totals": _sql(_BASE_TAGS, f"SELECT {_totals()} FROM tags"),
        "audience": _sql(
            _BASE_TAGS,
            "SELECT customer_id, rule_version FROM tags WHERE broadband_cross_sell = 1 AND campaign_suppressed = 0 ORDER BY customer_id LIMIT 100",
        ),
        "refresh_noop": " UNION ALL ".join(
            ["SELECT 'subscription_features' AS table_name, 'NO_DATA' AS refresh_mode, CAST(0 AS BIGINT) AS affected_keys,"
             " CAST(0 AS BIGINT) AS rows_inserted, CAST(0 AS BIGINT) AS rows_deleted"]
            + [_idle(t) for t in ("billing_features", "care_features", "customer_features", "customer_tags")]
        ),
        "refresh_history": _sql(
            {**_BASE_TAGS, **_changed_ctes("delta")},
            " UNION ALL ".join(
                [
                    _refresh_step(
                        "subscription_features",
                        f"(SELECT COUNT(DISTINCT customer_id) FROM product_inventory WHERE {_PICKED})",
                        "sub",
                        "sub_delta",
                    ),
                    _idle("billing_features"),
                    _idle("care_features"),
                    _refresh_step(
                        "customer_features",
                        "(SELECT COUNT(*) FROM (SELECT customer_id FROM telco_customer WHERE " + _PICKED + " UNION"
                        " SELECT customer_id FROM (FROM sub_delta EXCEPT FROM sub)))",
                        "cf",
                        "cf_delta",
                    ),
                    _refresh_step(
                        "customer_tags",
                        "(SELECT COUNT(DISTINCT customer_id) FROM (FROM cf_delta EXCEPT FROM cf))",
                        "tags",
                        "tags_delta",
                    ),
                ]
            ),
        ),
        "refresh_replaced": _sql(
            {
                **_BASE_TAGS,
                "reloaded": f"SELECT * FROM {_BASE['customer_bill']} WHERE outstanding_amount > 40 OR NOT overdue_30",
                **_tag_ctes("_reloaded", customer_bill="reloaded"),
            },
            " UNION ALL ".join(
                [
                    _idle("subscription_features").replace("SELECT 'subscription_features', 'NO_DATA', 0, 0, 0",
                        "SELECT 'subscription_features' AS table_name, 'NO_DATA' AS refresh_mode, CAST(0 AS BIGINT) AS affected_keys,"
                        " CAST(0 AS BIGINT) AS rows_inserted, CAST(0 AS BIGINT) AS rows_deleted"),
                    _idle("care_features"),
                    *(
                        f"SELECT '{table}', 'FULL', 0, (SELECT COUNT(*) FROM {new}), (SELECT COUNT(*) FROM {old})"
                        for table, new, old in (
                            ("billing_features", "bil_reloaded", "bil"),
                            ("customer_features", "cf_reloaded", "cf"),
                            ("customer_tags", "tags_reloaded", "tags"),
                        )
                    ),
                ]
            ),
        ),
        "affected_customers": _sql(
            _BASE_INPUTS,
            " UNION ALL ".join(
                f"SELECT DISTINCT '{case}' AS change_case, customer_id FROM ({_affected(case)})" for case in CASES
            ),
        ),
        "qualifying_rows": _sql(
            _BASE_INPUTS,
            " UNION ALL ".join(
                f"SELECT '{case}' AS change_case, '{table}' AS source_table, COUNT(*) AS qualifying_source_rows"
                f" FROM {_BASE[table]} WHERE {where}"
                for case in CASES
                for table, where, _, _ in _CHANGES[case]
            ),
        ),
        "tag_transitions": _sql(
            {**_BASE_TAGS, **_ALL_CASES}, " UNION ALL ".join(_transitions(case) for case in CASES)
        ),
        "snapshot_diff": _sql(
            {**_BASE_TAGS, **_changed_ctes("delta")},
            f"""SELECT 'inserted' AS change_type, *, CAST(1 AS BIGINT) AS copies FROM (SELECT {_TAGS} FROM tags_delta EXCEPT ALL SELECT {_TAGS} FROM tags)
UNION ALL SELECT 'deleted', *, 1 FROM (SELECT {_TAGS} FROM tags EXCEPT ALL SELECT {_TAGS} FROM tags_delta)""",
        ),
        "lifecycle_flags": _sql(
            _BASE_INPUTS,
            """SELECT 'renewal_due' AS flag, contract_end - DATE '2026-09-11' BETWEEN 0 AND 30 AS value, COUNT(*) AS rows
FROM product_inventory GROUP BY ALL
UNION ALL SELECT 'overdue_30', DATE '2026-09-11' - due_date >= 30 AS value, COUNT(*) FROM customer_bill GROUP BY ALL""",
        ),
        "publish_versions": _sql(
            _BASE_TAGS,
            """SELECT 'appended' AS state, campaign_suppressed, 2 * COUNT(*) AS customers FROM tags GROUP BY ALL
UNION ALL SELECT 'replaced', campaign_suppressed, COUNT(*) FROM tags GROUP BY ALL""",
        ),
        "verify_mismatches": _sql(
            {**_BASE_TAGS, **_changed_ctes("terminate")},
            f"""SELECT 'rebuild' AS against, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS reverse_mismatches
UNION ALL SELECT 'before', {_mismatch('tags_terminate', 'tags')}, {_mismatch('tags', 'tags_terminate')}""",
        ),
        "verify_counts": """
SELECT COUNT(*) AS customers, COUNT(DISTINCT c_custkey) AS distinct_customers, COUNT(*) AS expected_customers FROM customer""",
        "key_duplicates": """
SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1""",
        "orphan_rows": _sql(_BASE_INPUTS, _orphans()),
        "mask_msisdn": _sql(
            _XDR,
            """SELECT xdr_id, record_version, msisdn[:4] || regexp_replace(msisdn[5:], '[0-9]', '#', 'g') AS msisdn,
 regexp_replace(imsi, '[0-9]', '#', 'g') AS imsi, cell_id FROM xdr""",
        ),
        **{
            f"reader_{reader}": _sql(
                _XDR, f"SELECT xdr_id, record_version, {columns}, cell_id FROM xdr"
            )
            for reader, columns in {
                "billing": "msisdn, regexp_replace(imsi, '[0-9]', '#', 'g') AS imsi, roaming_partner",
                "network": "msisdn[:4] || regexp_replace(msisdn[5:], '[0-9]', '#', 'g') AS msisdn,"
                " imsi[:5] || regexp_replace(imsi[6:], '[0-9]', '#', 'g') AS imsi, roaming_partner",
                "analyst": "msisdn[:2] || regexp_replace(msisdn[3:], '[0-9]', '#', 'g') AS msisdn,"
                " regexp_replace(imsi, '[0-9]', '#', 'g') AS imsi,"
                " regexp_replace(roaming_partner, '[A-Z]', 'X', 'g') AS roaming_partner",
            }.items()
        },
        "redact_documents": f"SELECT doc_id, {_redacted('text')} AS text FROM documents",
        "run_rollup": _run_rollup(),
        "run_summary": _run_summary(),
        "metric_summary": _SUMMARY,
        "cost_scenarios": """
SELECT o_orderkey, rate, cru, active_seconds, idle_seconds, cadence_minutes, days, 'ILLUSTRATIVE_NOT_MEASURED' AS status,
 runs, rate * cru * active_seconds / 3600 AS active_work_proxy_per_cycle, rate * cru * seconds / 3600 AS vc_cost_per_cycle,
 rate * cru * seconds * runs / 3600 AS vc_cost_period, rate * cru * days * 24 AS always_on_period,
 active_seconds < cadence_minutes * 60 AS stable_cadence
FROM (SELECT *, days * 86400 / (cadence_minutes * 60) AS runs,
  CASE WHEN active_seconds + idle_seconds < 60 THEN 60 WHEN active_seconds + idle_seconds > cadence_minutes * 60
   THEN cadence_minutes * 60 ELSE active_seconds + idle_seconds END AS seconds
 FROM (SELECT o_orderkey, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS rate, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS cru,
   CAST(o_orderkey % 1000 AS DOUBLE) AS active_seconds, CAST(60 AS DOUBLE) AS idle_seconds,
   CAST(o_orderkey % 4 * 5 + 5 AS DOUBLE) AS cadence_minutes, CAST(30 AS DOUBLE) AS days FROM orders))""",
        "cost_projection": f"""
SELECT scenario, method, median AS measured_server_seconds_median, usd_per_cru_hour,
 median * usd_per_cru_hour / 3600 AS busy_capacity_proxy_usd,
 greatest(60, median + 60) * usd_per_cru_hour / 3600 AS modeled_vc_usd_per_cycle,
 greatest(60, median + 60) * usd_per_cru_hour / 3600 * 2880 AS modeled_vc_usd_per_30_days
FROM (SELECT scenario, split_part(metric, '_', 1) AS method, median FROM ({_run_summary()}) WHERE metric LIKE '%\\_server\\_seconds' ESCAPE '\\'),
 (SELECT CAST(p_size AS DOUBLE) / 8 * CAST(0.75 AS DOUBLE) AS usd_per_cru_hour FROM part WHERE p_partkey = 1)""",
        "storage_rollup": """
SELECT p_brand AS table_schema, CAST(SUM(p_size) AS BIGINT) * 1048576 AS all_object_bytes,
 CAST(COALESCE(SUM(p_size) FILTER (WHERE p_type IN ('PROMO', 'LARGE')), 0) AS BIGINT) * 1048576 AS derived_bytes,
 CAST(SUM(p_size) AS DOUBLE) / 1024 * CAST(0.025 AS DOUBLE) AS all_object_month_cost,
 CAST(COALESCE(SUM(p_size) FILTER (WHERE p_type IN ('PROMO', 'LARGE')), 0) AS DOUBLE) / 1024 * CAST(0.025 AS DOUBLE) AS derived_month_cost
FROM part WHERE starts_with(p_brand, 'Brand#') GROUP BY p_brand""",
        "distinct_rates": "SELECT p_brand, p_type FROM part GROUP BY ALL",
    }
    for case in CASES:
        text = _sql({**_BASE_INPUTS, **_changed_ctes(case)}, f"SELECT * FROM tags_{case}")
        sql[f"change_{case}"] = sql[f"incremental_{case}"] = text
    return sql
