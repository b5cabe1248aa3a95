"""Hand-made usage records and base rows, and the rules worked out in plain Python."""

import datetime as dt
from decimal import Decimal

from mastline import schemas

HOUR = dt.datetime(2026, 9, 10, 8)


def xdr(xdr_id, version=1, event=HOUR, late=dt.timedelta(0), **fields):
    """One record as a tuple in schema order."""
    row = {
        "xdr_id": xdr_id,
        "record_version": version,
        "record_type": "DATA",
        "msisdn": "6580000001",
        "imsi": "5250180000001",
        "cell_id": "SG-C-1",
        "rat": "4G",
        "apn": "internet",
        "roaming_partner": "",
        "event_ts": event,
        "ingest_ts": None if event is None else event + late,
        "duration_s": 0,
        "bytes_ul": 10,
        "bytes_dl": 100,
        "rated_amount": Decimal("1.5000"),
        "batch_id": 0,
        "batch_type": "NORMAL",
        **fields,
    }
    return tuple(row[name] for name in schemas.XDR.names)


def xdr_frame(spark, rows):
    return spark.createDataFrame(rows, schemas.XDR)


def frame(spark, table, rows):
    return spark.createDataFrame(rows, schemas.BASE[table])


def collected(df):
    return sorted(map(tuple, df.collect()), key=lambda row: [(v is None, str(v)) for v in row])


def expected_tags(base):
    """Tags of every customer, computed row by row."""
    rows = {name: [r.asDict() for r in getattr(base, name).collect()] for name in base.NAMES}
    family = {o["offering_id"]: o["family"] for o in rows["product_offering"]}
    owner = {a["account_id"]: a["customer_id"] for a in rows["billing_account"]}
    tags = {}
    for customer in rows["customer"]:
        cid = customer["customer_id"]
        lines = [
            line
            for line in rows["product_inventory"]
            if line["customer_id"] == cid
            and line["offering_id"] in family
            and line["status"] == "active"
        ]
        spend = sum(line["monthly_charge"] for line in lines)
        kinds = [family[line["offering_id"]] for line in lines]
        overdue = sum(
            bill["outstanding_amount"]
            for bill in rows["customer_bill"]
            if owner.get(bill["account_id"]) == cid and bill["overdue_30"]
        )
        complaints = sum(
            t["customer_id"] == cid and t["status"] == "open" and t["priority"] == "high"
            for t in rows["trouble_ticket"]
        )
        active = customer["status"] == "active"
        consent = customer["marketing_consent"] is True
        renewal = any(line["renewal_due"] for line in lines)
        tags[cid] = (
            "bss-v1",
            int(active and spend >= 100),
            int(active and len(lines) >= 2),
            int(active and overdue >= 50),
            int(active and spend >= 100 and (renewal or complaints > 0)),
            int(
                active
                and consent
                and "mobile" in kinds
                and "broadband" not in kinds
                and overdue == 0
                and complaints == 0
            ),
            int(not active or not consent or overdue > 0 or complaints > 0),
        )
    return tags


def tags_by_customer(df):
    return {row[0]: tuple(row[1:]) for row in df.collect()}
