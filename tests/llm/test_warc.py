import hashlib

import pytest
from pyspark.sql import functions as F

from mastline.llm import warc as W
from mastline.llm.queries import ORACLE, QUERIES
from mastline.workspace import new_folder
from tests.compare import compare, database

SF = "/root/testdata/sf0.01"


def test_whole_table_equals_sql(spark):
    name = "op5_warc_archive"
    assert compare(spark, database(SF), SF, QUERIES[name], ORACLE[name]) is None
    found = QUERIES[name](spark, SF)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def archive(spark, rows):
    schema = "page_id long, url string, html string, digest string, payload int, place int"
    folder = new_folder(spark, "warc")
    W.write(spark.createDataFrame([(*r, "d", 1, 2) for r in rows], schema), folder)
    return folder


LONG = "é" * 50  # 100 bytes
ROWS = [
    (5, "u5", LONG), (3, "u3", LONG), (3, "u3", LONG), (None, "n", LONG), (9, None, "x" * 99), (8, "u", "x" * 99),
    (1, "bad\r\nWARC-Type: fake", None), (2, "", ""), (None, "", "y" * 100), (None, "", "y" * 100), (7, "z", "long " * 200_000),
]


def test_odd_rows(spark):
    folder = archive(spark, ROWS)
    found = sorted(map(tuple, W.listed(spark, folder).collect()), key=str)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    one = lambda p, t, kind="response", to=None: (p, len((t or "").encode()), digest(t), kind, to)
    want = [
        one(5, LONG, "revisit", 3), one(3, LONG), one(3, LONG, "revisit", 3), one(None, LONG, "revisit", 3),
        one(9, "x" * 99), one(8, "x" * 99), one(1, None), one(2, ""), one(None, "y" * 100), one(None, "y" * 100, "revisit"),
        one(7, "long " * 200_000),
    ]
    assert found == sorted(want, key=str)
    assert spark.read.parquet(f"{folder}/payloads").count() == 5


def parsed(record):
    """A WARC record taken apart by the rules of the format."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    assert lines[0] == b"WARC/1.1"
    fields = dict(x.split(b": ", 1) for x in lines[1:])
    block = rest[: int(fields[b"Content-Length"])]
    assert rest[len(block) :] == b"\r\n\r\n"
    http, _, body = block.partition(b"\r\n\r\n")
    assert http.startswith(b"HTTP/1.1 200 OK\r\n")
    return fields, body


def test_records_are_whole(spark):
    pages = {p: h for p, _, h in ROWS}
    for row in W.records(spark, archive(spark, ROWS)).collect():
        fields, body = parsed(bytes(row["record"]))
        page = fields[b"WARC-Record-ID"][10:].partition(b":")[0]
        if page:
            assert bytes(row["payload"]) == (pages[int(page)] or "").encode()
        assert body == (bytes(row["payload"]) if fields[b"WARC-Type"] == b"response" else b"")
        sha = hashlib.sha256(bytes(row["payload"])).hexdigest()
        assert fields[b"WARC-Payload-Digest"].decode() == f"sha256:{sha}"
        assert (b"WARC-Refers-To" in fields) <= (fields[b"WARC-Type"] == b"revisit")
        assert fields.get(b"WARC-Target-URI") in {(u or "").replace("\r\n", "%0D%0A").encode() for _, u, _ in ROWS} | {None}


def test_changed_and_missing_payloads_are_errors(spark):
    folder = archive(spark, ROWS)
    heads, payloads = spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/payloads")
    for name, broken in (
        ("changed", payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))),
        ("missing", payloads.limit(1)),
    ):
        other = new_folder(spark, name)
        heads.write.parquet(f"{other}/records")
        broken.write.parquet(f"{other}/payloads")
        with pytest.raises(Exception, match="payload not as its digest"):
            W.listed(spark, other).collect()


def test_empty_table(spark):
    folder = archive(spark, [])
    assert W.listed(spark, folder).count() == 0


def test_records_have_the_fields_that_the_format_requires(spark):
    rows = [bytes(r["record"]) for r in W.records(spark, archive(spark, ROWS)).collect()]
    found = [parsed(record)[0] for record in rows]
    ids = [fields[b"WARC-Record-ID"] for fields in found]
    assert len(set(ids)) == len(ids) == len(ROWS)
    responses = {f[b"WARC-Record-ID"] for f in found if f[b"WARC-Type"] == b"response"}
    for fields in found:
        assert {b"WARC-Type", b"WARC-Date", b"Content-Length"} <= set(fields)
        assert fields[b"WARC-Date"] == W.NO_DATE.encode()
        if fields[b"WARC-Type"] == b"revisit":
            assert fields[b"WARC-Refers-To"] in responses
            assert b"WARC-Profile" in fields


def test_given_dates_and_text_ids(spark):
    rows = [("a:b>c", "u", LONG, "2026-01-02T03:04:05Z"), ("é 1", "u", LONG, None), ("z", "u", "", None)]
    folder = new_folder(spark, "warc")
    W.write(spark.createDataFrame(rows, "page_id string, url string, html string, day string"), folder, date=F.col("day"))
    found = {tuple(r)[0]: tuple(r)[3:] for r in W.listed(spark, folder, "string").collect()}
    assert found == {"a:b>c": ("response", None), "é 1": ("revisit", "a:b>c"), "z": ("response", None)}
    dates = [parsed(bytes(r["record"]))[0][b"WARC-Date"].decode() for r in W.records(spark, folder).collect()]
    assert sorted(dates) == sorted(["2026-01-02T03:04:05Z", W.NO_DATE, W.NO_DATE])
