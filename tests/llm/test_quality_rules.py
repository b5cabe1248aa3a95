import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mastline.llm import quality_rules as Q
from mastline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    lines = [x for x in text.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    of = lambda chars: sum(c in chars for c in text)
    return {
        "words": len(words),
        "word_length": share(sum(map(len, words)), len(words)),
        "distinct_words": share(len(set(words)), len(words)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        "line_words": share(len(words), len(lines)),
        "symbols": share(of("#*$%&|<>"), len(text)),
        "bars": share(of("|"), len(text)),
        "exclamations": share(of("!"), len(text)),
        "capitals": share(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(text)),
        "digits": share(of("0123456789"), len(text)),
        "stops": share(of(".,;:"), len(words)),
        "quotes": share(of("\"'()[]{}=/\\_@"), len(text)),
    }


def slow_score(model, text):
    stats = slow_statistics(text)
    total = model.intercept + sum(
        w for rule, w in model.weights if all(a < stats[n] <= b for n, a, b in rule.bounds)
    )
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return Q.fit(*tables)


def test_statistics_equal_plain_python(spark):
    texts = [None, "", " \n\n", "One two, TWO! 7", "a\nb\na\n\nx | y # $5\t(z)", "é ß " * 400, "w" * 9000]
    docs = spark.createDataFrame([(t, 1.0) for t in texts], "text string, _x double")
    for row in Q.with_statistics(docs).collect():
        assert row["stats"].asDict() == pytest.approx(slow_statistics(row["row"]["text"]))


def test_held_out_documents_are_ranked_well(tables, model):
    docs, labels = tables
    held = (
        model.score(docs).join(labels, "doc_id").where("crc32(CAST(doc_id AS STRING)) % 5 = 0").collect()
    )
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.97
    assert sum(g >= 0.3 for g in good) > 0.97 * len(good)
    assert sum(b < 0.3 for b in bad) > 0.9 * len(bad)


def test_compiled_rules_equal_plain_python(tables, model):
    assert 0 < len(model.weights) < 200 and all(w for _, w in model.weights)
    for row in model.score(tables[0]).collect():
        assert row["score"] == pytest.approx(slow_score(model, row["text"]))


def test_query_and_held_out_rule(spark):
    found = QUERIES["op1_quality_classifier"](spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_labels_of_held_out_documents_are_not_read(spark, tables, model):
    docs, labels = tables
    held = F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0")
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.fit(docs.withColumn("lang", F.lit("?")), turned) == model
    assert Q.training_labels(labels, 7).count() == 7


def test_odd_rows(spark, model):
    schema = "doc_id long, text string, quality string, _stats int, _score string, row int"
    rows = [(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "long " * 100_000)]
    docs = spark.createDataFrame([(*r, "1", 5, "s", 3) for r in rows], schema)
    for row in model.score(docs, name="grade").collect():
        assert row["grade"] == pytest.approx(slow_score(model, row["text"]))
    assert Q.accepted(docs, model).columns == docs.columns
    assert Q.accepted(docs.where(F.lit(False)), model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert Q.fit(docs, nothing) == Q.RuleModel((), 0.0)
    same = spark.createDataFrame([(1, 1, "x"), (2, 1, None), (None, 0, "y"), (2, None, "")], nothing.schema)
    for row in Q.fit(docs, same).score(docs, name="s").collect():
        assert 0.5 <= row["s"] <= 1
    assert Q.fit(docs.where(F.lit(False)), same).score(docs, name="s").first()["s"] == 0.5
