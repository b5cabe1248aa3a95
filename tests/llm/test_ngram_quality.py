import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mastline.llm import ngram_quality as N
from mastline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def split(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def slow_base(text):
    w = split(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(covered), failed


def counts(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op7_quality_rules"](spark, SF).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 1000
    return rows


def test_base_counts_of_whole_table(found):
    for row in found:
        assert counts(row) == slow_base(row["text"])
        assert row["kept"] == (not row["base_failed"] and row["llr"] >= N.THRESHOLD)


def test_junk_goes_and_clean_text_stays(spark, found):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    open_ = [r for r in found if not r["base_failed"] and r["doc_id"] in labels]
    good = [r["kept"] for r in open_ if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in open_ if labels[r["doc_id"]] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_ratio_equals_plain_python(spark):
    rng = random.Random(2)
    make = lambda vocabulary: [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(30)]
    target, raw = make(["good", "Fine", "7", "word", "a1"]), make(["good", "bad###", "|", "42", "Word"])
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    buckets = 64
    ratio = N.weights(N.counts(frame(target), buckets=buckets), N.counts(frame(raw), buckets=buckets), buckets)
    grams = lambda t: (lambda w: [(x,) for x in w] + list(zip(w, w[1:])))(split(t.lower()))
    every = {g for t in target + raw for g in grams(t)}
    bucket = {}
    for n in (1, 2):
        rows = spark.createDataFrame([g for g in every if len(g) == n], ["a", "b"][:n])
        hashed = F.xxhash64("a") if n == 1 else F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))
        for r in rows.withColumn("k", F.pmod(hashed, F.lit(buckets))).collect():
            bucket[tuple(r)[:n]] = r["k"]
    t, r = (Counter(bucket[g] for t in texts for g in grams(t)) for texts in (target, raw))
    share = [(r[b] + 1) / (r.total() + buckets) for b in range(buckets)]
    prior = N.PRIOR * buckets
    assert ratio == pytest.approx(
        [math.log((t[b] + prior * share[b]) / (t.total() + prior) / share[b]) for b in range(buckets)]
    )
    judged = N.judged(frame(target + raw).withColumn("t", F.col("text")), ratio).collect()
    for row in judged:
        own = grams(row["t"])
        assert row["llr"] == pytest.approx(sum(ratio[bucket[g]] for g in own) / len(own) if own else 0.0)


def test_odd_rows(spark):
    rng = random.Random(1)
    texts = [
        None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "x " * 70_000,
        "one\ntwo\none\n\n \n \none ", "\x0bé\x85ß\x0c—", " ".join(rng.choices("ab", k=80)),
        " ".join(rng.choices("abcdefghij", k=300)), "k\r\nk\r\nk",
    ]
    schema = "doc_id long, text string, kept string, row int, w int, base string"
    docs = spark.createDataFrame([(i, t, "z", 1, 2, "b") for i, t in enumerate([*texts, *texts])], schema)
    found = N.judged(docs, [0.0] * 8)
    assert [c for c in found.columns if c in docs.columns] == ["doc_id", "text", "row", "w", "base", "kept"]
    rows = found.collect()
    assert len(rows) == 2 * len(texts)
    for row in rows:
        assert counts(row) == slow_base(row["text"])
        assert row["kept"] is (not row["base_failed"]) and row["llr"] == 0.0
    assert N.judged(docs.where(F.lit(False)), [0.0]).count() == 0
    empty = N.counts(docs.where(F.lit(False)))
    assert N.weights(empty, empty, 4) == pytest.approx([0.0] * 4)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["doc_id"] for r in N.trusted(docs, labels).collect()] == [1]
    many = spark.range(9).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert N.trusted(docs, many, max_trusted=4).count() == 4


def test_every_trusted_document_is_counted(spark):
    n = 20_500  # more than the bound there once was
    docs = spark.range(-1, n).selectExpr("id AS doc_id", "'one two' AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    labels = labels.unionAll(labels.limit(50))
    assert N.trusted(docs, labels).count() == n
    found = N.target_counts(docs, labels)
    assert sum(found.values()) == 3 * n
    assert N.target_counts(docs, labels, block=6_000) == found
    assert N.target_counts(docs, labels.where(F.lit(False))) == {}


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op7_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_pattern_or_comparison_is_worked_out_per_element(spark):
    """Splitting at one character and sorting in natural order are Spark's own fast paths."""
    texts = [" a\tb\x0b\fc\r\nd ", "\n\t ", "", None, "a b c\n \t\na b c\n\x0b\na b c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = N.judged(docs, [0.0] * 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(slow in plan for slow in ("array_sort", "translate(", "]+"))
    for row in found.collect():
        assert counts(row) == slow_base(row["text"])
    assert [r["w"] for r in docs.select(N.words(F.col("text")).alias("w")).collect()] == [
        ["a", "b", "c", "d"], [], [], [], ["a", "b", "c"] * 3
    ]
