import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mastline.llm import phrases
from mastline.llm.queries import ORACLE, QUERIES
from tests.compare import compare, database

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, phrase string, length int, shard string"


def slow_counts(rows):
    """Every phrase of up to three words, by language."""
    seen, size = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            for n in (1, 2, 3):
                seen.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return seen, size


def slow_collocations(rows, least=10, top=2000):
    seen, size = slow_counts(rows)
    found = {}
    often = {key: a for key, a in seen.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in often.items():
        cuts = []
        for k in range(1, len(words)):
            l, r = seen[lang, words[:k]], seen[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        held = any(
            other == lang and 100 * f >= 50 * a
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            for (other, longer), f in often.items() if len(longer) > len(words)
        )
        if not held:
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, size[lang], -score)
        for lang, group in found.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(group)[:top], 1)
    )


def frame(spark, rows):
    """Rows of (text, lang) among columns whose names the operator uses itself."""
    return spark.createDataFrame([(1, t, l, "p", 9, "s") for t, l in rows], SCHEMA)


ODD = (
    [("New York is big. new york IS big! Rio de Janeiro; rio\tde  janeiro", "en")] * 9
    + [("the new york\nthe rio de janeiro\x0bthe end", None), (None, "en"), ("", None), (" ., ", "de")]
    + [("\x00 a b\x85c É É a b", "fr")] * 12
    + [("ba ba ba ba ba ba ba ba ba ba ba ba ba", "und"), ("x y " * 60_000, "long"), ("tie a. tie b. " * 10, "t")]
    + [("only three words " * 3, f"l{i}") for i in range(12)]
)


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_odd_rows_against_brute_force(spark, shards):
    found = phrases.collocations(frame(spark, ODD), shards=shards)
    assert sorted(map(tuple, found.collect())) == slow_collocations(ODD)


def test_counts_are_exact_with_full_slots(spark):
    """Sixteen slots for thousands of phrases: all are counted, nothing is left out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, size = slow_counts([(r["text"], r["lang"]) for r in docs.collect()])
    want = {(lang, len(w), " ".join(w), f) for (lang, w), f in seen.items() if f >= 10}
    for bits in (4, 24):
        found, sizes = phrases.counted_phrases(docs, shards=3, bits=bits)
        assert set(map(tuple, found.collect())) == want
        assert {r["lang"]: r["n"] for r in sizes.collect()} == dict(size)


def test_ranks_ties_and_top(spark):
    rows = [(" ".join(f"a{i} b{i}." for i in range(40)), "en")] * 10
    found = phrases.collocations(frame(spark, rows), top=7).orderBy("rank").collect()
    assert [r["phrase"] for r in found] == sorted(f"a{i} b{i}" for i in range(40))[:7]
    assert {(r["score"], r["a"]) for r in found} == {(1_000_000, 10)}


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(phrases, "_CHUNK", 20)
    text = phrases.normalised(b"One two three. Four, five six seven eight nine ten eleven\nTwelve")
    parts = list(phrases._cut(text))
    assert b"".join(parts) == text and len(parts) > 1
    assert [t for p in parts for t in phrases.tokens_of([p])] == phrases.tokens_of([text])


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000_007, 5_000_000_000_000_001, 4_000_000_000_000_001)], "a long, l long, r long")
    wide = df.select(*(F.col(c).cast("decimal(19,0)").alias(f"wide_{c}") for c in "alr"))
    found = wide.select(phrases.score_column().alias("s")).first()["s"]
    assert found == 1_000_000 * 3_000_000_000_000_007**2 // (5_000_000_000_000_001 * 4_000_000_000_000_001)


def test_empty_table(spark):
    docs = frame(spark, ODD).where(F.lit(False))
    assert phrases.collocations(docs).count() == 0


def test_whole_table_equals_sql(spark):
    name = "op13_phrase_collocations"
    assert compare(spark, database(SF), SF, QUERIES[name], ORACLE[name]) is None


def test_numbers_of_phrases_are_those_of_spark(spark):
    rows = [(i * 7_919_000_000_000_003 - 2**62, -i, 2**63 - 1 - i) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for names in ("a", "ab", "abc"):
        want = [r[0] for r in df.select(F.xxhash64(*names)).collect()]
        arrays = [np.array([r["abc".index(n)] for r in rows], np.int64) for n in names]
        assert phrases.hashed(*arrays).view(np.int64).tolist() == want


def test_another_seed_when_two_words_share_a_number(spark, monkeypatch):
    """Counting starts again; the words' numbers are made by the workers."""
    seeds = []
    original = phrases._counted

    def counted(docs, least, shards, bits, seed):
        seeds.append(seed)
        return None if seed < 2 else original(docs, least, shards, bits, seed)

    monkeypatch.setattr(phrases, "_counted", counted)
    found = phrases.collocations(frame(spark, ODD))
    assert sorted(map(tuple, found.collect())) == slow_collocations(ODD)
    assert seeds == [0, 1, 2]


def test_scores_on_both_sides_of_64_bits(spark):
    """Products are worked out in longs while they fit: the limits, and one more."""
    fits = (3_000_000, 3_000_000_000, 3_000_000_000)
    rows = [fits, (10, 10, 11), *(tuple(n + (i == j) for j, n in enumerate(fits)) for i in range(3))]
    df = phrases.with_score(spark.createDataFrame(rows, "a long, l long, r long"))
    for r in df.collect():
        assert r["score"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"])
    plan = df.where("a < 1000")._jdf.queryExecution().optimizedPlan().toString()
    assert "a#" in plan and "* 1000000)" in plan


def test_words_are_numbered_without_a_list_of_them(monkeypatch):
    """Neither counts nor numbers need every word as an object of its own."""
    monkeypatch.setattr(phrases, "tokens_of", None)
    texts = [phrases.normalised(t) for t in (b"a  B\ta,b", b"", b"\xc3\xa9 a b")]
    monkeypatch.setattr(phrases, "_SPLIT", 5)  # more than one part
    counter = phrases._Counter("en", texts, 8, 0)
    assert counter.words.to_pylist() == [b"\xff", b"a", b"b", b"\xc3\xa9"]
    assert counter.ids.tolist() == [0, 1, 2, 1, 0, 2, 0, 0, 3, 1, 2, 0]


def test_rows_are_handed_on_a_few_at_a_time(monkeypatch):
    """Neither end of the pipe holds the counts of a whole chunk once more."""
    monkeypatch.setattr(phrases, "_ROWS", 3)
    text = b"one two three four five six seven " * 2
    counter = phrases._Counter("en", [phrases.normalised(text)], 8, 0)
    reached = {n: np.zeros(256, np.uint8) for n in (1, 2)}
    batches = list(counter.counted(0, 1, reached))
    assert max(b.num_rows for b in batches) == 3
    rows = [r for b in batches for r in b.to_pylist()]
    assert [sum(r["count"] for r in rows if r["length"] == n) for n in (1, 2, 3)] == [14, 13, 12]
    assert [r["word"] for r in rows if r["length"] == 1] == "one two three four five six seven".split()


def test_only_what_may_be_among_the_first_is_named(spark, monkeypatch):
    """Scores go by numbers; words are looked up for the first and what ties with the last."""
    given, original = [], phrases._named
    monkeypatch.setattr(phrases, "_named", lambda rows, *a: given.append(rows.count()) or original(rows, *a))
    often = " ".join(f"c{i} d{i}." for i in range(5)) + " x y z."
    rows = [(" ".join(f"a{i} b{i}." for i in range(40)), "en")] * 10 + [(often, "en")] * 12 + [(often, "fr")] * 11 + [("c0 e.", "en")] * 11
    for top in (3, 6, 9):
        found = phrases.collocations(frame(spark, rows), top=top)
        assert sorted(map(tuple, found.collect())) == slow_collocations(rows, top=top)
    assert sum(given[:2]) < 20  # of more than fifty
