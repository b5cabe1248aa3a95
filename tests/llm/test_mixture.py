import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mastline.llm import mixture as M
from mastline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, block int"


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def slow_targets(sizes, weights):
    fixed = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        left = sum(sizes) - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        over = [i for i in rest if share[i] > 3 * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: 3 * sizes[i] for i in over}


def check(rows, texts):
    """rows of (doc_id, size, source_size, target, taken, source)."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    wanted = slow_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, n, t in zip(order, sizes, wanted):
        assert {r["source_size"] for r in by[s]} == {n}
        assert [r["target"] for r in by[s]] == pytest.approx([t] * len(by[s]))
        assert abs(sum(r["taken"] for r in by[s]) - t) <= 2 * M.BLOCK
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in by[s])
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, len(words(t))) for d, t in texts)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op8_source_mixture"](spark, SF)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = found.join(docs.select("doc_id", "source"), "doc_id").collect()
    check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    again = QUERIES["op8_source_mixture"](spark, SF)
    assert found.exceptAll(again).count() == 0


@pytest.mark.parametrize("sizes", [[5], [0], [0, 0], [10, 10, 10], [1, 1000, 1, 1], [1, 0, 7, 50, 100000, 3], [3, 1, 1, 1, 1, 1, 900]])
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    found = M.targets(sizes, weights)
    assert found == pytest.approx(slow_targets(sizes, weights))
    assert sum(found) == pytest.approx(sum(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 4097])
def test_permutation(n):
    for key in (0, 7, 1 << 45):
        places = M.permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(places.tolist()) == list(range(n))
    if n > 999:
        assert not (M.permuted(np.arange(n), np.full(n, n), np.full(n, 1)) == places).all()


def test_draws_meet_the_quotas_and_look_alike():
    quotas = [50_000, 20_000, 0, 7]
    shards = list(M.draws(quotas, 1, 1000))
    assert np.sum(shards, axis=0).tolist() == quotas
    assert all(s.sum() == 1000 for s in shards[:-1])
    assert np.std([s[0] for s in shards[:-1]]) == pytest.approx((1000 * 5 / 7 * 2 / 7) ** 0.5, rel=0.4)
    assert [s.tolist() for s in M.draws(quotas, 1, 1000)] == [s.tolist() for s in shards]


def test_slots_hold_every_block_pass_after_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = M.Mixture(docs, shard=500)
    quota = {r["_number"]: (r["_quota"], r["_blocks"]) for r in mix.sources.collect()}
    slots = mix.slots.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) == sum(q for q, _ in quota.values())
    times = Counter((r["number"], r["block"]) for r in slots)
    for number, (q, n) in quota.items():
        held = [times[number, b] for b in range(n)]
        assert sum(held) == q and max(held) - min(held) <= 1


def test_mixed_texts_are_what_was_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in QUERIES["op8_source_mixture"](spark, SF).collect()}
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = Counter()
    for r in mixed.collect():
        found[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        rest = iter(words(texts[r["doc_id"]]))
        assert all(w in rest for w in words(r["text"]))  # in their order
    assert {d: n for d, n in taken.items() if n} == dict(found)


def test_odd_rows(spark):
    long = "w " * 60_000
    rows = [
        (1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (None, None, "y"), (2, "", "y"),
        (3, long, "z"), (4, " é\x85f\tg\n", "z"), (5, "one", ""),
    ]
    docs = spark.createDataFrame([(d, t, "en", s, 0, "i", 9) for d, t, s in rows], SCHEMA)
    found = M.Mixture(docs).documents().collect()
    assert Counter(r["size"] for r in found) == Counter(len(words(t)) for _, t, _ in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    sources = {r["source_size"]: r["target"] for r in found}
    # code point order: "", x, y, z, null
    assert sources == pytest.approx(
        dict(zip([1, 6, 0, 60_002, 2], slow_targets([1, 6, 0, 60_002, 2], [5, 2, 1, 5, 2])))
    )
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    mixed = mixed.collect()
    assert sum(len(words(r["text"])) for r in mixed) == sum(r["taken"] for r in found)
    assert sum(r["doc_id"] == 1 for r in mixed) == 6 and all(r["text"] == "a b c" for r in mixed if r["doc_id"] == 1)
    assert M.Mixture(docs.where(F.lit(False))).documents().count() == 0
    assert M.mixed_documents(docs.where(F.lit(False))).count() == 0
    none = docs.where("text IS NULL OR text = ''")
    assert [r["taken"] for r in M.Mixture(none).documents().collect()] == [0, 0]
    assert M.mixed_documents(none).count() == 0


def test_slots_are_made_by_as_many_tasks_as_planned(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, "w " * (500 + i), "en", "abc"[i % 3], 1, "x", 0) for i in range(60)], SCHEMA
    )
    slots = []
    for size in (M.SLOTS_PER_TASK, 100):
        monkeypatch.setattr(M, "SLOTS_PER_TASK", size)
        mix = M.Mixture(docs, shard=64)
        total = mix.slots.count()
        made = mix.slots.select(F.spark_partition_id().alias("task")).distinct().count()
        assert mix.slots.rdd.getNumPartitions() == -(-total // size)
        assert made > 1 or total <= size
        slots.append(sorted(map(tuple, mix.slots.collect())))
    assert slots[0] == slots[1]


def test_blocks_and_texts_go_through_one_worker_a_task(spark):
    """A join's filter for nulls must not have the blocks worked out a second time."""
    rows = [(i, "w " * (40 + i), "en", "abc"[i % 3], 1, "x", 0) for i in range(30)]
    mixed = M.mixed_documents(spark.createDataFrame(rows, SCHEMA))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # blocks of slots, cut texts
    texts = {r[0]: r[1].split() for r in rows}
    assert all(r["text"].split() == texts[r["doc_id"]][: len(r["text"].split())] for r in mixed.collect())


def test_blocks_are_not_broadcast_by_the_size_of_their_plan(spark):
    """A few rows of the plan become as many slots as the mix has blocks."""
    docs = spark.createDataFrame([(i, "w " * 500, "en", "ab"[i % 2], 1, "x", 0) for i in range(20)], SCHEMA)
    found = M.Mixture(docs).joined()
    found.collect()  # the plan that ran
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [number" in plan and "BroadcastHashJoin [number" not in plan
