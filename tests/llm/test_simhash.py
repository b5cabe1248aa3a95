import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mastline.llm import simhash
from mastline.llm.components import components
from mastline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp int, _root string"


def slow_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=2):
    prints = [slow_print(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= radius and group[j] < group[i]:
                    group[i], changed = group[j], True
    ids = {}
    for (doc, _), g in zip(rows, group):
        ids.setdefault(g, []).append(doc)
    least = {g: min((d for d in x if d is not None), default=None) for g, x in ids.items()}
    return sorted(
        ((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group)), key=str
    )


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = QUERIES["op6_simhash_near_dedup"](spark, SF)
    assert sorted(map(tuple, found.collect()), key=str) == slow_groups(rows)


@pytest.mark.parametrize("n,spread", [(0, 64), (1, 64), (3000, 64), (3000, 14)])
def test_index_finds_every_pair(n, spread):
    rng = np.random.default_rng(n + spread)
    prints = np.unique(rng.integers(0, 1 << spread, n, np.uint64, endpoint=False) if spread < 64 else rng.integers(0, 2**64 - 1, n, np.uint64))
    if spread == 64 and n > 1:  # some neighbours
        prints = np.unique(np.concatenate([prints, prints[:500] ^ np.uint64(5)]))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    index = simhash.GrayIndex(prints)
    found = np.zeros_like(near)
    place = {int(p): i for i, p in enumerate(prints)}
    to = np.array([place[int(p)] for p in index.prints], int)
    for q, p in index.search(prints, 2):
        assert not found[q, to[p]].any()
        found[q, to[p]] = True
    assert (found == near).all()


def test_gray_rank_inverts_the_gray_code():
    ranks = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_links_over_many_segments(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64 - 1, 300, np.uint64)
    chain = base ^ (np.uint64(3) << rng.integers(0, 62, 300).astype(np.uint64))
    prints = np.unique(np.concatenate([base, chain, np.arange(200, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    found = {
        r["node"]: r["root"]
        for r in components(simhash.links(df, 2, segment_size=40)).collect()
    }
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    reach = near
    while True:
        more = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
        if (more == reach).all():
            break
        reach = more
    signed = prints.view(np.int64)
    for i, p in enumerate(signed):
        assert found.get(int(p), int(p)) == signed[reach[i]].min()


def test_odd_rows(spark):
    long = "w1 W2 w3 " * 30_000
    rows = [
        (3, None), (2, ""), (5, " \n"), (None, "a b"), (None, "a b"), (9, "A B"), (9, "A B"),
        (7, long), (8, long), (None, "only me here now"), (4, "x" * 10), (1, "\x85É b"),
    ]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    found = simhash.near_duplicates(docs)
    assert sorted(map(tuple, found.collect()), key=str) == slow_groups(rows)
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted(
        [(2, ""), (9, "A B"), (7, long), (None, "only me here now"), (4, "x" * 10), (1, "\x85É b")],
        key=str,
    )
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0
    assert simhash.distinct_documents(docs.where(F.lit(False))).count() == 0


def test_distinct_documents_leaves_any_column_alone(spark):
    """Names the operator uses itself, and types that cannot be ordered."""
    names = ["_fp", "_id", "_place", "_root", "_kept", "_row", "_doc", "component_id", "id", "fp"]
    docs = spark.range(12).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "one two three four")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("five six seven "), F.col("id").cast("string")))
        .alias("text"),
        *(F.concat(F.lit(f"{n} "), F.col("id").cast("string")).alias(n) for n in names),
        F.create_map(F.lit("k"), F.col("id")).alias("a map"),
        F.array("id").alias("a.list"),
    )
    docs = docs.unionAll(docs)
    kept = simhash.distinct_documents(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    rows = {r["doc_id"]: r for r in kept.collect()}
    groups = {g for _, _, g in slow_groups([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert rows.keys() == groups
    assert kept.count() == len(groups)
    for doc_id, row in rows.items():
        assert [row[n] for n in names] == [f"{n} {doc_id}" for n in names]
        assert row["a map"] == {"k": doc_id} and row["a.list"] == [doc_id]
