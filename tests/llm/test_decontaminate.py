import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mastline.llm import decontaminate as D
from mastline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_similarity(a, b):
    k = min(5, len(a), len(b))
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    shared = sum((x & y).values())
    return shared / (sum(x.values()) + sum(y.values()) - shared)


def slow_matches(docs, items):
    """(doc, item, first word, words, similarity) of the best window, by trying all."""
    out = []
    items = [(i, slow_words(t)) for i, t in items]
    for doc, text in docs:
        words = slow_words(text)
        grams = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in range(1, 6)}
        for item, want in items:
            k = min(5, len(want))
            if not want or not grams[k] & {tuple(want[i : i + k]) for i in range(len(want) - k + 1)}:
                continue
            n = min(len(want), len(words))
            best = max(
                ((slow_similarity(words[s : s + n], want), -s) for s in range(len(words) - n + 1)),
            )
            if best[0] >= 0.8:
                out.append((doc, item, -best[1], n, best[0]))
    return sorted(out, key=str)


def plain(df):
    return sorted(
        ((r["doc_id"], r["item_id"], r["first_word"], r["n_words"], r["similarity"]) for r in df.collect()),
        key=str,
    )


def test_whole_table_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = plain(QUERIES["op2_benchmark_decontamination"](spark, SF))
    assert found == slow_matches(docs, items)
    assert found


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"new{rng.randrange(99)}"
        elif kind < 0.7:
            words.insert(at, f"new{rng.randrange(99)}")
        elif len(words) > 3:
            del words[at]
    return words


def test_edited_copies_equal_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "é"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 12, 40, 80, 300])))) for i in range(60)]
    docs = []
    for d in range(150):
        _, text = rng.choice(items)
        body = edited(rng, text.split(), rng.choice([0, 0, 1, 2, 4]))
        around = rng.choices(vocabulary, k=rng.randrange(80))
        cut = rng.randrange(len(around) + 1)
        docs.append((d, ("\n" if d % 3 else " -- ").join([*around[:cut], *body, *around[cut:]]).upper()))
    index = D.Items(items)
    found = [
        (docs[t][0], index.ids[i], s, n, v)
        for t, i, s, n, v, _ in index.search([t.encode() for _, t in docs])
    ]
    assert sorted(found, key=str) == slow_matches(docs, items)


def test_blocks_find_every_print_in_the_radius():
    rng = np.random.default_rng(0)
    words = [(i, " ".join(f"x{j}" for j in rng.integers(0, 999, 30))) for i in range(100)]
    index = D.Items(words)
    prints = np.concatenate([index.prints ^ np.uint64(m) for m in rng.integers(0, 1 << 22, 40)])
    place, item = index.near(prints)
    near = np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= D.RADIUS
    assert sorted(zip(place.tolist(), item.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(near))))


def test_a_word_longer_than_a_step():
    long = "a" * (3 * D._STEP)
    index = D.Items([(1, f"one {long} two three four five"), (2, "six seven eight nine ten eleven")])
    found = list(index.search([f"zero one {long} two three four five".encode(), b"", b"SIX seven, eight nine ten eleven"]))
    assert [(t, index.ids[i], s, n) for t, i, s, n, *_ in found] == [(0, 1, 1, 6), (2, 2, 0, 6)]


def test_odd_rows(spark):
    schema = "doc_id long, text string, item_id string, bits int"
    rows = [
        (1, "x the quick brown fox jumps over it"), (1, "x the quick brown fox jumps over it"),
        (None, "The Quick BROWN fox; jumps over\nit"), (2, None), (3, ""), (4, "clean"), (5, "the quick " * 30_000),
    ]
    docs = spark.createDataFrame([(*r, "q", 2) for r in rows], schema)
    items = spark.createDataFrame(
        [(7, "the quick brown fox jumps over it", 1), (7, "the quick brown fox jumps over it", 2), (8, None, 1), (9, "...", 1), (None, "unseen words only", 0)],
        "item_id long, text string, doc_id int",
    )
    assert plain(D.matches(docs, items)) == sorted([(1, 7, 1, 7, 1.0), (1, 7, 1, 7, 1.0), (None, 7, 0, 7, 1.0)], key=str)
    assert plain(D.matches(docs, items, block_items=1)) == plain(D.matches(docs, items))
    assert D.clean(docs, items).columns == docs.columns
    assert sorted(r[0] for r in D.clean(docs, items).collect()) == [2, 3, 4, 5]
    assert D.matches(docs, items.where(F.lit(False))).count() == 0
    assert D.clean(docs, items.where(F.lit(False))).count() == 7
    assert D.matches(docs.where(F.lit(False)), items).count() == 0
