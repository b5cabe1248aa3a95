import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from mastline.llm import merkle
from mastline.llm.queries import ORACLE, QUERIES
from tests.compare import compare, database

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, found string, pos long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row):
    fields = [row[f] for f in merkle.FIELDS]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def slow_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def slow_way(levels, place):
    """Runs with the place in them, from the leaf up."""
    for row in levels[:-1]:
        start = place // 3 * 3
        yield row[start : start + 3], place - start
        place //= 3


def slow_manifest(rows):
    leaves = sorted(
        (
            (r["source"] is not None, r["source"] or ""), (r["doc_id"] is not None, r["doc_id"] or 0),
            slow_leaf(r), r,
        )
        for r in map(lambda r: _Row(r), rows)
    )
    groups = [list(g) for _, g in groupby(leaves, key=lambda x: x[0])]
    trees = [slow_levels([x[2] for x in g]) for g in groups]
    top = slow_levels([t[-1][0] for t in trees])
    out = []
    for at, (group, tree) in enumerate(zip(groups, trees)):
        for place, (_, _, leaf, row) in enumerate(group):
            changed = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                changed["text"] = row["text"] and row["text"].replace("\n", "")
            digest, proof = slow_leaf(changed), ""
            for run, slot in [*slow_way(tree, place), *slow_way(top, at)]:
                proof += "".join(run[:slot] + run[slot + 1 :])
                digest = H("".join([*run[:slot], digest, *run[slot + 1 :]]))
            root = top[-1][0]
            out.append((row["doc_id"], leaf, tree[-1][0], root, H(proof), digest, digest == root))
    return sorted(out, key=str)


class _Row(dict):
    def __lt__(self, other):
        return False


def run(docs, height):
    tampered = F.expr(
        "CASE WHEN crc32(CAST(doc_id AS STRING)) % 2 = 0 THEN replace(text, '\\n', '') ELSE text END"
    )
    return merkle.checked_documents(docs, tampered, height).drop("source")


@pytest.mark.parametrize("height", [7, 2, 1])
def test_odd_rows_against_brute_force(spark, height):
    """Small blocks make several rounds; the table has null, empty, long and repeated rows."""
    rows = [(i, f"text {i}\nmore" if i % 4 else "one line", "en", "hot", i) for i in range(100)]
    rows += [(i % 3, "again\n", "de", "cold", 6) for i in range(30)]
    rows += [(7, None, None, "single", None), (None, "no id\n", "en", None, 1), (None, "", "fr", None, 0)]
    rows += [(5, "", "en", "", 0), (6, "x" * 300_000 + "\n", "en", "", 1), (-4, "ü\n", "de", "é", 2)]
    rows += [(9, f"same id {i}\n", "en", f"s{i % 11}", i) for i in range(25)]
    docs = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], SCHEMA)
    want = slow_manifest([dict(zip(merkle.FIELDS, (r[0], r[3], r[2], r[4], r[1]))) for r in rows])
    found = sorted(map(tuple, run(docs, height).collect()), key=str)
    assert found == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_lone_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\n", "en", "s", 2, 1, "f", 2)], SCHEMA)
    (row,) = merkle.checked_documents(docs).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"]
    assert row["proof_sha256"] == H("") and row["verified"]
    assert merkle.checked_documents(docs.where("doc_id > 1")).count() == 0


def test_a_parent_resumes_its_retained_state():
    leaves = [H(str(i)) for i in range(11)]
    tree = merkle.Subtree(leaves, merkle.levels_above(11))
    levels = slow_levels(leaves)
    assert tree.rows == levels
    for place in range(11):
        changed = [*leaves[:place], H("other"), *leaves[place + 1 :]]
        assert tree.fold(place, H("other")) == slow_levels(changed)[-1][0]
        assert tree.fold(place, leaves[place]) == levels[-1][0]


def test_whole_table_equals_sql(spark):
    name = "op11_merkle_manifest"
    assert compare(spark, database(SF), SF, QUERIES[name], ORACLE[name]) is None
