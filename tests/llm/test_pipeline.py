import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from mastline.llm import quality_rules as Q
from mastline.llm.queries import tokenizer_path
from mastline.llm.runtime import stored
from tests.llm.test_decontaminate import slow_matches
from tests.llm.test_mixture import slow_targets, words
from tests.llm.test_quality_rules import slow_score
from tests.llm.test_simhash import slow_groups
from tests.llm.test_token_files import expected, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into each stage, and the last result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(steps):
    assert [n for n, _ in P.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination",
        "source_mixture", "token_id_output",
    ]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_stage(spark, steps):
    model = Q.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [d for d, t in texts(steps[0]) if slow_score(model, t) >= 0.3]
    assert sorted(d for d, _ in texts(steps[1])) == sorted(kept)
    assert 0 < len(kept) < steps[0].count()


def test_near_duplicate_stage(steps):
    keep = {group for _, _, group in slow_groups(texts(steps[1]))}
    assert sorted(texts(steps[2])) == sorted(x for x in texts(steps[1]) if x[0] in keep)


def test_decontamination_stage(spark, steps):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in items.collect()]
    hit = {m[0] for m in slow_matches(texts(steps[2]), items)}
    assert sorted(texts(steps[3])) == sorted(x for x in texts(steps[2]) if x[0] not in hit)


def test_mixture_stage(steps):
    sizes, taken = {}, {}
    for df, into in ((steps[3], sizes), (steps[4], taken)):
        for r in df.collect():
            into[r["source"]] = into.get(r["source"], 0) + len(words(r["text"]))
    order = sorted(sizes)
    wanted = slow_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, wanted):
        assert abs(taken.get(s, 0) - t) <= 128


def test_token_stage_and_run(spark, steps):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    library = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    found = plain(steps[5])
    want = expected(texts(steps[4]), library)
    assert sorted((r[0], r[2], r[3]) for r in found) == sorted((r[0], r[2], r[3]) for r in want)
    assert [r[0] for r in found] == [r[0] for r in want]
    assert plain(P.run(spark, SF)) == found
