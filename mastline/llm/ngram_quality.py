"""Quality rules: hashed n-gram log-likelihood ratio between target and raw corpus.

Words and word pairs of the trusted texts and of all texts are counted in hashed buckets,
two multinomials; the target takes in every trusted document, the raw counts every document.
A document's score is the mean over its n-grams of log(target share / raw share) of their
buckets; what lies below a fixed threshold is not kept. Everything is built-in column
functions: the counts are grouped sums, the weights one literal array, and the score a fold
over the words of a text.

The number of buckets is that of the model's parameters and need not follow the corpus: more
texts make each share more exact, and rare n-grams that meet in a bucket weigh little in a
mean over all n-grams of a text.
"""

import math
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8_192
PRIOR = 16  # n-grams a bucket that the target is taken to have seen as the raw corpus has them
#: Trusted ids that are broadcast at a time, about; the texts are read once for each block.
BLOCK = 1 << 20
THRESHOLD = -0.05


def words(text: Column) -> Column:
    """The words of a text, split by ASCII white space; none for null."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")  # one character: split without a pattern


def _hashes(w: Column) -> Column:
    """A hash of each word in lower case; pairs are told apart by the hash of these."""
    return F.transform(w, lambda x: F.xxhash64(F.lower(x)))


def _pairs(h: Column, function) -> Column:
    """The function of each word's hash and the next one's."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), function)


def _single(buckets: int):
    return lambda a: F.pmod(a, F.lit(buckets)).cast("int")


def _pair(buckets: int):
    return lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")


def counts(texts: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: how many n-grams of all texts fall into each bucket."""
    h = F.col("h")
    grams = F.concat(F.transform(h, _single(buckets)), _pairs(h, _pair(buckets)))
    return (
        texts.select(words(F.col(text_column)).alias("w"))
        .select(_hashes(F.col("w")).alias("h"))
        .select(F.explode(grams).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"))
    )


def weights(
    target: DataFrame | Mapping[int, int], raw: DataFrame, buckets: int = BUCKETS
) -> list[float]:
    """The log ratio of each bucket, of two tables ``(bucket, n)``; one row a bucket at most.

    Each raw bucket counts one more. The target starts from ``PRIOR`` n-grams a bucket, spread
    like the raw corpus, so that a small target says little. No target at all gives zeros.
    """
    wanted = target if isinstance(target, Mapping) else dict(target.collect())
    found = dict(raw.collect())
    n, m = sum(found.values()) + buckets, sum(wanted.values()) + PRIOR * buckets
    shares = [(found.get(b, 0) + 1) / n for b in range(buckets)]
    return [
        math.log((wanted.get(b, 0) + PRIOR * buckets * share) / m / share)
        for b, share in enumerate(shares)
    ]


def base(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Columns ``row``, ``h`` (hashes of lower-case words), and the counts of the base rules, in ``base``.

    A null text has no words. Words and windows are told apart by 64-bit hashes.
    """
    x, n = F.col("x"), F.size("w")
    split = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        F.coalesce(docs[text_column], F.lit("")).alias("text"),
        words(docs[text_column]).alias("w"),
    ).select("*", _hashes(F.col("w")).alias("h"), F.transform("w", lambda a: F.xxhash64(a)).alias("x"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\f\r")) != "")
    hashed = split.select(
        "*",
        lines.alias("lines"),
        F.when(
            n >= 4,
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)),
            ),
        ).alias("hashes"),
    )
    # most texts repeat nothing; only the others are sorted with their places
    ordered = hashed.select(
        "*",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ordered"),
    )
    before = F.slice("ordered", 1, F.size("ordered") - 1)
    same = F.zip_with(  # neighbours of equal hash: the places of both
        before,
        F.slice("ordered", 2, F.greatest(F.size("ordered"), F.lit(1))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    places = F.flatten(F.array_compact(same))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))
    counted = {
        "n_words": n,
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("ordered").isNotNull(), F.size(covered)).otherwise(0),
    }
    return ordered.select(
        "row", "h", F.struct(*(c.cast("long").alias(k) for k, c in counted.items())).alias("base")
    )


def judged(
    docs: DataFrame,
    ratio: list[float],
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` and the base counts, ``base_failed``, ``llr`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows. ``llr`` is
    the mean log ratio of the n-grams, zero without words. ``kept``: passed both. The verdict
    on a text depends on that text and the weights alone. Columns of ``docs`` with one of
    these names are replaced.
    """
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folded to a literal
    at = lambda bucket: F.get(table, bucket)
    h, buckets = F.col("h"), len(ratio)
    singles = F.aggregate(h, F.lit(0.0), lambda s, a: s + at(_single(buckets)(a)))
    both = F.aggregate(_pairs(h, lambda a, b: at(_pair(buckets)(a, b))), singles, lambda s, x: s + x)
    llr = F.when(F.size(h) > 0, both / (2 * F.size(h) - 1)).otherwise(0.0)
    n, repeats = F.col("base.n_words"), F.col("base.n_repeat_words")
    failed = (n < 50) | (100 * repeats > 50 * n)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    new = [*names, "base_failed", "llr", "kept"]
    return (
        base(docs, text_column)
        .select("row", "base", failed.alias("base_failed"), llr.alias("llr"))
        .select(
            *(F.col("row")[c].alias(c) for c in docs.columns if c not in new),
            *(F.col("base")[c].alias(c) for c in names),
            "base_failed",
            "llr",
            (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"),
        )
    )


def _trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL")
    return good.select("doc_id").distinct()


def trusted(docs: DataFrame, labels: DataFrame, max_trusted: int | None = None) -> DataFrame:
    """Documents labelled good and not toxic, the target corpus: all, or ``max_trusted`` ids at most.

    The ids are broadcast, so that no text is moved.
    """
    good = _trusted_ids(labels)
    if max_trusted is not None:
        good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    return docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left_semi")


def target_counts(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, block: int = BLOCK
) -> dict[int, int]:
    """How many n-grams of all trusted documents fall into each bucket.

    Ids are dealt into blocks by their hash; each block is broadcast and counted in a job of
    its own, so that memory holds one block and no text is moved.
    """
    blocks = -(-_trusted_ids(labels).count() // block)
    total: Counter[int] = Counter()
    for i in range(blocks):
        some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i)
        total.update(dict(counts(trusted(docs, some), buckets=buckets).collect()))
    return dict(total)
