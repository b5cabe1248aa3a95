"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, document after document, are packed into blocks of ``BLOCK`` words.
Targets turn into whole numbers of blocks per source. Output shards of ``SHARD`` slots draw
how many blocks of each source they hold from a multinomial over what the sources still
have to give, so that the shards look alike and the sums are met. Slot i of a source takes
block p(i mod n) of its n blocks, p a keyed permutation of the block numbers that changes
with every pass; a join on (source, block) then brings slots and documents together.

A pass takes each block once, so no document is taken more than ``MAX_PASSES`` times. All
draws and permutations are keyed by ``seed`` alone: reruns agree.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mastline.llm.runtime import stored

BLOCK = 64  # words
SHARD = 65_536  # slots
SLOTS_PER_TASK = 1 << 18
MAX_DRAWS = 1_000_000  # shards times sources; beyond, shards get longer
MAX_SOURCES = 10_000  # the list of sources is held in memory
MAX_PASSES = 3
WEIGHTS = (5, 2, 1)
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text, split by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], limit: float = MAX_PASSES) -> list[float]:
    """Shares of all sizes by weight; none above ``limit`` times its size.

    What is cut off goes to the others by weight, again and again.
    """
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        if not total:
            break
        full = {i for i in open_ if left * weights[i] / total > limit * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(limit * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def draws(quotas: list[int], seed: int, shard: int = SHARD) -> Iterator[np.ndarray]:
    """For each output shard, the blocks it holds of each source.

    Multinomial over the remaining quotas; a source that would pass its quota gives what it
    has, and the rest is drawn again from the others.
    """
    left = np.array(quotas, np.int64)
    number = 0
    while left.sum():
        rng = np.random.default_rng([seed, number])
        held, slots = np.zeros_like(left), int(min(shard, left.sum()))
        while slots:
            open_ = left - held
            more = np.minimum(rng.multinomial(slots, open_ / open_.sum()), open_)
            held += more
            slots -= int(more.sum())
        yield held
        left -= held
        number += 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0 to n - 1 for each key: a Feistel network, walked until below n."""
    half = np.uint64(1) * np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    key = _mixed(key.astype(np.uint64))
    out, n = i.astype(np.uint64), n.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & low[todo]
        for turn in range(4):
            mask = _mixed(right + key[todo] + np.uint64(turn << 56)) & low[todo]
            left, right = right, left ^ mask
        out[todo] = left << half[todo] | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _packed(sized: DataFrame, chunk_rows: int) -> DataFrame:
    """``start``: words of the source before each row, by two levels of prefix sums.

    Rows are dealt to chunks by a hash of their id; the order is by chunk, id and text hash.
    """
    rows = sized.count()
    chunks = max(1, -(-rows // chunk_rows))
    dealt = sized.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_hash"), F.lit(chunks)))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        dealt.groupBy("_source", "_chunk")
        .agg(F.sum("_size").alias("_n"))
        .select(
            "_source",
            "_chunk",
            F.coalesce(
                F.sum("_n").over(before.partitionBy("_source").orderBy("_chunk")), F.lit(0)
            ).alias("_before"),
        )
    )
    in_chunk = before.partitionBy("_source", "_chunk").orderBy("_id", "_hash")
    return (
        dealt.withColumn("_in", F.coalesce(F.sum("_size").over(in_chunk), F.lit(0)))
        .join(sums.withColumnsRenamed({"_source": "_s", "_chunk": "_c"}), F.expr("_source <=> _s AND _chunk = _c"))
        .withColumn("_start", F.col("_before") + F.col("_in"))
        .drop("_chunk", "_in", "_before", "_s", "_c")
    )


class Mixture:
    """The mix of ``docs``: what every row is, and which slots hold which blocks.

    Null texts have no words; null sources are one source, the last; rows with a null id
    take part, and repeated rows are documents of their own. An empty table mixes nothing.
    """

    def __init__(
        self,
        docs: DataFrame,
        weights: tuple[float, ...] = WEIGHTS,
        seed: int = 17,
        block: int = BLOCK,
        shard: int = SHARD,
        chunk_rows: int = 10_000,
    ):
        self.block, self.seed = block, seed
        spark = docs.sparkSession
        sized = stored(
            docs.select(
                F.col("doc_id").alias("_id"),
                F.col("source").alias("_source"),
                F.xxhash64("text").alias("_hash"),
                n_words(F.col("text")).alias("_size"),
            ),
            "sizes",
        )
        #: _id, _source, _hash, _size, _start
        self.rows = stored(_packed(sized, chunk_rows), "packed")
        # one row a source: the list that the weights belong to
        found = sized.groupBy("_source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"{len(found)} sources; {MAX_SOURCES} at most can be weighed")
        found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
        sizes = [r["n"] for r in found]
        wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
        blocks = [-(-n // block) for n in sizes]
        quotas = [
            min(MAX_PASSES * b, round(t * b / n)) if n else 0
            for t, b, n in zip(wanted, blocks, sizes, strict=True)
        ]
        self.sources = spark.createDataFrame(
            [
                (i, r["_source"], n, t, b, q)
                for i, (r, n, t, b, q) in enumerate(zip(found, sizes, wanted, blocks, quotas, strict=True))
            ],
            "_number int, _source string, _source_size long, _target double, _blocks long, _quota long",
        )
        self.shard = max(shard, -(-sum(quotas) * len(quotas) // MAX_DRAWS))
        self.slots = self._slots(spark, quotas, blocks)

    def _slots(self, spark, quotas: list[int], blocks: list[int]) -> DataFrame:
        """``(shard, slot, number, block)``: one row for each slot of the output."""
        plan, given = [], np.zeros(len(quotas), np.int64)
        for number, held in enumerate(draws(quotas, self.seed, self.shard)):
            ends = np.cumsum(held)
            for s in np.flatnonzero(held).tolist():
                plan.append((number, s, blocks[s], int(given[s]), int(ends[s] - held[s]), int(held[s])))
            given += held
        schema = "shard int, number int, blocks long, given long, slot long, n long"
        seed = self.seed

        @F.pandas_udf(T.LongType())
        def block_of(place: pd.Series, blocks: pd.Series, number: pd.Series) -> pd.Series:
            i, n = place.to_numpy(), blocks.to_numpy()
            key = (seed << 40) + number.to_numpy().astype(np.int64) * 64 + i // n
            return pd.Series(permuted(i % n, n, key))

        zero, run = F.lit(0).cast("long"), F.lit(SHARD).cast("long")
        last = F.least(F.col("n"), F.col("run") + run) - 1
        # a given number: the plan is so short that it would be merged into one task otherwise
        tasks = max(1, -(-sum(quotas) // SLOTS_PER_TASK))
        each = (
            spark.createDataFrame(plan, schema)
            .select("*", F.explode(F.sequence(zero, F.col("n") - 1, run)).alias("run"))
            .repartition(tasks, "shard", "number", "run")
            .select("*", F.explode(F.sequence(F.col("run"), last)).alias("i"))
        )
        block = block_of(F.col("given") + F.col("i"), F.col("blocks"), F.col("number"))
        return each.select(
            "shard",
            (F.col("slot") + F.col("i")).alias("slot"),
            "number",
            # never null, and said so: a join would work it out once more, by another worker, to drop nulls
            F.coalesce(block, zero).alias("block"),
        )

    def pieces(self) -> DataFrame:
        """``(_id, _source, _hash, _start, number, block, first, n)``: words of rows in blocks.

        ``first`` counts words of the row; a document of many blocks has a piece in each.
        """
        numbers = F.broadcast(self.sources.select("_number", F.col("_source").alias("_s")))  # a row a source
        blocks = F.sequence(
            F.floor(F.col("_start") / self.block), F.floor((F.col("_start") + F.col("_size") - 1) / self.block)
        )
        begin = F.greatest(F.col("block") * self.block, "_start")
        end = F.least((F.col("block") + 1) * self.block, F.col("_start") + F.col("_size"))
        return (
            self.rows.where("_size > 0")
            .join(numbers, F.expr("_source <=> _s"))
            .select("_id", "_source", "_hash", "_start", "_size", F.col("_number").alias("number"), F.explode(blocks).alias("block"))
            .select("_id", "_source", "_hash", "_start", "number", "block", (begin - F.col("_start")).alias("first"), (end - begin).alias("n"))
        )

    def joined(self) -> DataFrame:
        """The pieces, each with ``times``: how many slots hold its block.

        Both sides come from few rows that Spark takes for all there are: never broadcast by that.
        """
        times = self.slots.groupBy("number", "block").agg(F.count("*").alias("times"))
        return self.pieces().join(times.hint("merge"), ["number", "block"])

    def documents(self) -> DataFrame:
        """``(doc_id, size, source_size, target, taken)`` for every row."""
        taken = (
            self.joined()
            .groupBy("_id", "_source", "_hash", "_start")
            .agg(F.sum(F.col("n") * F.col("times")).alias("_taken"))
            .withColumnsRenamed({"_id": "_i", "_source": "_s", "_hash": "_h", "_start": "_b"})
        )
        same = F.expr("_id <=> _i AND _source <=> _s AND _hash = _h AND _start = _b AND _size > 0")
        per_source = F.broadcast(  # a row a source
            self.sources.select(F.col("_source").alias("_of"), "_source_size", "_target")
        )
        return (
            self.rows.join(taken, same, "left")
            .join(per_source, F.expr("_source <=> _of"))
            .select(
                F.col("_id").alias("doc_id"),
                F.col("_size").alias("size"),
                F.col("_source_size").alias("source_size"),
                F.col("_target").alias("target"),
                F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
            )
        )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass a row takes part in, its taken words as the text.

    Pass k holds the words of the blocks that more than k slots took, in their order, one
    space between them; a row that is taken whole keeps its text as it is. Rows without
    words have nothing to give and are left out. ``n_chars`` follows the text; all other
    columns are repeated. Identical rows share what they are taken for.
    """
    mixture = Mixture(docs, **options)
    # the words of a row that each pass takes: spans, in order
    spans = (
        mixture.joined()
        .select("_id", "_source", "_hash", "_start", "first", "n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass"))
        .groupBy("_id", "_source", "_hash", "_start", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"), F.sum("n").alias("taken"))
        .select(F.struct("_id", "_source", "_hash").alias("_key"), "spans", "taken")
    )
    columns = docs.columns
    key = F.struct(docs["doc_id"].alias("_id"), docs["source"].alias("_source"), F.xxhash64(docs["text"]).alias("_hash"))
    keyed = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), key.alias("_key"))

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, chosen in zip(texts, spans, strict=True):
            if text is None:  # taken whole
                out.append(None)
                continue
            words = text.encode().split()  # splits at ASCII white space only
            out.append(b" ".join(b" ".join(words[s["first"] : s["first"] + s["n"]]) for s in chosen).decode())
        return pd.Series(out, dtype=object)

    # identical rows: which of them does not matter, but each pass once
    one = Window.partitionBy("_key").orderBy("_key")
    taken = keyed.withColumn("_copy", F.row_number().over(one)).where("_copy = 1").join(spans, "_key")
    text, whole = F.col("row.text"), F.col("whole")
    taken = taken.withColumn("whole", F.col("taken") == n_words(text))
    # what is taken whole does not go through Python
    new = taken.withColumn("new", F.when(whole, text).otherwise(cut(F.when(~whole, text), F.when(~whole, F.col("spans")))))
    return new.select(
        *(
            F.col("new").alias("text")
            if c == "text"
            else F.length("new").cast("long").alias("n_chars")
            if c == "n_chars"
            else F.col("row")[c].alias(c)
            for c in columns
        )
    )
