"""Phrase mining by dynamic itemset counting.

The corpus is dealt into shards that are scanned round and round. Words are counted from the
first shard on. A longer phrase becomes active as soon as both phrases it is made of, without
its last and without its first word, have been seen often enough, whatever shard that is, and is
then counted for exactly one full cycle. Lengths are so counted side by side, and after its
cycle the count of a phrase is exact.

When a phrase becomes active is kept per hash slot: a slot remembers the step at which the
phrases in it first reached the threshold. Slots are of a fixed number, so what every task is
sent is bounded; phrases that share a slot only make longer ones be counted that need not be,
over a full cycle like any other. With more phrases than slots less is left out, but nothing
changes.

While counting, words go by a 64-bit number, the hash of language and word. Two words with one
number would be noticed when the words have been counted; counting then starts again with
another seed.
"""

from collections.abc import Iterator
from functools import reduce
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastline.llm.runtime import stored
from mastline.operators.joins import spread_join

LONGEST = 3
# fixed values: what ends a piece, what stands between words
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"
#: a byte that no UTF-8 text holds
_MARK = b"\xff"
_NEVER = 255
#: bytes of text counted together by a task before it hands on what it has
_CHUNK = 12_000_000
#: bytes of text split at a time, about
_SPLIT = 1_000_000
#: rows handed on at a time: both ends of the pipe hold as many
_ROWS = 1 << 16


def _byte_table() -> bytes:
    """Lower case for A-Z, blanks as spaces, ends of pieces as marks; other bytes stay."""
    table = bytearray(range(256))
    for byte in range(ord("A"), ord("Z") + 1):
        table[byte] = byte + 32
    for byte in _ENDS:
        table[byte] = _MARK[0]
    for byte in _BLANKS:
        table[byte] = ord(" ")
    return bytes(table)


_TABLE = _byte_table()


def normalised(text: bytes) -> bytes:
    return text.translate(_TABLE) + _MARK


def _token_array(texts: list[bytes]) -> pa.LargeBinaryArray:
    """The words of normalised texts in order, with a mark behind each piece."""
    spaced = b"".join(texts).replace(_MARK, b" " + _MARK + b" ")
    parts = pc.split_pattern(pa.array([spaced], pa.large_binary()), b" ").flatten()
    return parts.filter(pc.greater(pc.binary_length(parts), 0))


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """The words of normalised texts in order, with a mark behind each piece."""
    return _token_array(texts).to_pylist()


def _cut(text: bytes) -> Iterator[bytes]:
    """A normalised text in parts of whole pieces, so that a very long one is not held as words."""
    start = 0
    while len(text) - start > _CHUNK:
        end = text.index(_MARK, start + _CHUNK - 1) + 1
        yield text[start:end]
        start = end
    yield text[start:]


# fixed values: the primes of XXH64, and the seed Spark starts from
_P1, _P2, _P3, _P4, _P5 = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)
_SEED = 42


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed(*numbers: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` makes of columns of longs, as unsigned numbers."""
    with np.errstate(over="ignore"):
        seed = np.full(len(numbers[0]), _SEED, np.uint64)
        for number in numbers:
            mixed = seed + np.uint64(_P5) + np.uint64(8)
            mixed ^= _rotated(number.view(np.uint64) * np.uint64(_P2), 31) * np.uint64(_P1)
            mixed = _rotated(mixed, 27) * np.uint64(_P1) + np.uint64(_P4)
            mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(_P2)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_P3)
            seed = mixed ^ (mixed >> np.uint64(32))
        return seed


def _slot(bits: int, *numbers: np.ndarray) -> np.ndarray:
    """The first bits of the hash of a phrase's words."""
    return (hashed(*numbers) >> np.uint64(64 - bits)).astype(np.int64)


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The number of each token, and the words by their number, as they come; 0 is the mark."""
    groups, size = [[_MARK]], 0  # a mark before the first word
    for text in texts:
        if size >= _SPLIT:
            groups.append([])
            size = 0
        groups[-1].append(text)
        size += len(text)
    tokens = pa.chunked_array([_token_array(g) for g in groups], pa.large_binary())
    chunks = tokens.dictionary_encode().chunks
    return np.concatenate([c.indices.to_numpy() for c in chunks]), chunks[0].dictionary


class _Counter:
    """Counts the active phrases of one language in a chunk of normalised texts."""

    def __init__(self, lang: str, texts: list[bytes], bits: int, seed: int):
        self.lang, self.bits = lang, bits
        self.ids, self.words = _numbered(texts)
        pa.default_memory_pool().release_unused()  # what the splitting held
        prefix = lang.encode() + b"\t"
        self.keys = np.fromiter(
            (xxhash.xxh64_intdigest(prefix + w, seed) for w in self.words.to_pylist()),
            np.uint64,
            len(self.words),
        ).view(np.int64)

    def _rows(
        self, words: list[np.ndarray], counts: np.ndarray, start: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        """Rows of phrases; ``words`` holds the places of their words in the vocabulary."""
        named = len(words) == 1
        for at in range(0, len(counts), _ROWS):
            part = slice(at, at + _ROWS)
            n = len(counts[part])
            keys = [pa.array(self.keys[w[part]]) for w in words]
            empty, unnamed = pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())
            word = self.words[1 + at : 1 + at + n].cast(pa.binary()).view(pa.string()) if named else unnamed
            yield pa.record_batch(
                {
                    "length": pa.array(np.full(n, len(words), np.int32)),
                    "start": pa.array(start[part].astype(np.int32)),
                    **{f"k{i}": keys[i - 1] if i <= len(keys) else empty for i in (1, 2, 3)},
                    "count": pa.array(counts[part].astype(np.int64)),
                    "lang": pa.array([self.lang] * n) if named else unnamed,
                    "word": word,
                }
            )

    def counted(self, step: int, shards: int, reached: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases active at ``step``.

        ``reached[n]`` holds for each slot the step from which phrases of n words in it are
        known to be frequent.
        """
        ids, keys = self.ids, self.keys
        active = lambda since: (since <= step) & (step < since.astype(np.int64) + shards)
        if step < shards and len(self.words) > 1:
            counts = np.bincount(ids, minlength=len(self.words))[1:]
            yield from self._rows([np.arange(1, len(self.words))], counts, np.zeros(len(counts)))
        known = reached[1][_slot(self.bits, keys)]
        known[0] = _NEVER
        # places where two frequent words stand side by side
        place = np.flatnonzero((known[ids[:-1]] != _NEVER) & (known[ids[1:]] != _NEVER))
        if not len(place):
            return
        size = np.int64(len(self.words))
        code = ids[place].astype(np.int64) * size + ids[place + 1]
        pairs, which, counts = np.unique(code, return_inverse=True, return_counts=True)
        left, right = pairs // size, pairs % size
        since = np.maximum(known[left], known[right])
        now = active(since)
        if now.any():
            yield from self._rows([left[now], right[now]], counts[now], since[now])
        known = reached[2][_slot(self.bits, keys[left], keys[right])]
        # two frequent pairs, one word apart
        at = np.flatnonzero(place[1:] == place[:-1] + 1)
        first, second = which[at], which[at + 1]
        since = np.maximum(known[first], known[second])
        kept = (since != _NEVER) & active(since)
        if not kept.any():
            return
        code = first[kept].astype(np.int64) * len(pairs) + second[kept]
        triples, counts = np.unique(code, return_counts=True)
        first, second = triples // len(pairs), triples % len(pairs)
        since = np.maximum(known[first], known[second])
        yield from self._rows([left[first], right[first], right[second]], counts, since)


_COUNTS = (
    "length int, start int, k1 long, k2 long, k3 long, count long, lang string, word string"
)


def _scan(step: int, shards: int, bits: int, seed: int, sent):
    """Counts of one shard's batches; ``sent`` holds the steps of all slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = sent.value
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def counted(lang: str) -> Iterator[pa.RecordBatch]:
            del sizes[lang]
            return _Counter(lang, held.pop(lang), bits, seed).counted(step, shards, reached)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").cast(pa.binary())):
                for part in _cut(normalised(text.as_py())):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= _CHUNK:
                        yield from counted(lang)
            while sum(sizes.values()) >= 2 * _CHUNK:  # many languages
                yield from counted(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from counted(lang)

    return run


def _newly_reached(slots: DataFrame, known: np.ndarray, step: int) -> bool:
    """Note ``step`` for the slots that are not in ``known`` yet; whether there are any.

    Slots come as bitmaps of 32,768 bits, so the driver takes in a fixed number of small rows.
    """
    rows = (
        slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
        .toLocalIterator()
    )
    found = False
    for row in rows:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        part = known[(row["bucket"] - 1) * len(bits) : row["bucket"] * len(bits)]
        new = (bits[: len(part)] == 1) & (part == _NEVER)
        part[new] = step
        found |= bool(new.any())
    return found


class _Counts(NamedTuple):
    """Exact counts; a word's number tells its language too.

    ``words`` has all words, ``(lang, word, k1, f)``; ``pairs`` and ``triples`` have the numbers
    and ``f`` of what was seen often enough.
    """

    words: DataFrame
    pairs: DataFrame
    triples: DataFrame

    def sizes(self) -> DataFrame:
        return self.words.groupBy("lang").agg(F.sum("f").alias("n"))


def counted_phrases(
    docs: DataFrame, least: int = 10, shards: int = 2, bits: int = 24
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to three words seen ``least`` times, and the size of each language.

    The first result is ``(lang, length, phrase, f)``; ``f`` counts all contiguous occurrences
    within pieces, overlaps included. The second is ``(lang, n)`` with all word occurrences.
    Only ``text`` (null: empty) and ``lang`` (null: ``und``) are read. Repeated rows and very
    long texts count like any other; an empty table gives empty results. ``2 ** bits`` slots
    of a byte are sent to every task; ``shards`` is 80 at most. ``docs`` is read once a step,
    three times a shard at most; store it first if it is costly to make.
    """
    found = _exact(docs, least, shards, bits)
    frequent = found.words.where(F.col("f") >= least)
    parts = [frequent.select("lang", F.lit(1).alias("length"), F.col("word").alias("phrase"), "f")]
    for length, phrases in ((2, found.pairs), (3, found.triples)):
        named = _named(phrases, frequent, length)
        parts.append(named.select("lang", F.lit(length).alias("length"), "phrase", "f"))
    return _union(parts), found.sizes()


def _exact(docs: DataFrame, least: int, shards: int, bits: int = 24) -> _Counts:
    for seed in count():
        found = _counted(docs, least, shards, bits, seed)
        if found:
            return found
    raise AssertionError


def _named(phrases: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """With ``lang`` and ``phrase`` in place of the numbers."""
    keys = [f"k{i}" for i in range(1, length + 1)]
    for key in keys:  # a frequent word is in very many phrases
        name = words.select(F.col("k1").alias(key), F.col("word").alias(f"w{key}"), F.col("lang").alias("_lang"))
        name = name if key == "k1" else name.drop("_lang")
        phrases = spread_join(phrases, name, [key], "inner", spread=[k for k in keys if k != key])
    phrase = F.concat_ws(" ", *(F.col(f"w{k}") for k in keys))
    others = [F.col(c) for c in phrases.columns if c not in ("lang", "_lang", *keys, *(f"w{k}" for k in keys))]
    return phrases.select(F.col("_lang").alias("lang"), phrase.alias("phrase"), *others)


def _slots_seen(rows: DataFrame, keys: list[str], least: int, bits: int) -> DataFrame:
    """Slots of phrases seen often enough so far; what shares a hash only adds to them."""
    return (
        rows.groupBy(F.shiftright(F.xxhash64(*keys), 32).cast("int").alias("hash"))
        .agg(F.sum("count").alias("f"))
        .where(F.col("f") >= least)
        .select(F.shiftrightunsigned("hash", 32 - bits).cast("long").alias("slot"))
    )


def _counted(
    docs: DataFrame, least: int, shards: int, bits: int, seed: int
) -> _Counts | None:
    """The counts; None if two words turn out to have one number."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(
        F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )
    shard = F.pmod(F.xxhash64("lang", "text"), F.lit(shards))  # the same rows in every cycle
    reached = {n: np.full(1 << bits, _NEVER, np.uint8) for n in range(1, LONGEST)}
    steps: list[DataFrame] = []
    pairs: list[DataFrame] = []
    step, last = 0, shards - 1
    while step <= last:
        sent = context.broadcast(reached)
        scan = _scan(step, shards, bits, seed, sent)
        found = texts.where(shard == step % shards).mapInArrow(scan, _COUNTS)
        steps.append(stored(found, f"phrases-{step}"))
        sent.destroy()
        # what started at ``done`` has now been through its cycle, later ones are on their way
        done = step - shards + 1
        cycle = _union(steps[max(0, done) :])
        for length, known in reached.items():
            keys = [f"k{i}" for i in range(1, length + 1)]
            # words start at step 0, pairs at step ``shards`` at the latest
            starts = (0, 0) if length == 1 else (1, shards)
            of_length = cycle.where(F.col("length") == length)
            seen = []
            if max(done + 1, starts[0]) <= min(step, starts[1]):
                seen.append(_slots_seen(of_length.where(F.col("start") > done), keys, least, bits))
            if starts[0] <= done <= starts[1]:
                named = ["lang", "word"] if length == 1 else []
                total = (
                    of_length.where(F.col("start") == done)
                    .groupBy(*named, *keys)
                    .agg(F.sum("count").alias("f"))
                )
                if length == 1:
                    total = words = stored(total, "words")
                    if words.groupBy("k1").count().where("count > 1").limit(1).count():
                        return None
                often = total.where(F.col("f") >= least)
                if length == 2:
                    often = stored(often, "pairs")
                    pairs.append(often)
                seen.append(
                    often.select(F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).alias("slot"))
                )
            if seen and _newly_reached(_union(seen), known, step + 1):
                last = max(last, step + shards)
        step += 1
    triples = (
        _union(steps)
        .where("length = 3")
        .groupBy("k1", "k2", "k3")
        .agg(F.sum("count").alias("f"))
        .where(F.col("f") >= least)
    )
    triples = stored(triples, "triples")
    return _Counts(words, _union(pairs) if pairs else triples.drop("k3"), triples)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


def score_column() -> Column:
    """Millionths of a * a / (l * r), cut to a whole number, in decimals of 38 digits."""
    return F.expr("(wide_a * wide_a * 1000000BD) div (wide_l * wide_r)")


def with_score(cuts: DataFrame) -> DataFrame:
    """Column ``score`` from ``a``, ``l`` and ``r``: in longs where both products fit, else wide."""
    fits = F.expr("a <= 3000000 AND l <= 3000000000 AND r <= 3000000000")
    wide = {f"wide_{c}": F.when(~fits, F.col(c).cast("decimal(19,0)")) for c in ("a", "l", "r")}
    narrow = F.expr("(a * a * 1000000L) div (l * r)")
    scored = cuts.withColumns(wide).withColumn("score", F.when(fits, narrow).otherwise(score_column()))
    return scored.drop(*wide)


def _scored_pairs(found: _Counts, words: DataFrame, share: int) -> DataFrame:
    """Pairs that no triple holds too often: lang, k1, k2, k3 (null), a, l, r, score."""
    pairs = found.pairs.withColumnRenamed("f", "a")
    # a frequent word begins or ends very many pairs
    head = words.select("k1", "lang", F.col("f").alias("l"))
    tail = words.select(F.col("k1").alias("k2"), F.col("f").alias("r"))
    cut = spread_join(pairs, head, ["k1"], "inner", spread=["k2"])
    cut = spread_join(cut, tail, ["k2"], "inner", spread=["k1"])
    ends = [("k1", "k2"), ("k2", "k3")]
    held = [found.triples.select(F.col(x).alias("k1"), F.col(y).alias("k2"), "f") for x, y in ends]
    longer = _union(held).groupBy("k1", "k2").agg(F.max("f").alias("longer"))
    kept = cut.join(longer, ["k1", "k2"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )
    return with_score(kept).select(
        "lang", "k1", "k2", F.lit(None).cast("long").alias("k3"), "a", "l", "r", "score"
    )


def _scored_triples(found: _Counts, words: DataFrame) -> DataFrame:
    """Triples at the lower-scoring of their two cuts: lang, k1, k2, k3, a, l, r, score."""
    triples = found.triples.withColumnRenamed("f", "a")
    # there are as many pairs, so few copies
    tail = found.pairs.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("f").alias("r1"))
    cut = spread_join(triples, tail, ["k2", "k3"], "inner", spread=["k1"], fanout=2)
    head = found.pairs.withColumnRenamed("f", "l2")
    cut = spread_join(cut, head, ["k1", "k2"], "inner", spread=["k3"], fanout=2)
    first = words.select("k1", "lang", F.col("f").alias("l1"))
    cut = spread_join(cut, first, ["k1"], "inner", spread=["k2", "k3"])
    last = words.select(F.col("k1").alias("k3"), F.col("f").alias("r2"))
    cut = spread_join(cut, last, ["k3"], "inner", spread=["k1", "k2"])
    for i in (1, 2):
        cut = with_score(cut.withColumnsRenamed({f"l{i}": "l", f"r{i}": "r"}))
        cut = cut.withColumnsRenamed({"l": f"l{i}", "r": f"r{i}", "score": f"s{i}"})
    late = F.expr("s2 < s1")  # of equal ones the first cut counts
    return cut.select(
        "lang", "k1", "k2", "k3", "a",
        *(F.when(late, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(n) for c, n in (("l", "l"), ("r", "r"), ("s", "score"))),
    )


def collocations(
    docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, shards: int = 2
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of two or more words with ``a = f(phrase) >= least``. ``score`` is
    the least ``floor(1000000 * a * a / (l * r))`` over all cuts into a first part seen ``l``
    times and a rest seen ``r`` times; of equal ones the earliest cut counts. Numbers are exact
    while ``a`` is below 10^16. A candidate that lies in a longer one with at least ``share``
    percent of its occurrences is dropped. Order: score and ``a`` falling, then the phrase.
    See ``counted_phrases`` for null, empty and repeated rows.
    """
    found = _exact(docs, least, shards)
    words = found.words.where(F.col("f") >= least)
    # all by numbers; only what may be among the first is named
    scored = stored(_scored_pairs(found, words, share).unionByName(_scored_triples(found, words)), "scored")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    last = (
        scored.select("lang", "score", "a")
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= top)
        .groupBy(F.col("lang").alias("_of"))
        .agg(F.min("score").alias("_score"), F.min_by("a", F.struct("score", "a")).alias("_a"))
    )
    last = stored(last, "last")  # a row a language: its size is known, whatever it is
    near = scored.join(last, F.expr("lang = _of")).where(
        "score > _score OR (score = _score AND a >= _a)"
    ).drop("_of", "_score", "_a")
    named = _union(
        [
            _named(near.where(which).drop(*without), words, length).select("lang", "phrase", "a", "l", "r", "score")
            for length, which, without in ((2, "k3 IS NULL", ["k3"]), (3, "k3 IS NOT NULL", []))
        ]
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(found.sizes(), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
