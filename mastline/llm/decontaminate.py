"""Benchmark decontamination: SimHash windows of item size, Hamming blocks, exact check.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, so that
punctuation, case and line breaks hide nothing. For every benchmark item the documents are
read in windows of the item's length. A window that shares no shingle with an item cannot
be similar to it; every other window gets a SimHash fingerprint. Four 16-bit blocks index
the items' fingerprints: within ``RADIUS`` differing bits, one block differs in at most
``RADIUS // 4``, and all such block values are entered, so each fingerprint in the radius is
found. Candidates are verified by the weighted Jaccard similarity of their shingles.

At similarity 0.8 a bit differs with probability 0.15, so that 19 or more of 64 differ in
one of 2,000 cases; copies of higher similarity stay far below.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCK_ITEMS = 2_000  # items indexed at a time; larger benchmarks take several passes
_STEP = 1 << 20  # bytes of text whose words are hashed at a time
_BLOCKS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWERED = np.zeros(256, np.uint8)  # separators become zero
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _LOWERED[_c] = _c
for _c in range(65, 91):
    _LOWERED[_c] = _c + 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_UP, _DOWN = _powers(_ODD, 2 * _STEP), _powers(_INVERSE, 2 * _STEP)


def _word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word: differences of one running polynomial sum."""
    up, down = _UP, _DOWN
    if len(text) > len(up):  # one word longer than a step
        up, down = _powers(_ODD, len(text)), _powers(_INVERSE, len(text))
    low = _LOWERED[text]
    word = np.zeros(len(text) + 2, np.int8)
    word[1:-1] = low > 0
    turn = np.diff(word)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(low * up[: len(text)], out=total[1:])
    return starts, ends, _mixed((total[ends] - total[starts]) * down[starts])


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """The joined texts in parts of about a step, cut at separators, and where each begins."""
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    at = 0
    while at < len(joined):
        end = min(at + _STEP, len(joined))
        while end < len(joined):
            stop = np.flatnonzero(_LOWERED[joined[end : end + 4096]] == 0)
            if len(stop):
                end += int(stop[0])
                break
            end = min(end + 4096, len(joined))
        yield joined[at:end], at
        at = end


def words_of(text: str | None) -> list[str]:
    """The words of a text, as strings."""
    low = _LOWERED[np.frombuffer((text or "").encode(), np.uint8)]
    low[low == 0] = 32
    return [w for w in low.tobytes().decode("utf-8", "replace").split(" ") if w]


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _ODD + hashes[i : i + n]
    return _mixed(total + np.uint64(size))


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    raw = shingles.view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _grams(words: list[str], size: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(size)), strict=False))


def similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard of the word shingles: shared over united occurrences."""
    size = min(SHINGLE, len(a), len(b))
    if not size:
        return 0.0
    x, y = _grams(a, size), _grams(b, size)
    shared = (x & y).total()
    return shared / (x.total() + y.total() - shared)


class Items:
    """A block of benchmark items, indexed. Items without a word are left out."""

    def __init__(self, rows: list[tuple[int, str]], radius: int = RADIUS):
        self.radius = radius
        kept = [(i, words_of(t)) for i, t in rows]
        kept = [(i, w) for i, w in kept if w]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.size = np.minimum(self.length, SHINGLE)
        grams = []
        for words, size in zip(self.words, self.size, strict=True):
            text = np.frombuffer(" ".join(words).encode(), np.uint8)
            grams.append(_shingles(_word_hashes(text)[2], int(size)))
        self.prints = np.array(
            [_prints(_bits(g).sum(axis=0)[None, :])[0] for g in grams], np.uint64
        )
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        pairs = sorted(set(zip(flat.tolist(), owner.tolist(), strict=True)))
        #: shingle -> items that have it, as sorted runs
        self.gram = np.array([g for g, _ in pairs], np.uint64)
        self.owner = np.array([o for _, o in pairs], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.gram & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.sizes = sorted(set(self.size.tolist()))
        self.blocks = [self._block(b) for b in range(_BLOCKS)]

    def _block(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """For each 16-bit value, the items whose block is near it: offsets and items."""
        flips = [
            sum(1 << b for b in chosen)
            for n in range(self.radius // _BLOCKS + 1)
            for chosen in combinations(range(16), n)
        ]
        own = (self.prints >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF
        keys = (own[:, None] ^ np.array(flips)).ravel()
        items = np.repeat(np.arange(len(own), dtype=np.int32), len(flips))
        order = np.argsort(keys, kind="stable")
        offsets = np.searchsorted(keys[order], np.arange((1 << 16) + 1))
        return offsets, items[order]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item) of all pairs within the radius."""
        found = []
        for block, (offsets, items) in enumerate(self.blocks):
            key = (prints >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF
            n = offsets[key + 1] - offsets[key]
            place = np.repeat(np.arange(len(prints)), n)
            item = items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[key], n)]
            close = np.bitwise_count(prints[place] ^ self.prints[item]) <= self.radius
            found.append(place[close] * (1 << 32) + item[close])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both >> 32, both & 0xFFFFFFFF

    def _hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that an item has."""
        maybe = np.flatnonzero(self.filter[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        there = np.searchsorted(self.gram, shingles[maybe])
        there[there == len(self.gram)] = 0
        return maybe[self.gram[there] == shingles[maybe]]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, float, int]]:
        """(text, item, first word, words, similarity, bits) of each text's best window an item."""
        if not self.ids:
            return
        parts = [(s + at, e + at, h) for c, at in _chunks(texts) for s, e, h in [_word_hashes(c)]]
        if not parts:
            return
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])  # of each text, in bytes
        bounds = np.searchsorted(starts, first)  # of each text, in words
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        near: dict[int, set[int]] = {}
        places: dict[tuple[int, int], list[np.ndarray]] = {}
        for size in self.sizes:
            shingles = _shingles(hashes, size)
            hit = self._hits(shingles)
            hit = hit[text_of[hit] == text_of[hit + size - 1]]
            lo = np.searchsorted(self.gram, shingles[hit])
            n = np.searchsorted(self.gram, shingles[hit], side="right") - lo
            owner = self.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            at = np.repeat(hit, n)
            fits = self.size[owner] == size
            at, owner = at[fits], owner[fits]
            keys = text_of[at] * (1 << 32) + owner
            order = np.argsort(keys, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                if len(part):
                    text, item = int(text_of[at[part[0]]]), int(owner[part[0]])
                    near.setdefault(text, set()).add(int(self.length[item]))
                    places.setdefault((text, int(self.length[item])), []).append(at[part])
        for text in sorted(near):
            a, b = int(bounds[text]), int(bounds[text + 1])
            raw = texts[text]
            best: dict[int, tuple] = {}
            for length in sorted(near[text]):
                at = np.unique(np.concatenate(places[text, length])) - a
                for found in self._windows(raw, first[text], starts[a:b], ends[a:b], hashes[a:b], at, length):
                    item, similar, start, words, bits = found
                    if item not in best or (-similar, start) < (-best[item][2], best[item][0]):
                        best[item] = (start, words, similar, bits)
            for item, (start, words, similar, bits) in sorted(best.items()):
                yield text, item, start, words, similar, bits

    def _windows(self, raw, first, starts, ends, hashes, at, length):
        """Windows of one length over the shared shingles at ``at``, searched and verified."""
        size = min(length, SHINGLE)
        window = min(length, len(hashes))
        reach = window - size  # how far before a shingle its windows may start
        last = len(hashes) - window
        near = np.zeros(last + 2, np.int64)
        np.add.at(near, np.maximum(0, at - reach), 1)
        np.add.at(near, np.minimum(at, last) + 1, -1)
        begin = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        for run in np.split(begin, np.flatnonzero(np.diff(begin) > 1) + 1):
            for piece in np.array_split(run, -(-len(run) // 4_096)):  # bounded bit tables
                lo, hi = int(piece[0]), int(piece[-1]) + window
                grams = _shingles(hashes[lo:hi], size)
                sums = np.zeros((len(grams) + 1, 64), np.int32)
                np.cumsum(_bits(grams), axis=0, out=sums[1:])
                n = window - size + 1
                here = piece - lo
                prints = _prints(sums[here + n] - sums[here])
                place, item = self.near(prints)
                right = self.length[item] == length
                for p, i in zip(place[right].tolist(), item[right].tolist(), strict=True):
                    s = int(piece[p])
                    text = raw[int(starts[s] - first) : int(ends[s + window - 1] - first)]
                    similar = similarity(words_of(text.decode("utf-8", "replace")), self.words[i])
                    if similar >= SIMILARITY:
                        bits = int(np.bitwise_count(prints[p] ^ self.prints[i]))
                        yield i, similar, s, window, bits


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, streamed; repeated rows once."""
    block = []
    items = benchmark.select("item_id", "text").distinct().orderBy("item_id", "text")
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == block_items:
            yield block
            block = []
    if block:
        yield block


def _search_batches(shared):
    def search(batches):
        items = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, part in _parts(texts):
                found = list(items.search(part))
                if found:
                    text, item, start, words, similar, bits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([at + t for t in text])),
                            pa.array([items.ids[i] for i in item], pa.int64()),
                            pa.array(start, pa.int64()),
                            pa.array(words, pa.int64()),
                            pa.array(similar, pa.float64()),
                            pa.array(bits, pa.int32()),
                        ],
                        names=["doc_id", "item_id", "first_word", "n_words", "similarity", "bits"],
                    )

    return search


def _parts(texts) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in groups of about a step of bytes."""
    part, size, at = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.as_py() if hasattr(text, "as_py") else text
        part.append(b"" if raw is None else bytes(raw))
        size += len(part[-1])
        if size >= _STEP:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


def matches(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The best window of each document and item that are similar.

    Columns: doc_id, item_id, first_word and n_words of the window, similarity, bits (the
    distance of the fingerprints). One row for each row of ``docs``, so repeated rows give
    repeated matches. Null and empty texts match nothing, nor do items without a word; items
    of fewer than five words are one shingle. Ties go to the first window. Other columns are
    not read; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    found = None
    for block in _blocks(benchmark, block_items):
        shared = spark.sparkContext.broadcast(Items(block))
        part = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
            _search_batches(shared),
            T.StructType([
                T.StructField("doc_id", docs.schema["doc_id"].dataType),
                T.StructField("item_id", T.LongType()),
                T.StructField("first_word", T.LongType()),
                T.StructField("n_words", T.LongType()),
                T.StructField("similarity", T.DoubleType()),
                T.StructField("bits", T.IntegerType()),
            ]),
        )
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame(
            [],
            "doc_id long, item_id long, first_word long, n_words long, similarity double, bits int",
        )
    return found


def _contaminated(shared):
    @F.pandas_udf(T.BooleanType())
    def contaminated(texts: pd.Series) -> pd.Series:
        flags = np.zeros(len(texts), bool)
        for at, part in _parts(texts):
            for match in shared.value.search(part):
                flags[at + match[0]] = True
        return pd.Series(flags)

    return contaminated


def clean(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns kept, nothing shuffled."""
    spark = docs.sparkSession
    for block in _blocks(benchmark, block_items):
        flag = _contaminated(spark.sparkContext.broadcast(Items(block)))
        docs = docs.where(~flag(F.col("text").cast("binary")))
    return docs
