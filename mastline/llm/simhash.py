"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints sorted by their rank in the reflected Gray code keep neighbours that differ
in few bits close. Runs of neighbours become leaves' parents; a node holds the bits all
its fingerprints agree on (mask and pattern) and leaves only the rest to its children. A
search adds up differences from the top and drops a whole group once they pass the limit.

The sorted fingerprints are cut into segments of like size, one index each. A fingerprint
visits the segments whose upper nodes it can still be near to, its own and later ones
only, so that every pair meets once. A segment answers with a spanning forest of the links
it found, never with all pairs, and the forests are joined by ``components``.
"""

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mastline.llm.components import components
from mastline.llm.runtime import stored

SEED = 42
FANOUT = 16
_STEP = 1 << 15  # shingles whose bits are counted at a time
_FRONT = 1 << 18  # node visits held at a time
_SIGN = np.uint64(1 << 63)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The unsigned 64-bit SimHash of the word shingles of a UTF-8 text.

    A-Z are lower-cased; words are what ASCII white space separates. Fewer words than a
    shingle: the whole sequence is one; no words or null: zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        m = min(_STEP, n - at)
        part = words[at : at + m + shingle - 1]
        texts = map(b" ".join, zip(*(part[i : i + m] for i in range(shingle)), strict=True))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, texts, repeat(SEED)), np.uint64, m)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    """The fingerprint as a signed long, computed in Arrow batches."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        found = np.fromiter(
            (fingerprint(x if x is None else bytes(x), shingle) for x in texts), np.uint64, len(texts)
        )
        return pd.Series(found.view(np.int64))

    return simhash(text.cast("binary"))


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The place of each fingerprint (unsigned) in the reflected Gray code."""
    rank = prints.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _gray_rank_column(fp: Column) -> Column:
    """As ``gray_rank``, as a signed long that sorts alike."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """The index of one segment. ``prints`` are distinct unsigned fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints[np.argsort(gray_rank(prints))]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bottom up: mask, pattern
        ones, zeros = self.prints, ~self.prints  # bits that are one, or zero, in all below
        while len(ones) > FANOUT:
            starts = np.arange(0, len(ones), FANOUT)
            ones = np.bitwise_and.reduceat(ones, starts)
            zeros = np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones | zeros, ones))

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """Masks and patterns of the upper nodes, ``FANOUT`` at most."""
        if self.levels:
            return self.levels[-1]
        return np.full(len(self.prints), ~np.uint64(0)), self.prints

    def search(self, queries: np.ndarray, radius: int):
        """Yields (places in queries, places in prints) of pairs within the radius."""
        if not len(self.prints):
            return
        top = len(self.levels)  # level 0 are the fingerprints themselves
        width = len(self.levels[-1][0]) if top else len(self.prints)
        step = max(1, _FRONT // width)
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            first = (top, np.repeat(q, width), np.tile(np.arange(width), len(q)), None, None)
            yield from self._descend(first, queries, radius)

    def _descend(self, first: tuple, queries: np.ndarray, radius: int):
        """As ``search``, from some nodes down."""
        stack = [first]
        while stack:
            level, q, node, spent, above = stack.pop()
            mask, pattern = self.levels[level - 1] if level else (None, self.prints)
            residual = np.full(len(node), ~np.uint64(0)) if mask is None else mask[node]
            if above is not None:  # bits that the upper nodes have accounted for
                residual = residual & ~above
            total = np.bitwise_count((queries[q] ^ pattern[node]) & residual).astype(np.int16)
            if spent is not None:
                total += spent
            near = np.flatnonzero(total <= radius)
            if not len(near):
                continue
            if not level:
                yield q[near], node[near]
                continue
            below = len(self.levels[level - 2][0]) if level > 1 else len(self.prints)
            for part in np.array_split(near, -(-len(near) * FANOUT // _FRONT)):
                child = (node[part][:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = child < below
                stack.append(
                    (
                        level - 1,
                        np.repeat(q[part], FANOUT)[there],
                        child[there],
                        np.repeat(total[part], FANOUT)[there],
                        np.repeat(mask[node[part]], FANOUT)[there],
                    )
                )


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; parents are smaller or the node itself."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _forest(index: pa.Table, queries: pa.Table, radius: int) -> pa.Table:
    own = index.column("fp").to_numpy().view(np.uint64)
    found = GrayIndex(np.unique(own))
    asked = np.unique(queries.column("fp").to_numpy().view(np.uint64))
    nodes = np.union1d(found.prints, asked)
    at_print, at_query = np.searchsorted(nodes, found.prints), np.searchsorted(nodes, asked)
    parent = np.arange(len(nodes))
    for q, p in found.search(asked, radius):
        _joined(parent, at_query[q], at_print[p])
    linked = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.table(
        {"a": nodes[linked].view(np.int64), "b": nodes[parent[linked]].view(np.int64)}
    )


def _upper_nodes(batches):
    """The upper nodes of one segment, in rows sorted by Gray rank."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.Table.from_batches(tables)
    segments = rows.column("segment").to_numpy()
    prints = rows.column("fp").to_numpy().view(np.uint64)
    for segment in np.unique(segments):
        mask, pattern = GrayIndex(prints[segments == segment]).top()
        yield pa.RecordBatch.from_pydict(
            {
                "segment": pa.array(np.full(len(mask), segment), pa.int32()),
                "mask": mask.view(np.int64),
                "pattern": pattern.view(np.int64),
            }
        )


def _routes(segment: np.ndarray, mask: np.ndarray, pattern: np.ndarray, radius: int):
    """Copies each fingerprint for every segment, own or later, that it may have links in."""

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = part.column("segment").to_numpy()
                fp = part.column("fp").to_numpy().view(np.uint64)
                row, node = np.nonzero(
                    np.bitwise_count((fp[:, None] ^ pattern) & mask) <= radius
                )
                later = segment[node] >= own[row]
                pairs = np.unique(row[later] * (1 << 32) + segment[node][later])
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array(pairs & 0xFFFFFFFF, pa.int32()),
                        "fp": fp[pairs >> 32].view(np.int64),
                    }
                )

    return route


def links(prints: DataFrame, radius: int, segment_size: int = 32_768) -> DataFrame:
    """``(a, b)``: links that span every group of fingerprints within ``radius`` bits.

    ``prints`` has distinct longs in ``fp``. Two fingerprints get one component exactly if
    a chain of links of at most ``radius`` bits joins them.
    """
    spark = prints.sparkSession
    count = prints.count()
    if not count:
        return spark.createDataFrame([], "a long, b long")
    ranked = prints.select("fp", _gray_rank_column(F.col("fp")).alias("rank"))
    n = -(-count // segment_size)
    bounds = (
        ranked.agg(F.percentile_approx("rank", [i / n for i in range(1, n)], 20 * n)).first()[0]
        if n > 1
        else []
    )
    bounds = np.array(sorted(set(bounds)), np.int64)

    @F.pandas_udf(T.IntegerType())
    def segment_of(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, rank.to_numpy(), side="right").astype(np.int32))

    dealt = stored(ranked.select("fp", "rank", segment_of("rank").alias("segment")), "segments")
    # FANOUT rows a segment: the part of the index that every task sees
    upper = (
        dealt.select("segment", "fp")
        .repartition("segment")
        .mapInArrow(_upper_nodes, "segment int, mask long, pattern long")
        .toPandas()
    )
    asked = dealt.select("segment", "fp").mapInArrow(
        _routes(
            upper["segment"].to_numpy().astype(np.int64),
            upper["mask"].to_numpy().view(np.uint64),
            upper["pattern"].to_numpy().view(np.uint64),
            radius,
        ),
        "segment int, fp long",
    )
    return (
        dealt.select("segment", "fp")
        .groupBy("segment")
        .cogroup(asked.groupBy("segment"))
        .applyInArrow(lambda a, b: _forest(a, b, radius), "a long, b long")
    )


def _groups(hashed: DataFrame, id_column: str, radius: int) -> DataFrame:
    """``(_fp, _root, component_id)``: the group of each distinct fingerprint in ``_fp``."""
    prints = stored(
        hashed.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_column).alias("id")), "prints"
    )
    roots = components(links(prints.select("fp"), radius))
    member = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        F.col("fp").alias("_fp"), "id", F.coalesce("root", "fp").alias("_root")
    )
    smallest = stored(member.groupBy("_root").agg(F.min("id").alias("component_id")), "smallest")
    return stored(member.join(smallest, "_root").select("_fp", "_root", "component_id"), "groups")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row, repeated rows included.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id that links
    reach, itself included. Null and empty texts have fingerprint zero and link like any
    other. Rows with a null id take part; a component of such rows alone has a null id.
    Further columns of ``docs`` are not read; an empty table gives an empty one.
    """
    hashed = stored(
        docs.select(id_column, fingerprint_column(F.col(text_column), shingle).alias("_fp")),
        "fingerprints",
    )
    return hashed.join(_groups(hashed, id_column, radius), "_fp").select(
        id_column,
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def distinct_documents(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each group, that with the smallest ``doc_id``; all columns kept as they are.

    Repeated rows are one group. A group without any id keeps one row. Of several rows with
    the kept id and fingerprint the one with the smallest hash of all its columns stays.
    Columns of any name and type pass through: rows travel as one struct. An empty table
    gives an empty one.
    """
    columns = docs.columns
    hashed = stored(
        docs.select(
            F.struct(*(docs[f"`{c}`"].alias(c) for c in columns)).alias("_row"),
            docs["doc_id"].alias("_doc"),
            fingerprint_column(docs["text"], shingle).alias("_fp"),
        ),
        "fingerprints",
    )
    groups = _groups(hashed.select("_doc", "_fp"), "_doc", radius)
    # the group's row: smallest id, of several fingerprints with it the smallest
    first = (
        hashed.select("_doc", "_fp")
        .join(groups, "_fp")
        .where(
            (F.col("_doc") == F.col("component_id"))
            | (F.col("component_id").isNull() & (F.col("_fp") == F.col("_root")))
        )
        .groupBy("_root")
        .agg(F.min(F.struct("_fp", "_doc")).alias("kept"))
        .select(F.col("kept._fp").alias("_kept"), F.col("kept._doc").alias("_id"))
    )
    same = (F.col("_fp") == F.col("_kept")) & F.col("_doc").eqNullSafe(F.col("_id"))
    # as JSON, since maps can neither be ordered nor hashed
    one = Window.partitionBy("_fp", "_doc").orderBy(F.xxhash64(F.to_json("_row")))
    return (
        hashed.join(first, same)
        .withColumn("_place", F.row_number().over(one))
        .where("_place = 1")
        .select(*(F.col("_row").getField(c).alias(c) for c in columns))
    )
