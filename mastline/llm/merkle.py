"""Merkle manifest of a dataset: a tree of SHA-256 digests whose parents retain hash states.

Rows are leaves, trees of leaves stand by group, and the groups' roots make one more tree.
A parent hashes the hex digests of up to ``ARITY`` consecutive children. While it does so it
copies its hash state before each child: putting another digest in one child's place then
resumes that state with the new digest and the siblings right of it, never those on the left.

The trees are cut into blocks of ``ARITY ** BLOCK_LEVELS`` neighbours. A block is one Spark
group, whatever the group of rows it belongs to; the digests of the blocks are the nodes of the
next round. On the way down every block gets the siblings that lead from its top to the root.
"""

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mastline.llm.runtime import stored

ARITY = 3
BLOCK_LEVELS = 7
_PATH = "array<struct<left: string, right: string>>"


def leaf_column(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of the values in order: byte count, a colon and the value; ``-`` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(
            F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_above(leaves: int) -> int:
    """How many levels of parents a tree of so many leaves has; none above a lone leaf."""
    levels, reach = 0, 1
    while reach < leaves:
        levels, reach = levels + 1, reach * ARITY
    return levels


class Subtree:
    """The lowest ``levels`` levels over neighbouring digests, with a hash state per child."""

    def __init__(self, digests: list[str], levels: int):
        self.rows, self.before = [digests], []
        for _ in range(levels):
            parents, states = [], []
            for start in range(0, len(digests), ARITY):
                state = sha256()
                for child in digests[start : start + ARITY]:
                    states.append(state.copy())
                    state.update(child.encode())
                parents.append(state.hexdigest())
            self.before.append(states)
            self.rows.append(parents)
            digests = parents

    def siblings(self, place: int) -> Iterator[tuple[str, str]]:
        """The digests left and right of a leaf and of each node above it."""
        for row in self.rows[:-1]:
            start = place - place % ARITY
            yield "".join(row[start:place]), "".join(row[place + 1 : start + ARITY])
            place //= ARITY

    def fold(self, place: int, digest: str) -> str:
        """The top if the leaf had another digest."""
        for row, states in zip(self.rows, self.before):
            state = states[place].copy()
            state.update(digest.encode())
            state.update("".join(row[place + 1 : place - place % ARITY + ARITY]).encode())
            digest, place = state.hexdigest(), place // ARITY
        return digest


class Ascent:
    """The way from a block's top to the root: one retained state and right siblings a level."""

    def __init__(self, path: list[dict]):
        self.steps = [(sha256(p["left"].encode()), p["right"].encode()) for p in path]
        self.siblings = "".join(p["left"] + p["right"] for p in path)

    def fold(self, digest: str) -> str:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest.encode())
            state.update(right)
            digest = state.hexdigest()
        return digest


def _subtree(block: pa.Table, done: int, height: int) -> Subtree:
    """``block`` in order of ``pos``, ``done`` levels of its tree being below it."""
    levels = levels_above(block["n"][0].as_py()) - done
    return Subtree([d.hex() for d in block["digest"].to_pylist()], max(0, min(height, levels)))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 within ``part`` by ``order``, and ``n``, its size.

    Rows are dealt by ranges of (part, order), so that a part with most rows, or a row repeated
    any number of times, spreads over many tasks; only counts per range are added up in a row.
    """
    keys = ["part", *order, "_salt"]
    dealt = stored(
        rows.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    before = Window.partitionBy("part").orderBy("_range")
    counts = (
        dealt.groupBy("part", "_range")
        .agg(F.count("*").alias("_rows"))
        .select(
            F.col("part").alias("_part"),
            F.col("_range").alias("_number"),
            (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"),
            F.sum("_rows").over(Window.partitionBy("part")).alias("n"),
        )
    )
    within = Window.partitionBy("part", "_range").orderBy(*order, "_salt")
    return (
        dealt.withColumn("_at", F.row_number().over(within))
        .join(counts, F.col("part").eqNullSafe(F.col("_part")) & (F.col("_range") == F.col("_number")))
        .withColumn("pos", F.col("_before") + F.col("_at") - 1)
        .drop("_salt", "_range", "_at", "_part", "_number", "_before")
    )


def _tops(done: int, height: int):
    """A function from a block to the row of its top in the next round."""

    def top(block: pa.Table) -> pa.Table:
        tree = _subtree(block.sort_by("pos"), done, height)
        first = block.slice(0, 1)
        digest = pa.array([bytes.fromhex(tree.rows[-1][0])], pa.binary())
        return pa.table(
            {"part": first["part"], "pos": first["block"], "n": first["n"], "digest": digest}
        )

    return top


def _climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, and the root of each part as (part, digest).

    ``nodes`` has part, pos, n and digest; further columns stay in the first round's table.
    """
    with_block = lambda df: df.withColumn("block", F.floor(F.col("pos") / ARITY**height))
    rounds = [stored(with_block(nodes), "nodes")]
    largest = rounds[0].agg(F.max("n")).first()[0] or 0
    while True:
        done = (len(rounds) - 1) * height
        tops = (
            rounds[-1]
            .select("part", "block", "pos", "n", "digest")
            .groupBy("part", "block")
            .applyInArrow(
                _tops(done, height),
                T.StructType(
                    [nodes.schema["part"], T.StructField("pos", T.LongType()),
                     T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
                ),
            )
        )
        tops = stored(with_block(tops), "nodes")
        if done + height >= levels_above(largest):
            return rounds, tops.select("part", "digest")
        rounds.append(tops)


def _descend(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """(part, block, subroot, root, path) for each block of the first round.

    ``above`` has one row per part: part, subroot, root and the path from its root on.
    """
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for number in range(len(rounds) - 1, 0, -1):
        paths = _paths(rounds[number], paths, number, height).withColumnRenamed("pos", "block")
    return paths


def _paths(nodes: DataFrame, paths: DataFrame, number: int, height: int) -> DataFrame:
    """(part, pos, subroot, root, path) of every node of a round, from the paths of its blocks."""
    schema = T.StructType(
        [nodes.schema["part"], T.StructField("pos", T.LongType())]
    ).add("subroot", "string").add("root", "string").add("path", _path_type())

    def spread(block: pa.Table, path: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        tree = _subtree(block, number * height, height)
        above = path["path"][0].as_py()
        own = [[{"left": a, "right": b} for a, b in tree.siblings(i)] for i in range(len(block))]
        return pa.table(
            {
                "part": block["part"],
                "pos": block["pos"],
                "subroot": pa.array([path["subroot"][0].as_py()] * len(block), pa.string()),
                "root": pa.array([path["root"][0].as_py()] * len(block), pa.string()),
                "path": pa.array([p + above for p in own], _arrow_path()),
            }
        )

    return (
        nodes.select("part", "block", "pos", "n", "digest")
        .groupBy("part", "block")
        .cogroup(paths.groupBy("part", "block"))
        .applyInArrow(spread, schema)
    )


def _path_type() -> T.DataType:
    return T._parse_datatype_string(_PATH)


def _arrow_path() -> pa.DataType:
    return pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def manifest(
    leaves: DataFrame,
    group: str,
    order: str,
    carried: Sequence[str] = (),
    height: int = BLOCK_LEVELS,
) -> DataFrame:
    """Roots and proofs of every leaf, and where another digest in its place would lead.

    ``leaves`` has ``leaf``, a hex digest, ``found``, the digest found when it was looked at
    again (null: the same), the column ``group`` and the columns ``order`` and ``carried``,
    which must be of types that Arrow knows. Within a group, leaves ascend by ``order`` (null
    first) and then by digest; groups ascend with null first. Result, one row per leaf:
    ``group``, ``order``, ``carried``, ``leaf``, ``subroot`` (of the group), ``root``,
    ``proof_sha256`` (of all siblings up to the root, left to right), ``folded_root`` (with
    ``found`` in place) and ``verified`` (whether that is the root).

    Repeated rows are leaves of their own. Without any leaf the result is empty. No group is
    gathered anywhere: a task sees blocks of ``ARITY ** height`` leaves.
    """
    kept = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate([order, *carried])))
    rows = stored(
        leaves.select(
            F.col(group).alias("part"),
            F.col(order).alias("place"),
            F.unhex("leaf").alias("digest"),
            F.unhex(F.when(F.col("found") != F.col("leaf"), F.col("found"))).alias("found"),
            kept.alias("kept"),
        ),
        "leaves",
    )
    rounds, subroots = _climb(placed(rows, ["place", "digest"]).drop("place"), height)
    # the roots of the groups are the leaves of one more tree
    tops = subroots.select(
        F.lit(0).alias("part"), F.col("part").alias("group"), "digest"
    )
    upper, root = _climb(placed(tops, ["group"]), height)
    start = root.select(
        "part",
        F.lit("").alias("subroot"),
        F.lower(F.hex("digest")).alias("root"),
        F.array().cast(_PATH).alias("path"),
    )
    group_paths = _paths(upper[0], _descend(upper, start, height), 0, height).withColumnRenamed("part", "_one")
    above = (
        upper[0]
        .join(group_paths.drop("subroot"), "pos")
        .select(
            F.col("group").alias("part"),
            F.lower(F.hex("digest")).alias("subroot"),
            "root",
            "path",
        )
    )
    paths = _descend(rounds, stored(above, "groups"), height)
    names = [f"c{i}" for i in range(1 + len(carried))]
    out = T.StructType([rounds[0].schema["part"], rounds[0].schema["kept"]])
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        out = out.add(name, "string")

    def proofs(block: pa.Table, path: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        tree = _subtree(block, 0, height)
        ascent = Ascent(path["path"][0].as_py())
        subroot, root = path["subroot"][0].as_py(), path["root"][0].as_py()
        found = block["found"].to_pylist()
        proof, folded = [], []
        for place, leaf in enumerate(tree.rows[0]):
            own = "".join(a + b for a, b in tree.siblings(place))
            proof.append(sha256((own + ascent.siblings).encode()).hexdigest())
            seen = leaf if found[place] is None else found[place].hex()
            folded.append(ascent.fold(tree.fold(place, seen)))
        return pa.table(
            {
                "part": block["part"],
                "kept": block["kept"],
                "leaf": tree.rows[0],
                "subroot": [subroot] * len(block),
                "root": [root] * len(block),
                "proof_sha256": proof,
                "folded_root": folded,
            }
        )

    return (
        rounds[0]
        .select("part", "block", "pos", "n", "digest", "found", "kept")
        .groupBy("part", "block")
        .cogroup(paths.groupBy("part", "block"))
        .applyInArrow(proofs, out)
        .select(
            F.col("part").alias(group),
            *(F.col(f"kept.{n}").alias(c) for n, c in zip(names, [order, *carried])),
            "leaf", "subroot", "root", "proof_sha256", "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


#: columns of a document's leaf, in order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def checked_documents(
    docs: DataFrame, text_found: Column | None = None, height: int = BLOCK_LEVELS
) -> DataFrame:
    """The manifest of ``docs`` by ``source`` and ``doc_id``, checked against texts found later.

    ``text_found`` is the text as read again; by default the same. Null fields, empty and
    very long texts are hashed like any other; a row without ``doc_id`` comes first in its
    source. Columns other than ``FIELDS`` are not read.
    """
    plain = [F.col(c) for c in FIELDS]
    text = plain[-1] if text_found is None else text_found
    leaves = docs.select(
        "doc_id",
        "source",
        leaf_column(plain).alias("leaf"),
        F.when(~text.eqNullSafe(F.col("text")), leaf_column([*plain[:-1], text])).alias("found"),
    )
    return manifest(leaves, "source", "doc_id", height=height)
