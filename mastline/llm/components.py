"""Connected components of a link table, by alternating large and small stars.

Every round keeps the components and the number of links, and moves each node closer to
the smallest node of its component. State is one row per link; nothing is collected.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastline.llm.runtime import stored


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(links: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to its smallest neighbour."""
    both = links.select("node", "root").unionAll(
        links.select(F.col("root").alias("node"), F.col("node").alias("root"))
    )
    # stored, so that the join below starts from two plain exchanges and a hub can be split
    least = stored(
        both.groupBy("node").agg(F.min("root").alias("least")).select(
            "node", F.least("least", "node").alias("least")
        ),
        "star",
    )
    return (
        both.where("root > node")
        .join(least, "node")
        .select(F.col("root").alias("node"), F.col("least").alias("root"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; node > root holds."""
    least = stored(links.groupBy("node").agg(F.min("root").alias("least")), "star")
    return (
        links.join(least, "node")
        .select(F.explode(F.array("node", "root")).alias("node"), F.col("least").alias("root"))
        .where("node > root")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node that has a link, the root itself left out.

    ``links`` has two columns of one orderable type. Self links and nulls are ignored,
    repeated links count once; an empty table gives an empty one.
    """
    a, b = links.columns
    links = stored(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
        .distinct(),
        "links",
    )
    before = _fingerprint(links)
    while before[0]:
        links = stored(_small_star(stored(_large_star(links), "links")), "links")
        now = _fingerprint(links)
        if now == before:
            break
        before = now
    return links
