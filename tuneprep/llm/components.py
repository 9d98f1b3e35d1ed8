"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (partially aggregated, so a node with a third of all links is one
row per task) and an equi-join; nothing is collected but one sum per round. Each round's links
are written to the shared scratch folder. The number of rounds grows with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen


def _state(links: DataFrame) -> tuple:
    """Number and order-independent fingerprint of the links."""
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Connect the neighbours of each node to the smallest one (a > b in every link).

    Large star (``both``): neighbours above the node. Small star: the node and those below it.
    """
    pairs = links.select("a", "b")
    if both:
        pairs = pairs.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written first, so that the join's two sides are plain shuffles and a hot node can be split.
    least = frozen(pairs.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
    joined = pairs.join(least, pairs["a"] == least["u"])
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links(a, b)``, ``a > b``: root is the smallest one reached.

    Roots themselves are not listed. An empty table gives an empty table.
    """
    links = frozen(links.select("a", "b").distinct(), "links")
    state = _state(links)
    while state[0]:
        links = frozen(_star(_star(links, True), False), "links")
        after = _state(links)
        if after == state:
            break
        state = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
