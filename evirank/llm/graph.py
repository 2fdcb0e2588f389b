"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import checkpointed


def _toward_least(pairs: DataFrame, only_smaller: bool) -> DataFrame:
    """One star round over undirected pairs(a, b), a > b: each node links its (larger / smaller) neighbours to the least node near it.

    The least neighbour comes from a grouped minimum (combined before the shuffle) that is joined back, so no node's
    neighbourhood is ever gathered in one place."""
    both = pairs if only_smaller else pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if only_smaller:
        out = joined.select(F.col("b").alias("a"), "m").unionAll(least)
    else:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), "m")
    return out.where("a <> m").select("a", F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a bigint, b bigint), any direction, repeats allowed -> (node, root): root is the least node reachable, for every node with a link.

    Each round is written to the checkpoint folder; it ends when a round changes nothing. Rounds grow with the logarithm
    of the size of a component, not with its diameter. Self links and null ends are dropped; an empty table gives no rows.
    """
    pairs = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        pairs = checkpointed(_toward_least(_toward_least(pairs, False), True))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
