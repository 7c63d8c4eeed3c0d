"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node in ``links`` (u, v).

    Links are rewired to ever smaller neighbours, in turn from the larger and from the
    smaller side, until every component is a star around its least node. Each round is
    one aggregate and one join; the number of rounds grows with the logarithm of the
    longest path. Null ends and loops are ignored.
    """
    edges = stored(_downward(links), "links")
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()


def _downward(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _least(edges: DataFrame) -> DataFrame:
    """``edges`` with m, the least of u and its neighbours."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its least neighbour instead."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, are linked to the least of them."""
    near = _least(edges)
    hooked = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _downward(hooked.unionByName(near.select("u", F.col("m").alias("v"))))
