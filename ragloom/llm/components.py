"""Connected components of a link table by alternating star contraction.

Large-star / small-star (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014), written as joins and ``min`` aggregations so that the
neighbourhood of a hub is never collected into one group: the minimum of a
node is a partial aggregate and the rewiring is a join that adaptive
execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(
        edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    low = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
    return (both.where("o > n").join(low, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    rewired = (edges.select(F.col("u").alias("n"), F.col("v").alias("o")).join(low, "n")
               .select(F.col("o").alias("u"), F.col("m").alias("v")))
    return rewired.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): ``root`` is the smallest node reachable, for every node that has a link.

    ``links`` holds one row per undirected link in columns ``a`` and ``b`` of
    one orderable type. Null ends and self links are dropped; an empty table
    gives an empty result. Only a count and a checksum come to the driver per
    round; each round is checkpointed.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        edges = cut(_small_star(_large_star(edges)))
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
