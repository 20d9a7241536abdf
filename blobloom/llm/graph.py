"""Connected components of a table of links, as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def components(links: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach. Nodes without a link have no row.

    Large and small stars in turn: in a large star every node hands its larger neighbours to its
    smallest one, in a small star its smaller ones. Links keep what they connect and end as one
    star around each smallest node, after about log(nodes) rounds. Smallest neighbours are found
    by min(), which adds up before the shuffle, and join back to the links, so no task holds the
    neighbours of a node. Each round is written, which also ends its lineage.

    Null ends and self-links are no links; repeated links count once; an empty table gives none.
    """
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = written(edges.distinct(), "links")
    for _ in range(most_rounds):
        if _is_forest_of_stars(edges):
            centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-star")

        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "small-star")
    raise RuntimeError(f"components: not done after {most_rounds} rounds")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each star is one component."""
    several = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return several.unionByName(chained).isEmpty()
