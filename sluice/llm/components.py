"""Connected components of a table of links, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import saved


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): for each node of a link, the smallest node that it reaches.

    Alternates large-star and small-star steps: each hangs the neighbours of a
    node below the least of them, until the links are stars.  The number of
    links never grows, and steps needed grow with the logarithm of the longest
    path.  Self links and repeated links are allowed; null ends are ignored; an
    empty table gives an empty result.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = saved(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        following = saved(small)
        # Stars: no end of a link is both below a root and a root itself, and the set stands still.
        moved = following.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(following, ["u", "v"], "left_anti").limit(1).count()
        edges = following
        if not moved:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
