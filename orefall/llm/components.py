"""Connected components over link tables, by alternating large and small stars.

Nothing is collected: each round is two aggregations and two joins over the edges, written
to the shared folder. A hub with very many links is safe, since its minimum is taken with
map-side partial aggregation and the joins are plain sort-merge joins that adaptive
execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import drop_stored, store


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link.

    ``edges`` has long columns a and b. Nulls and self links are ignored, repeated links
    count once; an empty table gives an empty result.
    """
    e = store(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = e.join(least, e["v"] == least["x"]).select("u", F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, large["u"] == low["w"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u != v").distinct()
        new = store(small, "links")
        drop_stored(e)
        e = new
        # Done when the links are stars: each node hangs on one centre and no centre hangs on another.
        depth = e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        if e.isEmpty() or (not depth.where("n > 1").limit(1).count() and not e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()):
            break
    else:
        raise RuntimeError("connected_components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
