"""Connected components of links held in a DataFrame, by alternating star contraction.

Each round points every vertex at the smallest vertex it knows of (large star: neighbours above a
vertex move to the smallest one; small star: those below do), so long paths fold in a logarithmic
number of rounds.  Everything is group-by-minimum, combined before its shuffle, and joins on vertices
that adaptive execution can split; nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import free, saved

MAX_ROUNDS = 60


def _point(edges: DataFrame) -> DataFrame:
    """v: vertex, u: a smaller vertex; each vertex once for each smaller one."""
    return edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  Returns id, component (saved) for every vertex that has a link to another one; component is its smallest vertex."""
    state = saved(_point(edges), "links")
    for _ in range(MAX_ROUNDS):
        # large star: u's larger neighbours go to the smallest of u and its neighbours
        down = state.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "w")
        large = state.join(down, state["u"] == down["w"], "left").select("v", F.coalesce("m", "u").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        # small star: v and its smaller neighbours go to the smallest of these
        moved = large.distinct().join(least, "v")
        small = moved.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        after = saved(small.filter("u < v").distinct(), "links", like=state)
        free(state)
        # done when every vertex has one link, to a vertex without any
        open_ = after.join(after.select(F.col("v").alias("w")), after["u"] == F.col("w"), "left_semi").limit(1).count()
        if not open_ and after.groupBy("v").count().filter("count > 1").limit(1).count() == 0:
            out = after.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(after.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
            out = saved(out, "components", like=after)
            free(after)
            return out
        state = after
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
