"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of links (a, b): the smallest id that it can reach.

    Every id points to its smallest neighbour, pointers are followed to their roots by doubling, and the links between unlike roots are the next
    round's. Each round at least halves the roots that still have links. Pairs are distinct before each round, so copies cost nothing.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        points = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("comp")), "points")
        while True:
            jumped = materialize(points.join(points.toDF("comp", "next"), "comp", "left").select("id", "comp", F.coalesce("next", "comp").alias("next")), "points")
            moved = not jumped.where("comp <> next").isEmpty()
            points = jumped.select("id", F.col("next").alias("comp"))
            if not moved:
                break
        levels.append(points)
        ends = edges.join(points.toDF("a", "x"), "a").join(points.toDF("b", "y"), "b").where("x <> y")
        edges = materialize(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    out = levels[0]
    for deeper in levels[1:]:
        out = out.join(deeper.toDF("comp", "next"), "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))
    return materialize(out, "components")
