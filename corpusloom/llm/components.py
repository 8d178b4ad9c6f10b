"""Connected components of a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import joined_anew, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id of a link the smallest id that it reaches. Null ends and links to oneself are left out.

    Large star and small star by turns: every id's larger neighbours are tied to its smallest neighbour, then every id's
    smaller ones. Minima are aggregated before the shuffle and joined back so that a hub's links can be split over tasks.
    Each turn is written to the shared folder; the loop ends when a turn changes nothing. No links: an empty table. A link
    that is there twice counts once, and its ends may stand in either order."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    edges = stored(edges.where("x and y and u > v").select("u", "v").distinct(), "links")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(joined_anew(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(joined_anew(low, "u"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now[0] == now[2] and (last == now or not _chained(edges)):
            break
        last = now
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _chained(edges: DataFrame) -> bool:
    """Whether any end of a link is itself tied to a smaller id."""
    return not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
