"""Connected components of links between ids, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import drop, kept

#: A node with more edges than this, and than a 10,000th of all, has its edges dealt to several parts.
PART = 256


def beside(edges: DataFrame, least: DataFrame, part: int, most: int) -> DataFrame:
    """edges (u, v) with m of least (u, m, n) added, where n is the number of edges of u and ``most`` the greatest of these.

    A node of many edges is joined in parts of about ``part`` edges. No more nodes than edges / part have parts, so with ``part``
    a 10,000th of all edges or more, the table of these nodes has 10,000 rows at most and is broadcast.
    """
    if most <= part:
        return edges.join(least.select("u", "m"), "u")
    many = F.broadcast(least.where(F.col("n") > part).select("u", F.ceil(F.col("n") / part).cast("int").alias("parts")))
    left = edges.join(many, "u", "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), "parts"), F.lit(0)).cast("int").alias("at"))
    right = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / part).cast("int") - 1)).alias("at"))
    return left.join(right, ["u", "at"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to id, component: the smallest id that each id of a link can reach.

    Large-star and small-star steps by turns: every id points its larger neighbours, then its smaller ones, at the smallest id
    beside it. A turn is two aggregates with a join each, and is written down; the number of turns grows with the logarithm of
    the longest path. It ends when all that is left are stars: no id beside a smaller one has a second neighbour. Links of an id
    with itself and repeated links do no harm.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n"))
        least = kept(least.select("u", F.least("u", "v").alias("m"), "n"))
        rows, most, open_ = least.agg(F.sum("n"), F.max("n"), F.max((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
        if not open_:
            drop(least)
            break
        part = max(PART, rows // 10_000)
        large = kept(beside(both, least, part, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = beside(large, lower, part, most).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = kept(small.where("u <> v").distinct())
        drop(edges, least, large)
        edges = new
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (id, component) after some more links (a, b): only their components are looked at again."""
    side = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"top_{c}"))
    own = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("top_a", "a").alias("x"), F.coalesce("top_b", "b").alias("y"))
    own = kept(own)
    tops = components(own.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # Ids that only these links have.
    new = own.select(F.col("a").alias("id"), F.col("x").alias("component")).unionByName(own.select(F.col("b").alias("id"), F.col("y").alias("component"))).where("id = component").distinct()
    every = found.unionByName(new.join(found.select("id"), "id", "left_anti"))
    tops = tops.select(F.col("id").alias("component"), F.col("component").alias("top"))
    return every.join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
