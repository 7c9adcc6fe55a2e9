"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import cut, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node that has a link; the component is its smallest node.

    Each round points all neighbours of a node at the smallest of them, first the larger ones, then the
    smaller ones (large star, small star). Smallest neighbours come from a map-side combined minimum, and
    neighbours meet them in a plain equi-join, so a hub with any number of links is never collected into one
    row and a skewed one is split at run time. Each round is written to the checkpoint folder; the loop ends when a
    round changes nothing. Loops, repeated links and null ends are ignored; no links give no rows.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    stars = cut(ends.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    state = _state(stars)
    while state[0]:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(large)
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(smallest, "hi")
            .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
            .union(smallest.select("hi", F.col("m").alias("lo")))
            .where("hi <> lo")
            .distinct()
        )
        after = cut(small)
        release(stars, large)
        stars, before, state = after, state, _state(after)
        if state == before:
            break
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def with_links(components: DataFrame, links: DataFrame) -> DataFrame:
    """The ``(node, component)`` of :func:`connected_components` after further ``links(a, b)``.

    Only the components that the links touch are contracted, as nodes of a graph of their own; what is already joined is renamed by
    one equi-join. A node that ``components`` does not hold is its own component. The result is a written table.
    """
    side = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    met = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    over = cut(connected_components(met.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))))
    names = over.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    renamed = components.join(names, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    after = cut(renamed.union(over).distinct())
    release(over)
    return after


def _state(stars: DataFrame) -> tuple:
    """Count and an order-free sum of hashes: equal before and after a round when no star changed."""
    row = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]
