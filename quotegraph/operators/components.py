"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Each half step is one aggregation (partial per task, so a hub costs a row a task) and one join
whose sides are both scans of written tables, so adaptive execution can split a hub's partition.
Nothing is collected; only a count and a checksum of the edges reach the driver each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegraph.plans.shared import forget, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    out = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
    forget(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc-small")
    forget(least)
    return out


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge: the least node that can be reached.

    Direction, repeats and self-links don't matter; rows with a null end are no edges. An empty
    table gives an empty result. Raises if ``max_rounds`` rounds don't suffice.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    loops = pairs.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = materialize(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-start")
    if now.isEmpty():
        return loops.distinct()
    seen = None
    for _ in range(max_rounds):
        large = _large_star(now)
        small = _small_star(large)
        forget(large)
        forget(now)
        now = small
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = members.unionByName(roots.distinct())
    return found.unionByName(loops.distinct()).groupBy("node").agg(F.min("component").alias("component"))
