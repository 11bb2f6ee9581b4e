"""Connected components by alternating large and small stars (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Each round points all larger neighbours of a node at its smallest one, then
    all smaller ones, until nothing changes: stars remain.  Minima are taken
    before the shuffle and written, so a hub's edges meet one row of a plain
    table, and adaptive execution may split them over tasks.  Each round is a
    written table.  The number of rounds grows with the logarithm of the longest
    path; a graph that isn't done after max_rounds is an error, never a partial
    answer.  Loops, repeated edges and null ends are left out.
    """
    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.save(small, "stars")
        new_state = _state(new)
        for table in (now, low, large, least):
            scratch.drop(table)
        now = new
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"components: not done after {max_rounds} rounds")
    low = now.groupBy("u").agg(F.min("v").alias("v"))
    return low.select(F.col("u").alias("node"), F.col("v").alias("component")).union(low.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
