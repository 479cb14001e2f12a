"""Connected components by alternating large-star and small-star steps.

Each step is two aggregates and equi-joins over the edge table; the table is
written to the shared folder between rounds. Nothing is gathered in a task or
on the driver but a count and a checksum. A hub's edges are dealt to ``SALTS``
parts: its least neighbour is found in a partial ``min`` and goes back to every part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

SALTS = 16


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return row.n, row.h


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m, the least v of their u."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt")
    least = edges.groupBy("u", salt).agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    return edges.select("u", "v", salt).join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: BIGINT) -> (node, component): component is the smallest
    node reachable. Loops and repeated edges are fine; nodes without edges do
    not appear; null ends are dropped."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = saved(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large)
        ends = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        following = saved(ends.where("u <> v").distinct(), "edges")
        before, state = state, _state(following)
        forget(now)
        now = following
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
