"""Connected components of large graphs, as DataFrames: alternating large-star and small-star steps.

Each step hangs every neighbour on the smallest one known. Hot nodes are aggregated (a minimum, combined
before the shuffle) or joined, and a join deals a node's edges over SALT keys. The edges are written to the
shared folder after each round, so no lineage grows and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragspark.llm.shared import stored


#: A node's edges are joined in so many parts.
SALT = 16


def _hung(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, m): each edge with its u's entry in ``least`` (u, m)."""
    dealt = edges.withColumn("part", F.expr(f"cast(pmod(xxhash64(v), {SALT}) as int)"))
    return dealt.join(least.withColumn("part", F.explode(F.expr(f"sequence(0, {SALT - 1})"))), ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node. Self-loops and nulls are left out."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = _hung(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = larger.unionByName(both.where("v < u").groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _hung(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        new = _state(after)
        now = after
        if new == state:
            break
        state = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])
