"""Connected components of a distributed edge table by alternating large-star and small-star rounds
(Kiveris et al., 2014). No task holds a whole component, the neighbours of a node with more than HUB are dealt to
several tasks, and nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize


#: Neighbours that one task takes of a node at most, and the tasks that those of a node with more are dealt to.
HUB, SALTS = 1 << 16, 64


def _with_least(pairs: DataFrame, most: int) -> DataFrame:
    """pairs (u, v) with m, the least of u and its v; most: pairs that any u has. Where those are more than HUB, every
    node's neighbours are dealt to salts; the least is taken by salt and then over the salts, and goes back to them, so
    a node with very many neighbours is never one task. Else one exchange does."""
    if most <= HUB:
        least = F.first("v").over(Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return pairs.select("u", "v", F.least(least, F.col("u")).alias("m"))
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("u", "s").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    least = part.groupBy("u").agg(F.min("low").alias("m"))
    return salted.join(part.select("u", "s").join(least, "u"), ["u", "s"]).select("u", "v", "m")


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Each node and its other lower neighbours go to the least of them; for v = m the pair is the node's own.
    hung = _with_least(down, most).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return hung.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """(neighbours of the node with most, whether all is done) of distinct edges (u, v) with v < u: when every u has one
    edge, and none is the v of another, each edge points at its component's least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    most, open_ = nodes.agg(F.max("n"), F.max((F.col("up") > 0) & (F.col("n") > 1))).first()
    return most or 0, not open_


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u long, v long) -> (node, component): component is the least node id reachable.

    Nodes without an edge to another node are absent. Nulls and self-loops are ignored, repeats are
    harmless, no edges give no rows. Extra columns are ignored."""
    ends = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u != v")
    now = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        most, done = _state(now)
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        # A large star gives no node more lower neighbours than it had.
        after = materialize(_small_star(_large_star(now, most), most), "stars")
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
