"""Connected components by randomised contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, small


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): root is the smallest node that links reach.

    Each round, every node points to the neighbour (or itself) whose hash for that round is smallest, then follows
    two pointers more; edges are carried over to what their ends point to, and those inside one target vanish. The expected
    number of nodes left falls by a constant factor each round, so chains take O(log n) rounds too. Every round is a written
    table, and only the count of edges left comes to the driver; it bounds the pointers, which are broadcast if few. No edges: an empty table.
    """
    e = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = e.count()
    if not n:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    maps: list[DataFrame] = []
    while n:
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("v"))
        ends = e.select("a", rank("b").alias("x")).union(e.select(F.col("b"), rank("a")))
        best = ends.groupBy("a").agg(F.min("x").alias("x"))
        m = scratch.save(best.select(F.col("a").alias("node"), F.least("x", rank("a")).getField("v").alias("to")))
        hops = lambda a, b: small(m.select(F.col("node").alias(a), F.col("to").alias(b)), 2 * n)  # noqa: B023, E731
        far = scratch.save(m.join(hops("to", "then"), "to").join(hops("then", "last"), "then").select("node", F.col("last").alias("to")))
        scratch.drop(m)
        maps.append(small(far, 2 * n))
        left, right = (small(far.select(F.col("node").alias(c), F.col("to").alias("t" + c)), 2 * n) for c in "ab")
        moved = e.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        done, e = e, scratch.save(moved if 2 * n <= BROADCAST_ROWS else moved.distinct())  # few edges may repeat: that costs less than a shuffle
        scratch.drop(done)
        n = e.count()
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    out = scratch.save(out)
    roots = out.groupBy("to").agg(F.min("node").alias("root"))
    return scratch.save(out.join(roots, "to").select("node", "root"))
