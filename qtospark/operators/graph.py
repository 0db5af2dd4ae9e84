"""Iterative operators: components, one-to-one matching, leader clustering.

Each round is an ordinary join/aggregate job whose result is written with
``checkpoint()``, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node with an edge; the component is its smallest node.

    Alternates large-star and small-star steps: the number of rounds grows with the
    logarithm of the longest chain.  Every step joins the edges with one minimum per
    node, so neighbour lists are never collected, however many edges a node has.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    e = e.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()
    e = cut(e)
    state = _fingerprint(e)
    while True:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
        large = (
            both.join(low, "src").filter("dst > src")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
        )
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = (
            large.join(low, "src").filter("dst <> m")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .unionByName(low.select("src", F.col("m").alias("dst"))).distinct()
        )
        e = cut(small)
        new = _fingerprint(e)
        if new == state:
            break
        state = new
    return (
        e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        .unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")))
        .distinct()
    )


def mutual_best(candidates: DataFrame, left: str, right: str, score: Column) -> DataFrame:
    """Greedy one-to-one assignment over candidate pairs in ascending ``(score, left, right)``.

    A pair that is the best of both its sides would be the next greedy choice for them,
    so all such pairs are accepted at once, both sides leave, and the rest repeats until
    no candidate is left.  The result equals the sequential greedy one.
    """
    pool = cut(candidates.select(left, right, score.alias("_s")).distinct())
    done = None
    while True:
        bl = pool.groupBy(left).agg(F.min(F.struct("_s", left, right)).alias("_b")).select("_b.*")
        br = pool.groupBy(right).agg(F.min(F.struct("_s", left, right)).alias("_b")).select("_b.*")
        pick = cut(bl.join(br, ["_s", left, right]))
        if pick.isEmpty():
            break
        done = pick if done is None else done.unionByName(pick)
        pool = cut(
            pool.join(pick.select(left), left, "left_anti").join(pick.select(right), right, "left_anti")
        )
    out = pick if done is None else done
    return out.select(left, right, F.col("_s").alias("score"))


def greedy_leaders(nodes: DataFrame, pairs: DataFrame, node: str, rank: str) -> DataFrame:
    """Sequential leader clustering: ``(node, leader)`` for every node.

    Walking nodes by ``(rank, node)``, a node joins the first earlier *kept* node it is
    paired with, or is kept itself.  ``pairs`` has columns ``(a, b)`` where ``a`` precedes
    ``b``.  Rounds decide every node whose earlier partners are all decided, which gives
    the same clusters as the sequential walk.
    """
    state = cut(nodes.select(node, rank).distinct().withColumn("leader", F.lit(None).cast(nodes.schema[node].dataType)))
    edges = cut(pairs.select("a", "b").filter("a <> b").distinct())
    while True:
        s = state.select(F.col(node).alias("a"), F.col("leader").alias("_la"), F.col(rank).alias("_ra"))
        j = edges.join(s, "a").groupBy("b").agg(
            F.min(F.when(F.col("_la") == F.col("a"), F.struct("_ra", "a"))).alias("_kept"),
            F.min(F.when(F.col("_la").isNull(), F.struct("_ra", "a"))).alias("_open"),
        )
        nxt = state.join(j, state[node] == j["b"], "left")
        joins = F.col("_kept").isNotNull() & (F.col("_open").isNull() | (F.col("_kept") < F.col("_open")))
        nxt = nxt.withColumn(
            "leader",
            F.when(F.col("leader").isNotNull(), F.col("leader"))
            .when(joins, F.col("_kept.a"))
            .when(F.col("_open").isNull(), F.col(node)),
        ).select(node, rank, "leader")
        state = cut(nxt)
        if state.filter(F.col("leader").isNull()).isEmpty():
            break
    return state.select(node, "leader")
