"""One-to-one assignment by distance without materialising the pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .spatial import nearest
from .walks import PAIR_ROWS, each_group, split_groups


def _spots(df: DataFrame, keys: list[str], node: str, x: str, y: str) -> DataFrame:
    return df.groupBy(*keys, x, y).agg(F.min(node).alias(node), F.count(F.lit(1)).alias("_n"))


def greedy_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
                   radius: float, x: str = "cx", y: str = "cy", most: int = PAIR_ROWS) -> DataFrame:
    """Greedy assignment in ascending distance: ``(left_id, right_id, dist)``.

    Groups of at most ``most`` rows of both sides are walked by one task; larger ones go by :func:`_by_rounds`, which
    takes the same pairs.
    """
    here = F.col(x).isNotNull() & F.col(y).isNotNull()
    for k in keys:
        here = here & F.col(k).isNotNull()
    a, b = left.filter(here).select(left_id, *keys, x, y), right.filter(here).select(right_id, *keys, x, y)
    rows = cut(a.unionByName(b, allowMissingColumns=True))
    small, large = split_groups(rows, keys, most)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def walk(group: list[dict]) -> list[dict]:
        lhs, rhs = [r for r in group if r[left_id] is not None], [r for r in group if r[right_id] is not None]
        pairs = []
        for p in lhs:
            for q in rhs:
                d = math.sqrt((p[x] - q[x]) * (p[x] - q[x]) + (p[y] - q[y]) * (p[y] - q[y]))
                if d <= radius:
                    pairs.append((d, p[left_id], q[right_id]))
        taken, used, out = set(), set(), []
        for d, i, j in sorted(pairs):
            if i not in taken and j not in used:
                taken.add(i)
                used.add(j)
                out.append({left_id: i, right_id: j, "dist": d})
        return out

    out = each_group(small, keys, [], walk, f"`{left_id}` {kind[left_id]}, `{right_id}` {kind[right_id]}, dist double")
    if large is None:
        return out
    sides = [large.filter(F.col(i).isNotNull()).select(i, *keys, x, y) for i in (left_id, right_id)]
    return out.unionByName(_by_rounds(*sides, keys, left_id, right_id, radius, x, y))


def _by_rounds(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, radius: float, x: str, y: str) -> DataFrame:
    """:func:`greedy_nearest` for groups of any size.

    Rows of one spot are one candidate.  Every round takes the pairs of spots that are nearest
    to each other from both sides, and of these as many rows as both spots have, in id order:
    just what the sequential walk would take next.  Where a spot has several nearest ones, rows
    of these take turns, so only one pair is taken.  A crowd on one spot costs one round.
    """
    a, b = cut(left), cut(right)
    parts = []
    while True:
        sa, sb = _spots(a, keys, left_id, x, y), _spots(b, keys, right_id, x, y)
        ab = nearest(sa, sb, keys, left_id, right_id, radius, x, y, ties=True)
        ba = nearest(sb, sa, keys, right_id, left_id, radius, x, y, ties=True).select(left_id, right_id, F.col("tied").alias("_t"))
        pair = ab.join(ba, [left_id, right_id]).join(sa.select(left_id, F.col("_n").alias("_a")), left_id)
        pair = pair.join(sb.select(right_id, F.col("_n").alias("_b")), right_id)
        take = F.when(F.col("tied") | F.col("_t"), 1).otherwise(F.least("_a", "_b"))
        pair = cut(pair.select(F.col(left_id).alias("_sl"), F.col(right_id).alias("_sr"), "dist", take.alias("_take")))
        if pair.isEmpty():
            break
        lhs, rhs = _ranked(a, keys, left_id, x, y, "_sl"), _ranked(b, keys, right_id, x, y, "_sr")
        lhs = lhs.join(pair, "_sl").filter("_rank <= _take")
        pick = cut(lhs.join(rhs, ["_sr", "_rank"]).select(left_id, right_id, "dist"))
        parts.append(pick)
        a = cut(a.join(pick.select(left_id), left_id, "left_anti"))
        b = cut(b.join(pick.select(right_id), right_id, "left_anti"))
    if not parts:
        return pair.select(F.col("_sl").alias(left_id), F.col("_sr").alias(right_id), "dist")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked(df: DataFrame, keys: list[str], node: str, x: str, y: str, head: str) -> DataFrame:
    """Number of a row on its spot, by id, and the spot's first id.

    Rows are dealt by range, so a spot with a large share of all rows spans many tasks;
    its numbers are joined by the counts before.
    """
    spot = [*keys, x, y]
    d = cut(df.repartitionByRange(*spot, node).withColumn("_k", F.spark_partition_id()))
    counts = d.groupBy(*spot, "_k").agg(F.count(F.lit(1)).alias("_c"), F.min(node).alias("_m"))
    w = Window.partitionBy(*spot)
    offs = counts.select(*spot, "_k", (F.sum("_c").over(w.orderBy("_k")) - F.col("_c")).alias("_o"), F.min("_m").over(w).alias(head))
    local = F.row_number().over(Window.partitionBy(*spot, "_k").orderBy(node))
    return d.withColumn("_l", local).join(offs, [*spot, "_k"]).select(node, head, (F.col("_l") + F.col("_o")).alias("_rank"))
