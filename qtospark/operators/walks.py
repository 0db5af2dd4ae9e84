"""Sequential walks over drawings - first come, first served - as distributed jobs.

A walk's result depends on the order in which rows are visited.  Pages that fit a task (by a
count of their rows) are walked there in order; larger ones are walked in rounds that decide, all at once, the rows
that no earlier undecided row can influence.  Both give what the plain walk gives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .spatial import box_join

#: Rows of a page that one task walks; larger pages go by rounds.
PAGE_ROWS = 2000
#: Rows of a group whose pairs one task looks at one by one.
PAIR_ROWS = 400


def _split(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of small and of large groups; ``None`` if no group is large."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).drop("_n")
    if big.isEmpty():
        return df, None
    big = cut(big)
    return df.join(big, keys, "left_anti"), df.join(big, keys, "left_semi")


def split_groups(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """:func:`_split` for rows read straight from a table: groups with a null key are small or large like others."""
    big = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*[F.col(k).alias("_k_" + k) for k in keys]))
    if big.isEmpty():
        return df, None
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k_" + k))
    return df.join(big, same, "left_anti"), df.join(big, same, "left_semi")


def components(n: int, linked: Callable[[int, int], bool]) -> list[int]:
    """The first place of each place's component, of ``n`` places in ascending order."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def each_group(df: DataFrame, keys: list[str], order: list[str], walk: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``walk`` over the rows of every group in ``order``, as dictionaries; the groups of a partition share its batches.

    A group must fit a task.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, done = [], None, []

        def written(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)

        for b in batches:
            for r in b.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != last and held:
                    done += walk(held)
                    held = []
                    if len(done) > 20_000:
                        yield written(done)
                        done = []
                last = key
                held.append(r)
        if held:
            done += walk(held)
        yield written(done)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def greedy_matching(pairs: DataFrame, keys: list[str], a: str, b: str, rank: list[str], most: int = PAGE_ROWS) -> DataFrame:
    """Pairs taken in ascending ``(rank.., a, b)``, each node once, in whichever role.

    Groups of at most ``most`` pairs are walked by one task.  In larger ones a round takes every pair
    that is the best of both its nodes, which the walk would take before anything else that touches
    them.  Null nodes are in no pair; ``a = b`` is no pair; repeated pairs are one; no pairs give no rows.
    """
    order = [*rank, a, b]
    p = cut(pairs.filter(F.col(a) != F.col(b)).dropDuplicates([*keys, *order]))
    small, large = _split(p, keys, most)

    def walk(rows: list[dict]) -> list[dict]:
        seen, take = set(), []
        for r in rows:
            if r[a] not in seen and r[b] not in seen:
                seen.update((r[a], r[b]))
                take.append(r)
        return take

    out = each_group(small, keys, order, walk, p.schema.simpleString()[7:-1].replace(":", " "))
    if large is None:
        return out
    parts, pool = [out], cut(large)
    step = F.struct(*order)
    while not pool.isEmpty():
        node = pool.select(*keys, F.explode(F.array(a, b)).alias("_v"), step.alias("_s"))
        best = node.groupBy(*keys, "_v").agg(F.min("_s").alias("_best"))
        for side, name in ((a, "_ba"), (b, "_bb")):
            pool = pool.join(best.select(*keys, F.col("_v").alias(side), F.col("_best").alias(name)), [*keys, side])
        taken = cut(pool.filter((F.col("_ba") == step) & (F.col("_bb") == step)).select(*p.columns))
        parts.append(taken)
        gone = taken.select(*keys, F.explode(F.array(a, b)).alias("_v"))
        pool = pool.drop("_ba", "_bb")
        for side in (a, b):
            pool = pool.join(gone.select(*keys, F.col("_v").alias(side)), [*keys, side], "left_anti")
        pool = cut(pool.select(*p.columns))
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


#: A walk's step: the row whose turn it is and the undecided ones near it, in order, as dictionaries; gives the places
#: of those that it takes with it, and the columns that it writes.
Step = Callable[[dict, list[dict]], tuple[list[int], dict]]


def ordered_walk(rows: DataFrame, keys: list[str], node: str, order: list[str], radius: float, act: Step, writes: str = "",
                 x: str = "cx", y: str = "cy", most: int = PAGE_ROWS) -> DataFrame:
    """``keys, node, head`` of every row, and the columns ``writes`` of heads.

    Rows of a group are visited in ascending ``(order.., node)``.  An undecided one becomes a head; ``act`` sees it
    and the undecided rows within ``radius`` and says which of them it takes.  Pages of more than ``most`` rows go by
    rounds: a row may act when no earlier undecided row is within twice the radius, since only such a row could
    take a row that this one sees.  What a round gathers for a head is what lies within its radius, so equal
    rows should be made one before.  Rows without a place are heads that see nothing.
    """
    d = cut(rows)
    names = [f.split()[0] for f in writes.split(",") if f.strip()]
    schema = ", ".join([*(f"{k} {d.schema[k].dataType.simpleString()}" for k in [*keys, node]), f"head {d.schema[node].dataType.simpleString()}", *([writes] if names else [])])
    by, cols = [*order, node], d.columns
    reach = radius * radius

    def row(me: dict, head, new: dict | None = None) -> dict:
        return {**{k: me[k] for k in [*keys, node]}, "head": head, **{n: (new or {}).get(n) for n in names}}

    def page(recs: list[dict]) -> list[dict]:
        px, py = ([math.nan if r[c] is None else r[c] for r in recs] for c in (x, y))
        free, out = [True] * len(recs), []
        for i, me in enumerate(recs):
            if not free[i]:
                continue
            near = [k for k in range(i + 1, len(recs)) if free[k] and (px[k] - px[i]) ** 2 + (py[k] - py[i]) ** 2 <= reach]
            taken, new = act(me, [recs[k] for k in near])
            out.append(row(me, me[node], new))
            for k in taken:
                free[near[k]] = False
                out.append(row(recs[near[k]], me[node]))
        return out

    small, large = _split(d, keys, most)
    out = each_group(small, keys, by, page, schema)
    if large is None:
        return out
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()

    def near(rows: list[dict]) -> list[dict]:
        me = {c: rows[0][c] for c in cols}
        others = [{c: r["r_" + c] for c in cols} for r in rows if r["r_" + node] != me[node]]
        taken, new = act(me, others)
        return [row(me, me[node], new), *(row(others[k], me[node]) for k in taken)]

    parts, todo = [out], cut(large)
    earlier = F.struct(*("r_" + c for c in by)) < F.struct(*by)
    while not todo.isEmpty():
        here = todo.filter(placed)
        turn = cut(box_join(here, here, keys, 2.0 * radius, x=x, y=y, how="left_anti", condition=earlier).unionByName(todo.filter(~placed)))
        ex, ey = F.col(x) - F.col("r_" + x), F.col(y) - F.col("r_" + y)
        seen = box_join(turn.filter(placed), here, keys, radius, x=x, y=y, condition=ex * ex + ey * ey <= reach)
        alone = turn.filter(~placed)
        alone = alone.select("*", *(F.col(c).alias("r_" + c) for c in d.columns))
        done = cut(each_group(seen.unionByName(alone), [*keys, node], [f"r_{c}" for c in by], near, schema))
        parts.append(done)
        todo = cut(todo.join(done.select(*keys, node), [*keys, node], "left_anti").select(*d.columns))
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
