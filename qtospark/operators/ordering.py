"""Order statistics and numbering that do not put a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _places(what: str, t: Column) -> list[Column]:
    """Places, from 0, of the values whose mean is asked for, in a group of ``t`` values."""
    return {
        "upper": [F.floor(t / 2)], "lower": [F.floor((t - 1) / 2)], "q1": [F.floor(t / 4)], "q3": [F.floor(t * 3 / 4)],
        "median": [F.floor((t - 1) / 2), F.floor(t / 2)],
    }.get(what) or [F.floor(F.lit(float(what[1:]) / 100.0) * (t - 1))]


def wide_order_stats(df: DataFrame, keys: list[str], value: str, picks: dict[str, str], ranges: int = 256) -> DataFrame:
    """:func:`order_stats` for groups with very many distinct values, in two steps.

    Distinct values are counted, and a sketch gives each group bounds that cut them into about
    ``ranges`` equal parts.  Counts by part say in which part each wanted place is; only values of these parts are
    sorted.  So a task holds one part, also where one group has all rows (or ``keys`` is empty).  The sketch
    decides how even the parts are, not the result.  Groups without a value are left out.
    """
    k = keys or ["_all"]
    d = df.filter(F.col(value).isNotNull())
    d = d if keys else d.withColumn("_all", F.lit(0))
    counts = cut(d.groupBy(*k, value).agg(F.count(F.lit(1)).alias("_n")))
    at = [i / ranges for i in range(1, ranges)]
    bounds = cut(counts.groupBy(*k).agg(F.percentile_approx(value, at, 10 * ranges).alias("_b"), F.sum("_n").alias("_t")))
    part = F.size(F.filter("_b", lambda b: b < F.col(value)))
    c = cut(counts.join(bounds.select(*k, "_b"), k).withColumn("_part", part).drop("_b"))
    per = c.groupBy(*k, "_part").agg(F.sum("_n").alias("_c"))
    per = per.withColumn("_to", F.sum("_c").over(Window.partitionBy(*k).orderBy("_part")))
    t = F.col("_t")
    asked = [F.struct(F.lit(f"{out}:{i}").alias("_pick"), p.cast("long").alias("_place"))
             for out, what in picks.items() if what != "n" for i, p in enumerate(_places(what, t))]
    want = bounds.select(*k, F.inline(F.array(*asked))).join(per, k).filter((F.col("_to") - F.col("_c") <= F.col("_place")) & (F.col("_place") < F.col("_to")))
    want = want.select(*k, "_part", "_pick", (F.col("_place") - (F.col("_to") - F.col("_c"))).alias("_place"))
    hit = c.join(want, [*k, "_part"])
    upto = F.sum("_n").over(Window.partitionBy(*k, "_part", "_pick").orderBy(value))
    hit = hit.withColumn("_to", upto).filter((F.col("_to") - F.col("_n") <= F.col("_place")) & (F.col("_place") < F.col("_to")))

    def got(out: str, i: int) -> Column:
        return F.max(F.when(F.col("_pick") == f"{out}:{i}", F.col(value)))

    aggs = [((got(o, 0) + got(o, 1)) / 2.0 if w == "median" else got(o, 0)).alias(o) for o, w in picks.items() if w != "n"]
    total = bounds.select(*k, *(t.alias(o) for o, w in picks.items() if w == "n"))
    res = hit.groupBy(*k).agg(*aggs).join(total, k)
    return res.select(*keys, *picks)


def order_stats(df: DataFrame, keys: list[str], value: str, picks: dict[str, str]) -> DataFrame:
    """Exact order statistics per group from value counts.

    ``picks`` maps output name to ``median`` (mean of the two middles), ``upper``
    (s[n//2]), ``pNN`` (s[int(NN%·(n−1))]), ``lower`` (s[(n-1)//2]), ``q1`` (s[n//4]), ``q3`` (s[3n//4]) or ``n``.

    Values are counted first (map-side combine), so what reaches the window is one row
    per distinct value of a group - readings are rounded to the centimetre, so that is
    small however many rows a group has.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    counts = counts.withColumn("_hi", F.sum("_n").over(w.orderBy(value))).withColumn("_t", F.sum("_n").over(w))

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("_hi") - F.col("_n") <= i) & (i < F.col("_hi")), F.col(value)))

    t = F.col("_t")
    aggs = []
    for out, what in picks.items():
        if what == "n":
            aggs.append(F.max(t).alias(out))
            continue
        found = [at(i) for i in _places(what, t)]
        aggs.append(((found[0] + found[1]) / 2.0 if what == "median" else found[0]).alias(out))
    return counts.groupBy(*keys).agg(*aggs)


def mode_first(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Most frequent value; ties go to the one seen first by ``order``."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    return c.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_o"), F.col(value))).alias(out))


def mode_smallest(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent value; ties go to the smaller one."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def ordinal(df: DataFrame, keys: list[str], id_col: str, out: str = "ord", size: str | None = None) -> DataFrame:
    """0-based ordinal per group in the order of ``md5(id), id``, and the group size.

    Two levels: rows are numbered inside 256 digest buckets of their group, bucket counts
    are summed up, and the offset is added.  A group with a third of all rows is spread
    over 256 tasks.
    """
    d = df.withColumn("_h", F.md5(F.col(id_col).cast("string")))
    d = d.withColumn("_bk", F.substring("_h", 1, 2))
    kb = [*keys, "_bk"]
    local = F.row_number().over(Window.partitionBy(*kb).orderBy("_h", id_col)) - 1
    counts = d.groupBy(*kb).agg(F.count(F.lit(1)).alias("_c"))
    wk = Window.partitionBy(*keys)
    offs = counts.withColumn("_off", F.sum("_c").over(wk.orderBy("_bk")) - F.col("_c"))
    offs = offs.withColumn("_size", F.sum("_c").over(wk)).drop("_c")
    res = d.withColumn("_l", local).join(offs, kb).withColumn(out, F.col("_l") + F.col("_off"))
    if size:
        res = res.withColumn(size, F.col("_size"))
    return res.drop("_h", "_bk", "_l", "_off", "_size")


def running_number(df: DataFrame, keys: list[str], bucket: Column, order: list, out: str = "nummer") -> DataFrame:
    """1-based number per group in ``order``; ``bucket`` must be a coarse prefix of that order.

    Same two levels as :func:`ordinal`, for orders that matter (for example by day).
    """
    d = df.withColumn("_bk", bucket)
    kb = [*keys, "_bk"]
    counts = d.groupBy(*kb).agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.withColumn("_off", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bk")) - F.col("_c"))
    local = F.row_number().over(Window.partitionBy(*kb).orderBy(*order))
    return (
        d.withColumn("_l", local).join(offs.drop("_c"), kb)
        .withColumn(out, F.col("_l") + F.col("_off")).drop("_bk", "_l", "_off")
    )


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list, value: str, out: str) -> DataFrame:
    """Cumulative sum per group in ``order``, two-level like :func:`running_number`."""
    d = df.withColumn("_bk", bucket)
    kb = [*keys, "_bk"]
    sums = d.groupBy(*kb).agg(F.sum(value).alias("_s"))
    offs = sums.withColumn("_off", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_bk")) - F.col("_s"))
    w = Window.partitionBy(*kb).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.withColumn("_l", F.sum(value).over(w)).join(offs.drop("_s"), kb)
        .withColumn(out, F.col("_l") + F.col("_off")).drop("_bk", "_l", "_off")
    )
