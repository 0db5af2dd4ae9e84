"""Many readings of one quantity to one value with an honest confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import mode_first, mode_smallest, order_stats


def confidence_from_agreement(agreement: Column, n: Column, anchored: Column | None = None) -> Column:
    """0.4 + 0.5·agreement + min(0.06, 0.02·(n−1)), clamped to [0.3, 0.97]; a text anchor gives 0.97."""
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), agreement))
    bonus = F.least(F.lit(0.06), F.lit(0.02) * F.greatest(F.lit(0), n - 1))
    c = F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.97), 0.4 + 0.5 * a + bonus)), 2)
    return c if anchored is None else F.when(anchored, F.lit(0.97)).otherwise(c)


def strict_majority(votes: Column, n: Column) -> Column:
    return (n > 0) & (votes >= F.floor(n / 2) + 1)


def reconcile_counts(readings: DataFrame, key: str, value: str, anchors: DataFrame | None = None) -> DataFrame:
    """Count readings to ``wert, status, agreement, konfidenz, n, alternativen, quelle``.

    ``anchors(key, text_wert)`` beat every reading.  Works on value counts, so a key with
    very many readings costs one row per distinct count.
    """
    c = (
        readings.filter(F.col(value).isNotNull())
        .groupBy(key, F.rint(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    agg = c.groupBy(key).agg(
        F.sum("_c").alias("n"), F.max("_c").alias("_top"), F.count(F.lit(1)).alias("_dist"),
        F.min_by("_v", F.struct(-F.col("_c"), F.col("_v"))).alias("_mode"),
        F.array_sort(F.collect_set("_v")).alias("_all"),
    )
    if anchors is not None:
        agg = agg.join(anchors, key, "full")
        sup = c.join(anchors, key).filter(F.col("_v") == F.rint("text_wert").cast("bigint")).select(key, F.col("_c").alias("_sup"))
        agg = agg.join(sup, key, "left")
    else:
        agg = agg.withColumn("text_wert", F.lit(None).cast("double")).withColumn("_sup", F.lit(None).cast("bigint"))
    n = F.coalesce("n", F.lit(0))
    anchored = F.col("text_wert").isNotNull()
    value_out = F.when(anchored, F.rint("text_wert").cast("bigint")).otherwise(F.col("_mode"))
    agr = F.when(anchored, F.when(n > 0, F.coalesce("_sup", F.lit(0)) / n).otherwise(F.lit(1.0))).otherwise(F.col("_top") / n)
    base = F.when(anchored, F.lit(1.0)).otherwise(F.col("_top") / n)
    return agg.select(
        key, value_out.alias("wert"), n.alias("n"),
        F.when(anchored, F.lit("text-anker")).otherwise(F.lit("ensemble")).alias("quelle"),
        F.when(anchored | (F.col("_dist") == 1), F.lit("bestaetigt"))
        .when(strict_majority(F.col("_top"), n), F.lit("mehrheit")).otherwise(F.lit("unklar")).alias("status"),
        agr.alias("agreement"),
        confidence_from_agreement(base, F.greatest(n, F.lit(1)), anchored).alias("konfidenz"),
        F.array_except(F.coalesce("_all", F.array().cast("array<bigint>")), F.array(value_out)).alias("alternativen"),
    )


def snapped_median(readings: DataFrame, key: str, value: str, bucket: float) -> DataFrame:
    med = order_stats(readings, [key], value, {"_m": "median"})
    return med.select(key, F.round(F.rint(F.col("_m") / bucket) * bucket, 4).alias("wert"))


def reconcile_measures(readings: DataFrame, key: str, value: str, bucket: float = 0.05) -> DataFrame:
    """Median snapped to ``bucket``; agreement is the share of readings within half a bucket."""
    med = snapped_median(readings, key, value, bucket)
    c = readings.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    j = c.join(med, key)
    near = F.abs(F.col(value) - F.col("wert")) <= bucket / 2.0 + 1e-9
    g = j.groupBy(key, "wert").agg(F.sum("_c").alias("n"), F.sum(F.when(near, F.col("_c")).otherwise(0)).alias("_in"))
    agr = F.col("_in") / F.col("n")
    return g.select(
        key, "wert", "n", agr.alias("agreement"),
        F.when(agr >= 0.99, F.lit("bestaetigt")).when(agr >= 0.5, F.lit("mehrheit")).otherwise(F.lit("unklar")).alias("status"),
        confidence_from_agreement(agr, F.col("n")).alias("konfidenz"))


def reconcile_judgements(runs: DataFrame, key: str) -> DataFrame:
    """Representative run per key (closest to the upper-median confidence) with robust fields.

    ``runs`` has ``konfidenz, ord, reading_id, lesung, kategorie, wert``.
    """
    med = order_stats(runs, [key], "konfidenz", {"_mk": "upper"})
    rep = (
        runs.join(med, key).groupBy(key)
        .agg(F.min_by("reading_id", F.struct(F.abs(F.col("konfidenz") - F.col("_mk")), F.col("ord"), F.col("reading_id"))).alias("basis"),
             F.count(F.lit(1)).alias("n"))
    )
    count = runs.filter("lesung is not null").withColumn("_l", F.rint("lesung").cast("bigint"))
    return (
        rep.join(mode_smallest(count, [key], "_l", "saeulen_anzahl"), key, "left")
        .join(mode_first(runs, [key], "kategorie", "ord", "dach_typ"), key, "left")
        .join(snapped_median(runs, key, "wert", 0.05).withColumnRenamed("wert", "rohbau_m"), key, "left")
    )


def double_check_numeric(readings: DataFrame, key: str, value: str, typ: str, tol: float) -> DataFrame:
    """Cross-source check: agree within ``tol`` of the upper median, confirmed by two kinds of source."""
    r = readings.filter(F.col(value) > 0).select(key, F.round(value, 2).alias("_v"), F.col(typ).alias("_t"))
    med = order_stats(r, [key], "_v", {"_med": "upper", "_n": "n"})
    txt = order_stats(r.filter("_t = 'text'"), [key], "_v", {"_tmed": "upper", "_tn": "n"})
    span = r.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count_distinct("_t").alias("typen_n"))
    d = med.filter("_n >= 2").join(span, key).join(txt, key, "left")
    agree = (F.abs(F.col("_lo") - F.col("_med")) <= tol) & (F.abs(F.col("_hi") - F.col("_med")) <= tol)
    by_text = ~agree & F.col("_tn").isNotNull() & (F.col("_tn") < F.col("_n"))
    return d.select(
        key, F.when(by_text, F.col("_tmed")).otherwise(F.col("_med")).alias("wert"), F.col("_n").alias("n"), "typen_n",
        F.when(~agree, F.lit("widerspruch")).when(F.col("typen_n") >= 2, F.lit("bestätigt")).otherwise(F.lit("verstaerkt")).alias("status"),
        F.coalesce(by_text, F.lit(False)).alias("text_bevorzugt"))


def double_check_category(readings: DataFrame, key: str, value: str, typ: str, order: str) -> DataFrame:
    r = readings.filter(F.col(value).isNotNull() & (F.col(value) != "")).withColumn("_v", F.lower(value))
    g = r.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(typ).alias("typen_n"),
        F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.min_by("_v", order).alias("wert"))
    return g.filter("n >= 2").select(
        key, "wert", "n", "typen_n",
        F.when(F.col("_a") != F.col("_b"), F.lit("widerspruch")).when(F.col("typen_n") >= 2, F.lit("bestätigt"))
        .otherwise(F.lit("verstaerkt")).alias("status"))


def multiset_consensus(rows: DataFrame, scope: str, run: str, bucket: list[str], id_col: str, runs: DataFrame) -> DataFrame:
    """Rows confirmed over repeat runs.

    Per bucket the final count is the upper median of the per-run counts (absent = 0),
    taken from the first run with at least that many rows, in id order.
    """
    keys = [scope, *bucket]
    per_run = rows.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("_c"))
    total = runs.groupBy(scope).agg(F.count_distinct(run).alias("_runs"))
    # zeros are counted, not materialised: (runs - present) zeros precede the sorted counts
    hist = per_run.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_k"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    hist = hist.join(total, scope)
    hist = hist.withColumn("_present", F.sum("_k").over(w)).withColumn("_hi", F.sum("_k").over(w.orderBy("_c")))
    zeros = F.col("_runs") - F.col("_present")
    idx = F.floor(F.col("_runs") / 2)
    hit = (zeros + F.col("_hi") - F.col("_k") <= idx) & (idx < zeros + F.col("_hi"))
    final = hist.groupBy(*keys).agg(F.max(F.when(hit, F.col("_c"))).alias("_n")).filter("_n > 0")
    src = per_run.join(final, keys).filter("_c >= _n").groupBy(*keys, "_n").agg(F.min(run).alias(run))
    from ..operators.ordering import ordinal

    picked = rows.join(src, [*keys, run])
    return ordinal(picked, [*keys, run], id_col, "_o").filter("_o < _n").drop("_o", "_n")
