"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_sum
from .common import WORD, Scratch, documents, running_total, word_count

SEED = "mix-1"


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeats: int, store: Scratch) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source (``source, source_size``).

    Sources in code point order, null last, take the weights in turn.  They share ``share``
    times all words by weight; a target stops at ``repeats`` times its source, and what is
    over goes to the others by weight until none is above.  With sources in the order of
    capacity by weight, the capped ones come first, so the shared level follows from two sums.
    """
    one = sources.withColumn("_one", F.lit(1)).withColumn("_null", F.col("source").isNull())
    s = running_total(store, one, ["_null", "source"], "_one", "_rank")
    turn = F.array(*[F.lit(w) for w in weights])
    s = s.withColumn("weight", F.element_at(turn, (F.col("_rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("_ratio", F.col("source_size") / F.col("weight"))
    s = running_total(store, s, ["_ratio", "_null", "source"], "source_size", "_sizes")
    s = running_total(store, s, ["_ratio", "_null", "source"], "weight", "_weights")
    s = store.put(s)
    all_ = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(float(share)) * all_[0] - float(repeats) * F.col("_sizes")) / (all_[1] - F.col("_weights"))
    level = s.select(level.alias("l"), "weight", "source_size").filter(
        F.col("l") * F.col("weight") <= float(repeats) * F.col("source_size")).agg(F.max("l")).first()[0]
    cap = F.col("source_size") * float(repeats)
    target = cap if level is None else F.least(cap, F.lit(float(level)) * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2,
) -> DataFrame:
    """Copies of documents that the mix takes, in queue order.

    Every source is a queue of its documents in shuffled (digest) order, repeated up to
    ``repeats`` times.  A copy's virtual finish time is the source's words up to its end,
    divided by the source's target; copies are range-sorted by it over all sources.  The
    total budget is spent when virtual time reaches 1, where every queue has had just its
    target; a copy in progress there is truncated, later ones are not taken.

    Returns ``doc_id, copy, size, source, source_size, target, start, finish, taken, place``, where
    ``place`` is the number of mixed words before the copy.  Null texts and texts without
    words have size 0 and are taken with 0 words; null is a source of its own; repeated rows
    are documents of their own; an empty table gives no rows.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, share, repeats).drop("row")


def _mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2,
) -> DataFrame:
    """The rows of :func:`mix` with ``row``, a key of the document's row."""
    spark = docs.sparkSession
    store = Scratch(spark)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
    ).withColumn("_h", F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"))))
    sized = store.put(sized.withColumn("row", F.monotonically_increasing_id()))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats, store)
    goal = goal.withColumnRenamed("source", "_source")
    q = sized.join(goal, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_q", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    q = running_sum(q, ["_q"], F.substring("_h", 1, 3), ["_h", "doc_id", "size", "row"], "size", "_end")
    q = q.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    q = q.withColumn("start", F.col("copy") * F.col("source_size") + F.col("_end") - F.col("size"))
    q = q.withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).otherwise(0.0))
    left = F.greatest(F.lit(0).cast("long"), F.floor("target") - F.col("start"))
    q = q.withColumn("taken", F.least("size", left))
    q = q.select("row", "doc_id", "copy", "size", "source", "source_size", "target", "start", "finish", "taken")
    return running_total(store, q, ["finish", "source", "start", "doc_id", "copy"], "taken", "place")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: words of each document in the mix."""
    m = _mixed(documents(spark, sf_dir).select("doc_id", "text", "source"))
    # rows of one document that is repeated in the table stay rows of their own
    return m.groupBy("row", "doc_id", "size", "source_size", "target", (F.col("start") - F.col("copy") * F.col("source_size")).alias("queue_start")).agg(
        F.sum("taken").alias("taken")).drop("row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix: a row for every copy taken; a copy in progress at the end of the
    budget keeps its first ``taken`` words, joined by one blank.  Rows that share an id are
    told apart by their place among them."""
    order = ["source", "size"]
    m = mix(docs).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "copy").orderBy(*order, "start")))
    m = m.filter("taken > 0").select("doc_id", "_n", "taken", "size")
    d = docs.withColumn("_size", word_count(F.col("text")))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "_size")))
    j = d.join(m.select(F.col("doc_id").alias("_id"), F.col("_n").alias("_k"), "taken"),
               F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_k")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, F.col("taken").cast("int")), " ")
    j = j.withColumn("text", F.when(F.col("taken") < F.col("_size"), cut).otherwise(F.col("text")))
    return j.select(*docs.columns)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || doc_id) AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM src),
lev AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * (sum(source_size) OVER w - source_size))
            / (sum(weight) OVER () - (sum(weight) OVER w - weight))::DOUBLE AS l
  FROM ranked WINDOW w AS (ORDER BY source_size / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lvl AS (SELECT max(l) AS l FROM lev WHERE l * weight <= 2.0 * source_size),
goal AS (
  SELECT source, source_size, CASE WHEN lvl.l IS NULL THEN 2.0::DOUBLE * source_size
         ELSE least(2.0::DOUBLE * source_size, lvl.l * weight) END AS target
  FROM ranked, lvl),
q AS (
  SELECT doc_id, size, source_size, target,
         (sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS queue_start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, queue_start,
       (least(size, greatest(0, floor(target)::BIGINT - queue_start))
        + least(size, greatest(0, floor(target)::BIGINT - queue_start - source_size)))::BIGINT AS taken
FROM q
"""
