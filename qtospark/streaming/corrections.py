"""Live correction feed: rule detector and volume windows.

Batches write changed keys as ``batch=<id>`` folders (overwritten on replay), readers take
the latest version of a key.  Nothing is collected, and a restarted query resumes from its
checkpoint with the same result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

KEY = ["firma_id", "buero", "feld"]


def rule_counts(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("zuletzt"))


def _upsert_log(out: str, keep: str | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.filter(keep) if keep else batch
        b.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    d = spark.read.parquet(out)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def start_rule_detector(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Emits a key when it passes two corrections and again on every later confirmation."""
    w = rule_counts(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(_upsert_log(out, "n > 2"))
    return (w.trigger(availableNow=True) if available_now else w).start()


def volume(corrections: DataFrame, size: str = "6 hours", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Corrections per tumbling or sliding window and field; late ones within ``late`` count."""
    ts = F.col("ts").cast("timestamp")
    d = corrections.withColumn("ts", ts)
    if d.isStreaming:
        d = d.withWatermark("ts", late)
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return d.groupBy(win.alias("w"), "feld").agg(F.count(F.lit(1)).alias("n"), F.sum("wert").alias("summe")).select(
        F.col("w.start").alias("von"), "feld", "n", "summe")


def start_volume(stream: DataFrame, out: str, checkpoint: str, size: str = "6 hours"):
    return (
        volume(stream, size).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(_upsert_log(out, None)).trigger(availableNow=True).start())


def sessions(corrections: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Editing sessions of a user; works on static and streaming input (append mode)."""
    d = corrections.withColumn("ts", F.col("ts").cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark("ts", "1 day")
    return d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("w.start").alias("von"), "n")


def folders(spark: SparkSession) -> tuple[str, str]:
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return base + "/out", base + "/ckpt"
