"""Shared helpers: written intermediate tables, global order, and words of a batch."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Fixed value of the contracts: a word is a run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: While a table is written: shuffle files go when it is there, not when the driver happens to
#: collect its garbage, and a Python worker gets texts of a few MB at once.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


class Scratch:
    """Intermediate tables in the shared checkpoint folder.

    A written table cuts the lineage and survives lost executors.  ``drop`` deletes tables
    that later steps no longer read; what the returned frame still reads has to stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WRITING}
        try:
            for k, v in WRITING.items():
                conf.set(k, v)
            df.write.option("compression", codec).parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._written)
            p.getFileSystem(conf).delete(p, True)


def running_total(store: Scratch, df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in the global ``order``.

    Range partitions are written with their number, so that the sampled bounds stay as they
    are; only one sum per partition meets in one place.  ``order`` should name unique rows.
    """
    d = store.put(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sums = d.groupBy("_pid").agg(F.sum(value).alias("_s"))
    offs = sums.select("_pid", (F.sum("_s").over(Window.orderBy("_pid")) - F.col("_s")).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.withColumn("_in", F.sum(value).over(w) - F.col(value)).join(F.broadcast(offs), "_pid")  # a row a partition
        .withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off", "_pid")
    )


def components(store: Scratch, links: DataFrame, x: str, y: str) -> DataFrame:
    """``(node, component)`` of every linked node; the component is its least node.

    Every round each node, and the node it is labelled with, takes the least label around it and
    then that label's own label, so the rounds grow with the logarithm of the longest chain.  A round is one
    written table.
    """
    e = links.select(F.col(x).alias("node"), F.col(y).alias("mate"))
    e = store.put(e.unionByName(e.select(F.col("mate").alias("node"), F.col("node").alias("mate"))).filter("node <> mate").distinct())
    lab = store.put(e.groupBy("node").agg(F.least("node", F.min("mate")).alias("component")))
    while True:
        around = e.join(lab.select(F.col("node").alias("mate"), F.col("component").alias("_c")), "mate").groupBy("node").agg(F.min("_c").alias("_c"))
        # what a node sees also holds for the node it is labelled with
        hook = around.join(lab, "node").select(F.col("component").alias("node"), "_c")
        around = around.unionByName(hook).groupBy("node").agg(F.min("_c").alias("_c"))
        step = lab.join(around, "node").select("node", F.col("component").alias("_old"), F.least("component", "_c").alias("_c"))
        up = lab.select(F.col("node").alias("_c"), F.col("component").alias("_up"))
        new = step.join(up, "_c").select("node", F.least("_c", "_up").alias("component"), (F.least("_c", "_up") < F.col("_old")).alias("_moved"))
        new = store.put(new)
        done = new.filter("_moved").isEmpty()
        store.drop(lab)
        lab = new
        if done:
            store.drop(e)
            return lab.select("node", "component")


def kept_between_tasks(name: str) -> dict:
    """A dictionary of this Python worker that later tasks find again."""
    home = sys.modules.setdefault("_worker_memory", types.ModuleType("_worker_memory"))
    return home.__dict__.setdefault(name, {})


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(n) - n) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if hi > lo:
                yield b.slice(int(lo), int(hi - lo))


def coded(parts: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(distinct strings, code of each string, bounds of each row)`` of a list array."""
    flat = parts.flatten().dictionary_encode()
    offs = parts.offsets.to_numpy().astype(np.int64)
    return flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64), offs - offs[0]


def words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of each text (null: none) as codes into the batch's distinct words."""
    vocab, codes, offs = coded(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    if "" in vocab:  # blanks at the ends of a text
        full = codes != vocab.index("")
        before = np.concatenate([[0], np.cumsum(full)])
        codes, offs = codes[full], before[offs]
    return vocab, codes, offs


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
