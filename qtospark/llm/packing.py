"""Best-fit packing of token pieces into sequences by matching on the length histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_number
from .chunks import ByteBpe
from .common import Scratch, documents, slices

CAPACITY, END_ID = 1024, 2
_PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _cutter(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for b in slices(batches, "text", 12 << 20):
            rows, ids, ends = bpe.encode(b.column("text"))
            ends = ends + np.arange(1, len(ends) + 1)
            all_ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.dtype("<u4"))
            inside = np.ones(len(all_ids), bool)
            inside[ends - 1] = False
            all_ids[inside] = ids
            n = np.diff(np.concatenate([[0], ends]))
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity  # the first piece may be shorter
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            at = (ends - n)[doc] + start
            data = [all_ids[i:i + k].tobytes() for i, k in zip(at, length)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(rows[doc])), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(data, pa.binary()),
            ], ["doc_id", "piece", "start", "length", "ids"])

    return cut


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids``: ids of each text and an end id, cut into pieces
    of ``capacity``, the first one shorter; ``ids`` are little-endian unsigned 32-bit."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_cutter(path, capacity, end_id), _PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces of each length: ``(length, lo, hi, sequence, per, offset)``.

    Pieces of ``length`` with ranks ``lo..hi`` go ``per`` to a sequence, from ``sequence`` on, the first at
    ``offset``.  Above a third of the capacity at most two fit a sequence: from the longest
    down, each is matched with the longest partner that fits.  Shorter ones, longest first, go
    to the fullest sequences that still take them.  All pieces of a length are placed in bulk,
    so the work depends on the capacity alone.
    """
    left = dict(histogram)
    used: dict[int, int] = {}
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    n_seq = 0

    def place(length: int, count: int, first: int, per: int, offset: int) -> None:
        lo = used.get(length, 0)
        used[length] = lo + count
        left[length] -= count
        out.append((length, lo, lo + count, first, per, offset))

    large = sorted((n for n in histogram if n > capacity // 3), reverse=True)
    for n in large:
        while left[n] > 0:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] > (m == n)), None)
            if mate is None:
                k, gap = left[n], capacity - n
                place(n, k, n_seq, 1, 0)
            else:
                k = left[n] // 2 if mate == n else min(left[n], left[mate])
                gap = capacity - n - mate
                place(n, k, n_seq, 1, 0)
                place(mate, k, n_seq, 1, n)
            gaps.setdefault(gap, []).append((n_seq, k))
            n_seq += k
    for n in sorted((n for n in histogram if 0 < n <= capacity // 3), reverse=True):
        while left[n] > 0:
            gap = next((g for g in range(n, capacity + 1) if gaps.get(g)), None)
            if gap is None:
                k = -(-left[n] // (capacity // n))
                gaps.setdefault(capacity, []).append((n_seq, k))
                n_seq += k
                continue
            first, k = gaps[gap].pop()
            per = gap // n
            if left[n] < per:
                take, each = 1, left[n]
            else:
                take, each = min(k, left[n] // per), per
            place(n, take * each, first, each, capacity - gap)
            gaps.setdefault(gap - n * each, []).append((first, take))
            if take < k:
                gaps[gap].append((first + take, k - take))
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``.

    Only the histogram of lengths, at most ``capacity`` numbers, meets on the driver.  Pieces of one length are
    numbered in two levels, so that the many full pieces are dealt over tasks, and find
    their place by length and number.  Rows with length 0 or null are left out; an empty
    table stays empty.
    """
    spark = pieces.sparkSession
    p = pieces.filter("length > 0")
    hist = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n > capacity for n in hist):
        raise ValueError("a piece is longer than a sequence")
    schema = "_length long, lo long, hi long, sequence long, per long, first long"
    steps = spark.createDataFrame(plan(hist, capacity), schema)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(509))
    r = running_number(p, ["length"], bucket, ["doc_id", "piece"], "_rank").withColumn("_rank", F.col("_rank") - 1)
    at = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    j = r.join(F.broadcast(steps), at)  # a few rows per length
    nth = F.col("_rank") - F.col("lo")
    j = j.withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("per")))
    j = j.withColumn("offset", F.col("first") + (nth % F.col("per")) * F.col("length"))
    return j.drop("_rank", "_length", "lo", "hi", "sequence", "per", "first")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of every packed sequence, in order of offset."""
    j = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")  # at most `capacity` ids
    joined = F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids")
    return j.groupBy("sequence_id").agg(parts).select("sequence_id", joined)


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024: a null text is empty and leaves its end id;
    repeated rows are packed each."""
    return _packed(spark, documents(spark, sf_dir))


def _packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    p = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    p = Scratch(spark).put(p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return place(p).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: pieces of the mixed documents with their places."""
    return _packed(spark, docs)
