"""Token ids as canonical, length-limited Huffman code in independent blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ByteBpe
from .common import Scratch, documents, slices

END_ID = 0
MAX_BITS = 16  # windows of three bytes hold a code at any bit; at most 17
BLOCK_IDS = 1 << 19  # ids after which a block ends with its document
STRIDE = 1024  # ids from one checkpoint to the next


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that do not occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(ids) == 0:
        return out
    if len(ids) == 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << most:
        raise ValueError("too many ids for the code length")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    w = counts[ids].astype(np.float64)
    levels: list[np.ndarray] = []  # per level: which entries are single ids
    weight, single = w, np.ones(len(w), bool)
    for _ in range(most - 1):
        levels.append(single)
        n = len(weight) // 2
        pack = weight[0:2 * n:2] + weight[1:2 * n:2]
        both = np.concatenate([w, pack])
        order = np.argsort(both, kind="stable")
        weight, single = both[order], order < len(w)
    levels.append(single)
    take, length = 2 * len(w) - 2, np.zeros(len(w), np.int64)
    for single in reversed(levels):  # the first entries of a level are its lightest
        n = int(single[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[ids] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    n = lengths[order]
    for size in np.unique(n):
        code <<= int(size) - last
        group = order[n == size]
        codes[group] = code + np.arange(len(group))
        code += len(group)
        last = int(size)
    return codes


def pack_bits(ids: np.ndarray, ends: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    """``(payload, bit at which each id starts, byte at which each document starts)``; documents
    start at whole bytes."""
    n = lengths[ids]
    bits = np.cumsum(n)
    doc_end = np.where(ends > 0, bits[ends - 1] if len(bits) else 0, 0)
    doc_bits = np.diff(np.concatenate([[0], doc_end]))
    size = -(-doc_bits // 8)
    first = np.cumsum(size) - size
    shift = first * 8 - (doc_end - doc_bits)
    start = bits - n + np.repeat(shift, np.diff(np.concatenate([[0], ends])))
    byte, word = start >> 3, codes[ids] << (24 - n - (start & 7))
    total = int(size.sum()) + 2
    out = np.zeros(total, np.float64)
    for k in range(3):  # bits of neighbours never meet, so sums are unions
        out += np.bincount(byte + k, weights=((word >> (16 - 8 * k)) & 255), minlength=total)
    return out.astype(np.uint8)[:-2], start, first, size


def unpack_bits(payload: np.ndarray, start: np.ndarray, count: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Ids of segments that begin at bit ``start`` and hold ``count`` ids.

    All segments are decoded side by side, one id of each per step, by a table over the next
    ``width`` bits (id << 5 | length).
    """
    b = np.concatenate([payload, np.zeros(3, np.uint8)]).astype(np.uint32)
    window = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    order = np.argsort(-count, kind="stable")
    at, left = start[order].copy(), count[order]
    base = (np.cumsum(count) - count)[order]
    out = np.zeros(int(count.sum()), np.uint32)
    mask = (1 << width) - 1
    live = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for step, n in enumerate(live):
        p = at[:n]
        hit = table[(window[p >> 3] >> (24 - width - (p & 7)).astype(np.uint32)) & mask]
        out[base[:n] + step] = hit >> 5
        at[:n] = p + (hit & 31)
    return out


def decode_table(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    width = int(lengths.max(initial=1))
    table = np.zeros(1 << width, np.uint32)
    for i in np.flatnonzero(lengths):
        lo = int(codes[i]) << (width - int(lengths[i]))
        table[lo:lo + (1 << (width - int(lengths[i])))] = (int(i) << 5) | int(lengths[i])
    return table, width


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for b in slices(batches, "text", 12 << 20):
            rows, ids, ends = bpe.encode(b.column("text"))
            ends = ends + np.arange(1, len(ends) + 1)
            full = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.dtype("<u4"))
            inside = np.ones(len(full), bool)
            inside[ends - 1] = False
            full[inside] = ids
            full = full.astype("<u2") if bpe.tok.get_vocab_size() <= 1 << 16 else full
            lo = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(rows)), pa.array(np.diff(np.concatenate([[0], ends])), pa.int64()),
                pa.array([full[i:j].tobytes() for i, j in zip(lo, ends)], pa.binary()),
            ], ["doc_id", "n", "ids"])

    return run


def _count(n_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            total += np.bincount(_ids(b, n_ids), minlength=n_ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def _ids(b: pa.RecordBatch, n_ids: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2" if n_ids <= 1 << 16 else "<u4").astype(np.int64)


def _code(codes: np.ndarray, lengths: np.ndarray, stride: int):
    n_ids = len(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                n = b.column("n").to_numpy()
                ends = np.cumsum(n)
                payload, start, first, size = pack_bits(_ids(b, n_ids), ends, codes, lengths)
                data = [payload[i:i + k].tobytes() for i, k in zip(first, size)]
                marks = [
                    (start[e - k:e:stride] - f * 8).astype("<i8").tobytes() for e, k, f in zip(ends, n, first)
                ]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("n"), pa.array(data, pa.binary()), pa.array(marks, pa.binary())],
                    ["doc_id", "n", "bits", "marks"])

    return run


_FILE = (
    "part int, block int, first long, n_ids long, doc_ids array<long>, doc_sizes array<long>, "
    "payload binary, checkpoints binary"
)


def _blocks(most: int):
    """Sorted documents of a partition as blocks; offsets count from the partition's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            at, marks = 0, []
            for _, _, bits, m in held:
                marks.append(np.frombuffer(m, "<i8") + at * 8)
                at += len(bits)
            n = sum(h[1] for h in held)
            one = lambda v, t: pa.array([v], t)
            return pa.RecordBatch.from_arrays([
                one(part, pa.int32()), one(block, pa.int32()), one(first, pa.int64()), one(n, pa.int64()),
                one([h[0] for h in held], pa.list_(pa.int64())), one([h[1] for h in held], pa.list_(pa.int64())),
                one(b"".join(h[2] for h in held), pa.binary()), one(np.concatenate(marks).astype("<i8").tobytes(), pa.binary()),
            ], ["part", "block", "first", "n_ids", "doc_ids", "doc_sizes", "payload", "checkpoints"])

        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "bits", "marks"))):
                held.append(row)
                size += row[1]
                if size >= most:
                    yield flush()
                    first, block, size, held = first + size, block + 1, 0, []
        if held:
            yield flush()

    return run


def write_ids(
    docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes the ids of all texts, in ascending id order, under ``path``.

    Files: ``code`` (id, length in bits; canonical codes follow from it) and ``blocks``, in
    range partitions by document.  A block is decoded by itself: its payload, the ids and
    sizes of its documents, and the bit offset of every document and every 1024th id in it.
    Null texts are empty and keep their end id; repeated rows are written each; a null
    document id comes first; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    store = Scratch(spark)
    n_ids = ByteBpe(vocabulary).tok.get_vocab_size()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = store.put(d.mapInArrow(_encode(vocabulary, end_id), "doc_id long, n long, ids binary"))
    counts = np.zeros(n_ids, np.int64)
    seen = raw.select("ids").mapInArrow(_count(n_ids), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in seen.collect():  # one number per vocabulary entry at most
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max(MAX_BITS, int(n_ids - 1).bit_length()))
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    coded = store.put(raw.mapInArrow(_code(codes, lengths, STRIDE), "doc_id long, n long, bits binary, marks binary"))
    store.drop(raw)
    ordered = coded.repartitionByRange("doc_id", "n").sortWithinPartitions("doc_id", "n", "bits")
    ordered.mapInArrow(_blocks(BLOCK_IDS), _FILE).write.option("compression", "none").parquet(f"{path}/blocks")
    store.drop(coded)


def _decode(table: np.ndarray, width: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("first", "doc_ids", "doc_sizes", "payload", "checkpoints", "base")}
                n = np.array(r["doc_sizes"], np.int64)
                marks = -(-n // stride)
                doc = np.repeat(np.arange(len(n)), marks)
                nth = np.arange(marks.sum()) - np.repeat(np.cumsum(marks) - marks, marks)
                count = np.minimum(stride, n[doc] - nth * stride)
                ids = unpack_bits(np.frombuffer(r["payload"], np.uint8), np.frombuffer(r["checkpoints"], "<i8"), count, table, width).astype("<u4")
                end = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(r["base"] + r["first"] + end - n, pa.int64()), pa.array(n, pa.int64()),
                    pa.array([ids[e - k:e].tobytes() for e, k in zip(end, n)], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files of :func:`write_ids`; ``ids`` are
    little-endian unsigned 32-bit, ``start`` counts the ids of all documents before."""
    rows = spark.read.schema("id long, bits int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    table, width = decode_table(canonical(lengths), lengths)
    blocks = spark.read.schema(_FILE).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("base"))
    cols = ["first", "doc_ids", "doc_sizes", "payload", "checkpoints", "base"]
    return blocks.join(F.broadcast(parts), "part").select(*cols).mapInArrow(  # a row per partition
        _decode(table, width, STRIDE), "doc_id long, start long, n_tokens long, ids binary")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark).base}/ids"
    write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
