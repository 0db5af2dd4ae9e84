"""Token counts without ids: pieces per distinct pre-token, joined to document frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import blank_runs, split_at_blanks
from .common import Scratch, coded, documents, slices

LIMIT = 4096
_BLOCK = "block long, docs binary, vocab array<string>"
_BITS = 31  # of a number in a block's vocabulary


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed string."""
    import zstandard

    head = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    # high bytes together, they are mostly zero
    planes = [np.ascontiguousarray(a.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.compress(head + b"".join(planes), 6)


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    out, at = [], 8 * (count + 1)
    for n in np.frombuffer(raw, "<i8", count, 8).tolist():
        planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<i8").ravel())
        at += 8 * n
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block of documents: ids, sizes, distinct pre-tokens (numbers in the block's
    vocabulary) and their frequencies; and the vocabulary."""
    task, k = TaskContext.get().partitionId(), 0
    for b in slices(batches, "text", 48 << 20):
        texts = pc.fill_null(b.column("text"), "")
        rows, parts = split_at_blanks(texts, "  |^ | $", blank_runs)
        vocab, codes, offs = coded(parts)
        n_vocab = max(len(vocab), 1)
        doc = np.repeat(np.arange(len(rows)), np.diff(offs))
        key, times = np.unique(doc * n_vocab + codes, return_counts=True)
        per_doc = np.bincount(key // n_vocab, minlength=len(rows))
        take = pa.array(rows)
        ids, size = b.column("doc_id").take(take), pc.binary_length(texts).take(take)
        docs = _pack(
            pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
            size.to_numpy(), per_doc, np.diff(key, prepend=0), times)
        yield pa.RecordBatch.from_arrays(
            [pa.array([(task << 12) + k]), pa.array([docs], pa.binary()), pa.array([vocab], pa.list_(pa.string()))],
            ["block", "docs", "vocab"])
        k += 1


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pre-token, all rows of one in the same task: each is encoded once."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        last, last_n = None, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            word = b.column("word").dictionary_encode()
            vocab = word.dictionary.to_pylist()
            new = [w for w in vocab if w != last]
            size = dict(zip(new, (len(x) for x in sp.encode(new, num_threads=1))))
            size.setdefault(last, last_n)
            n = np.array([size[w] for w in vocab], np.int64)[word.indices.to_numpy()]
            last, last_n = vocab[word.indices[-1].as_py()], int(n[-1])
            at = b.column("at").to_numpy()
            order = np.argsort(at, kind="stable")
            at, n = at[order], n[order]
            block, first = np.unique(at >> _BITS, return_index=True)
            ends = [*first[1:], len(at)]
            data = [_pack(np.diff(at[i:j] & ((1 << _BITS) - 1), prepend=0), n[i:j]) for i, j in zip(first, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(data, pa.binary())], ["part", "sizes"])

    return count


def _sum(docs: pa.Table, pieces: pa.Table) -> pa.Table:
    ids, valid, n_bytes, per_doc, step, times = _unpack(docs["docs"][0].as_py())
    parts = [_unpack(x) for x in pieces["sizes"].to_pylist()]
    size = np.zeros(sum(len(n) for _, n in parts) + 1, np.int64)
    for step_, n in parts:
        size[np.cumsum(step_)] = n
    n_vocab = max(len(size) - 1, 1)
    total = np.bincount(np.repeat(np.arange(len(ids)), per_doc), weights=size[np.cumsum(step) % n_vocab] * times, minlength=len(ids))
    return pa.table({
        "doc_id": pa.array(ids, mask=valid == 0), "n_bytes": pa.array(n_bytes), "n_tokens": pa.array(total.astype(np.int64))})


def check_vocabulary(path: str) -> None:
    """Pre-tokens are independent only if no piece joins text across a blank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    blank = "▁"
    bad = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if blank in p.lstrip(blank)]
    if bad or sp.encode("a b", out_type=str) != [blank + "a", blank + "b"]:
        raise ValueError(f"pieces join words in {path}: {bad[:3]}")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, by a sentencepiece model.

    Blocks of documents keep their pre-token frequencies against a vocabulary of the block.
    Vocabularies meet by pre-token, where every distinct one of the corpus is encoded once; the
    piece counts go back to their blocks and are joined to the frequencies there.  No ids are made.  Null texts are empty (0 bytes, 0 tokens),
    repeated rows are counted each, a long text is a block of its own, an empty table gives no rows.
    """
    check_vocabulary(path)
    store = Scratch(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    t = store.put(d.mapInArrow(_frequencies, _BLOCK))
    at = F.shiftleft("block", _BITS).bitwiseOR(F.col("pos").cast("long")).alias("at")
    terms = t.select("block", F.posexplode("vocab").alias("pos", "word")).select(at, "word")
    sizes = terms.repartition("word").sortWithinPartitions("word").mapInArrow(_counter(path), "part long, sizes binary")
    return t.select("block", "docs").groupBy("block").cogroup(sizes.groupBy("part")).applyInArrow(
        _sum, "doc_id long, n_bytes long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    t = token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return t.withColumn("over_limit", F.col("n_tokens") > LIMIT)
