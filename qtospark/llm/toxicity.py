"""Toxicity scores by a counterfactually regularised logistic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, slices, words

#: Terms that name groups of people without judging them, by kind.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "chrétiens", "musulmans", "juifs",
     "christen", "muslime", "juden", "cristianos", "musulmanes", "judíos"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indigenous"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["disabled", "blind", "deaf", "elderly", "young"],
]

MAX_TRAIN = 12_000  # labelled documents the model is fitted on, at most
MAX_FEATURES = 4_096
THRESHOLD = 0.7
_PREFIXES = (3, 4, 5, 6)
_TRIM = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def word_features(word: str) -> list[str]:
    """The lower-case word without marks at its ends, and its beginnings, which inflected forms share."""
    w = _TRIM.sub("", word).lower()
    return [w, *[w[:k] + "-" for k in _PREFIXES if len(w) > k]] if w else []


@dataclass(frozen=True)
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled document, as one string per row."""
    for b in slices(batches, "text"):
        vocab, codes, offs = words(b.column("text"))
        feats = [word_features(w) for w in vocab]
        rows = []
        for lo, hi in zip(offs, offs[1:]):
            rows.append(sorted({f for c in np.unique(codes[lo:hi]) for f in feats[c]}))
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.string()))], ["toxic", "f"])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _terms() -> list[str]:
    return [t for group in IDENTITY_TERMS for t in group]


def select(feats: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """At most ``MAX_FEATURES`` features by likelihood ratio for toxicity, counted where the texts are;
    identity terms always take part.  Only the chosen ones reach the driver."""
    counts = feats.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n"))
    rate_p, rate_q = F.col("p") / F.lit(float(n_pos)), (F.col("n") - F.col("p") + 0.5) / F.lit(n_neg + 1.0)
    good = counts.filter((F.col("p") >= max(3, n_pos // 200)) & (rate_p > 4 * rate_q))
    best = good.orderBy(-F.col("p") * F.log(rate_p / rate_q), "f").limit(MAX_FEATURES).select("f").collect()
    return sorted({r["f"] for r in best} | set(_terms()))


def _numbers(names: list[str]):
    """Function from feature lists to sorted numbers of the chosen features."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [sorted(index[f] for f in fs if f in index) for fs in b.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(kept, pa.list_(pa.int32()))], ["toxic", "k"])

    return run


def _swaps(kept: list[int], index: dict[str, int], names: list[str]) -> list[tuple[set[int], set[int]]]:
    """Counterfactuals of a text: chosen features lost and gained when an identity term is exchanged
    for the others of its kind."""
    out, has = [], set(kept)
    numbers = lambda term: {index[f] for f in word_features(term) if f in index}
    for group in IDENTITY_TERMS:
        for term in group:
            if index[term] in has:
                out += [(numbers(term) & has, numbers(o) - has) for o in group if o != term and index[o] not in has]
    return out


def fit(rows: list[tuple[int, list[int]]], names: list[str], penalty: float = 4.0, ridge: float = 2e-3, steps: int = 400) -> Model:
    """Logistic regression on the presence of the features ``names``, given by number.  For every
    counterfactual of a training text the squared change of its score counts ``penalty`` times, so
    weight moves from the name of a group to what is said.  Without labels of both kinds the score
    is the base rate."""
    y = np.array([t for t, _ in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        rate = float(y.mean()) if len(rows) else 0.0
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return Model([], np.zeros(0), float(np.log(rate / (1 - rate))))
    index = {f: i for i, f in enumerate(names)}
    r = np.repeat(np.arange(len(rows)), [len(k) for _, k in rows])
    c = np.array([i for _, k in rows for i in k], np.int64)
    pairs = [swap for _, k in rows for swap in _swaps(k, index, names)]
    dr = np.array([k for k, (a, b) in enumerate(pairs) for _ in range(len(a) + len(b))], np.int64)
    dc = np.array([i for a, b in pairs for i in [*a, *b]], np.int64)
    ds = np.array([s for a, b in pairs for s, g in ((-1.0, a), (1.0, b)) for _ in g])
    w, bias = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean())))
    m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(r, weights=w[c], minlength=len(y)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(c, weights=e[r], minlength=len(names)) + ridge * w / len(names)
        if len(pairs):
            change = np.bincount(dr, weights=ds * w[dc], minlength=len(pairs))
            g += penalty * np.bincount(dc, weights=ds * change[dr], minlength=len(names)) / len(pairs)
        g = np.append(g, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(names, w, float(bias))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fits on at most ``most`` labelled rows outside the held-out third, by digest order.

    Of several labels of an id the toxic one holds; rows that share a labelled id are trained on each; null ids and
    null labels are left out.  The driver holds the chosen features and, of each row, their numbers:
    its memory does not grow with the length of the texts.
    """
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    x = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `most` ids
    store = Scratch(docs.sparkSession)
    feats = store.put(x.select("toxic", "text").mapInArrow(_features, "toxic int, f array<string>"))
    n = {r["toxic"]: r["count"] for r in feats.groupBy("toxic").count().collect()}
    names = select(feats, n[1], n[0]) if n.get(0) and n.get(1) else []
    rows = feats.mapInArrow(_numbers(names), "toxic int, k array<int>").collect()
    store.drop(feats)
    return fit(sorted((int(r["toxic"]), list(r["k"])) for r in rows), names)


def _scores(model: Model):
    """Function from texts to scores."""
    number = {f: i for i, f in enumerate(model.features)}
    w, k = model.weights, max(1, len(model.features))

    def run(texts: pa.Array) -> np.ndarray:
        vocab, codes, offs = words(texts)
        hits = [[number[f] for f in word_features(x) if f in number] for x in vocab]
        n = np.fromiter(map(len, hits), np.int64, len(hits))
        found = np.flatnonzero(n[codes])
        doc = np.searchsorted(offs, found, side="right") - 1
        pairs = np.unique(np.array(
            [d * k + h for d, c in zip(doc.tolist(), codes[found].tolist()) for h in hits[c]], np.int64))
        z = np.full(len(texts), model.bias)
        if len(pairs):
            z += np.bincount(pairs // k, weights=w[pairs % k], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row.  Null and empty texts have no feature and get the score
    of the bias; repeated rows score alike; an empty table gives no rows."""
    scores = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text")))], ["doc_id", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows, with all their columns, that score below the threshold."""
    scores = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            yield b.filter(pa.array(scores(b.column(text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    s = score(docs, train(docs, _labels(spark, sf_dir)))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; the model learns from the same labels as op6."""
    return keep_clean(docs, train(docs, _labels(spark, sf_dir)))
