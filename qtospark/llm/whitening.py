"""Whitening of embeddings over their distinct vectors, each with its multiplicity as weight.

Vectors become integers, so equal ones are one group however many rows hold them.  Sums over the groups
are exact; every block of groups is centred in integers and multiplied by itself with the group's weight, and
only these products of a task meet.  Each distinct vector is whitened once, and rows join back by vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values of the contract.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows that are multiplied at a time.
ROWS = 2048
#: Integers below this stay exact when a few of them are added.
SAFE = 1 << 61


def integers(vec: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Entries as whole numbers; those beyond 2**60 in size are held there."""
    most = float(1 << 60)
    return F.transform(vec, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * scale))) + F.lit(shift).cast("long"))


def usable(vec: Column) -> Column:
    inf = F.lit(float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < inf))


def _by_width(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(width, rows, their vectors)`` of a batch, at most ROWS at a time."""
    vecs = b.column("x")
    width = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
    flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.cumsum(width)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for i in range(0, len(rows), ROWS):
            r = rows[i:i + ROWS]
            yield int(w), r, flat[(ends[r] - w)[:, None] + np.arange(w)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for b in batches:
        times = b.column("weight").to_numpy()
        for w, r, x in _by_width(b):
            t = times[r]
            most = int(np.abs(x).max()) * int(t.sum())
            s = (x * t[:, None]).sum(0) if most < SAFE else (x.astype(object) * t[:, None].astype(object)).sum(0)
            n[w] = n.get(w, 0) + int(t.sum())
            total[w] = total.get(w, 0) + np.array([int(v) for v in s], object)
    # two halves of a sum, each a long
    for w in n:
        hi, lo = [int(v) >> 32 for v in total[w]], [int(v) & 0xFFFFFFFF for v in total[w]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w] * w, pa.int32()), pa.array(range(w), pa.int32()), pa.array([n[w]] * w, pa.int64()),
             pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["width", "pos", "n", "hi", "lo"])


def _deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - total`` without rounding: as longs where they fit, else as Python's integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, total)) < SAFE:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, null beyond a long."""
    if d.dtype != object and d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < SAFE:
        return (d * d).sum(1).tolist()
    out = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in out]


def _products(fit: dict[int, tuple[int, list[int]]], column: str) -> Callable:
    """Weighted products of the centred vectors of a task, summed; the upper half, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            times = b.column("weight").to_numpy()
            if column == "x":
                parts = ((w, times[r], _deviations(x, *fit[w]).astype(np.float64) / fit[w][0]) for w, r, x in _by_width(b))
            else:
                width = b.column("width").to_numpy()
                flat, size = b.column(column), pc.list_value_length(b.column(column)).to_numpy(zero_copy_only=False)
                parts = ((int(w), times[width == w], flat.filter(pa.array(width == w)).flatten().to_numpy().reshape(int((width == w).sum()), -1))
                         for w in np.unique(width[size > 0]))
            for w, t, c in parts:
                total[w] = total.get(w, 0) + (c * t[:, None]).T @ c
        for w, g in total.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), w, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])],
                ["width", "i", "j", "v"])

    return run


def _square(t: pa.Table) -> np.ndarray:
    i, j, v = (t.column(c).to_numpy() for c in "ijv")
    g = np.zeros((int(j.max()) + 1,) * 2)
    g[i, j] = v
    g[j, i] = v
    return g


def _solver(fit: dict[int, tuple[int, list[int]]], most: int) -> Callable:
    def solve(t: pa.Table) -> pa.Table:
        width = t.column("width")[0].as_py()
        v = _square(t) / fit[width][0]
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        k = min(most, int((e > e[0] * len(e) * np.finfo(float).eps).sum()) if e[0] > 0 else 0)
        u = u[:, :k] * np.where(u[np.abs(u[:, :k]).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
        return pa.table({
            "width": pa.array([width] * k, pa.int32()), "component": pa.array(range(1, k + 1), pa.int32()), "e": pa.array(e[:k]),
            "explained": pa.array(e[:k] / np.trace(v)), "vector": pa.array([u[:, i] for i in range(k)], pa.list_(pa.float64()))})

    return solve


def _whitener(fit: dict[int, tuple[int, list[int]]], model: dict[int, tuple[np.ndarray, list[float]]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, r, x in _by_width(b):
                n, total = fit[w]
                d = _deviations(x, n, total)
                basis, share = model.get(w, (np.zeros((w, 0)), []))
                y = (d.astype(np.float64) / n) @ basis
                yield pa.RecordBatch.from_arrays(
                    [b.column("x").take(pa.array(r)), b.column("weight").take(pa.array(r)), pa.array([w] * len(r), pa.int32()),
                     pa.array([n] * len(r), pa.int64()), pa.array(_squares(d), pa.int64()),
                     pa.array(list(y), pa.list_(pa.float64())), pa.array([share] * len(r), pa.list_(pa.float64()))],
                    ["x", "weight", "width", "n", "deviation", "whitened", "explained"])

    return run


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", weights: str = "ones",
    components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
) -> tuple[DataFrame, float]:
    """``(id, n, deviation, whitened, explained)`` of every usable row, and the identity error.

    ``weights`` is ``ones`` (each distinct vector counts once) or ``counts`` (by its rows).  ``whitened``
    and ``explained`` are arrays by falling eigenvalue; components without variance (up to rounding) are left
    out, so a list of one vector has none.  Vectors of different lengths are fitted apart, each length
    over its own list.  Rows with a null vector, or with null or non-finite or no entries, are dropped; equal rows
    are kept each; a null id stays.  A deviation beyond a long is null.  Beside the rows, the driver holds the sums
    and at most ``components`` vectors of each length.  An empty table gives no rows and the error 0.
    """
    if weights not in ("ones", "counts"):
        raise ValueError(f"weights are ones or counts, not {weights}")
    store = Scratch(rows.sparkSession)
    x = rows.filter(usable(F.col(vec_col))).select(F.col(id_col), integers(F.col(vec_col), scale, shift).alias("x"))
    weight = F.count(F.lit(1)) if weights == "counts" else F.lit(1).cast("long")
    distinct = store.put(x.groupBy("x").agg(weight.alias("weight")))
    sums = distinct.mapInArrow(_sums, "width int, pos int, n long, hi long, lo long").groupBy("width", "pos").agg(
        F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).orderBy("width", "pos").collect()
    fit: dict[int, tuple[int, list[int]]] = {}
    for r in sums:
        fit.setdefault(r["width"], (r["n"], []))[1].append((r["hi"] << 32) + r["lo"])
    cell = "width int, i int, j int, v double"
    cov = distinct.mapInArrow(_products(fit, "x"), cell).groupBy("width", "i", "j").agg(F.sum("v").alias("v"))
    found = cov.groupBy("width").applyInArrow(_solver(fit, components), "width int, component int, e double, explained double, vector array<double>")
    model: dict[int, tuple[list, list]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["width"], r["component"])):
        basis, share = model.setdefault(r["width"], ([], []))
        basis.append(np.array(r["vector"]) / np.sqrt(r["e"]))
        share.append(r["explained"])
    ready = {w: (np.array(basis).T, share) for w, (basis, share) in model.items()}
    white = store.put(distinct.mapInArrow(
        _whitener(fit, ready),
        "x array<long>, weight long, width int, n long, deviation long, whitened array<double>, explained array<double>"))
    got = white.mapInArrow(_products(fit, "whitened"), cell).groupBy("width", "i", "j").agg(F.sum("v").alias("v")).collect()
    error = max((abs(r["v"] / fit[r["width"]][0] - (r["i"] == r["j"])) for r in got), default=0.0)
    store.drop(distinct)
    return x.join(white.drop("weight", "width"), "x").select(id_col, "n", "deviation", "whitened", "explained"), float(error)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every usable vector and component, fitted over the distinct vectors."""
    rows, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    out = rows.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("pos", "v"))
    return out.select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("v.whitened").alias("whitened"),
        F.col("v.explained").alias("explained"), F.lit(error).alias("identity_error"))
