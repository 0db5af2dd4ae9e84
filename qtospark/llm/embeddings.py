"""Near-duplicate embeddings by navigable small-world graphs per shard."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components

THRESHOLD = 0.98
SHARD = 2048  # vectors of a shard, about
DEGREE = 24  # neighbours kept on the base layer
BUILD_BEAM, BEAM = 32, 16
SLACK = 0.03  # nodes this far below the threshold are still expanded
AUDIT, RECALL = 48, 0.995  # queries audited per pair of shards, recall asked for


@dataclass
class Layer:
    nodes: np.ndarray  # positions in the shard
    links: np.ndarray  # rows of neighbours, as positions within the layer; -1: none


def _diverse(sim: np.ndarray, cand: np.ndarray, vec: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours for each row: by falling similarity, those nearer to the row than to one
    already chosen; free places go to the nearest of the rest."""
    order = np.argsort(-sim, axis=1, kind="stable")
    sim, cand = np.take_along_axis(sim, order, 1), np.take_along_axis(cand, order, 1)
    v = vec[np.maximum(cand, 0)]
    gram = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(sim.shape, bool)
    for r in range(sim.shape[1]):
        near = np.where(chosen, gram[:, r, :], -2).max(axis=1)
        chosen[:, r] = (cand[:, r] >= 0) & (near < sim[:, r]) & (chosen.sum(axis=1) < degree)
    rank = np.where(cand < 0, 2 * sim.shape[1] + 1, np.arange(sim.shape[1]) + np.where(chosen, 0, sim.shape[1]))
    best = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(cand, best, 1)
    return np.pad(out, ((0, 0), (0, max(0, degree - out.shape[1]))), constant_values=-1)


def _beam(query: np.ndarray, vec: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int, flood: float) -> np.ndarray:
    """Similarities that a best-first search sees (-2: not seen), for all queries side by side.

    ``beam`` nodes are expanded per query, best first; then every node seen above ``flood``
    is, until none is left, however many they are.
    """
    seen = np.full((len(query), len(vec)), -2.0, np.float32)
    fresh = np.full((len(query), len(vec)), -2.0, np.float32)  # seen, not expanded
    rows = np.arange(len(query))

    def see(q: np.ndarray, node: np.ndarray) -> None:
        ok = node >= 0
        q, node = q[ok], node[ok]
        new = seen[q, node] == -2
        q, node = q[new], node[new]
        for lo in range(0, len(q), 1 << 18):
            a, b = q[lo:lo + (1 << 18)], node[lo:lo + (1 << 18)]
            s = np.einsum("ij,ij->i", query[a], vec[b])
            seen[a, b] = s
            fresh[a, b] = s

    see(rows, entry)
    for _ in range(beam):
        best = fresh.argmax(axis=1)
        live = np.flatnonzero(fresh[rows, best] > -2)
        if not len(live):
            break
        fresh[live, best[live]] = -2
        see(np.repeat(live, links.shape[1]), links[best[live]].ravel())
    while True:
        q, node = np.nonzero(fresh >= flood)
        if not len(q):
            return seen
        fresh[q, node] = -2
        for lo in range(0, len(q), 1 << 14):
            a, b = q[lo:lo + (1 << 14)], node[lo:lo + (1 << 14)]
            pair = np.unique(np.repeat(a, links.shape[1]).astype(np.int64) * (len(vec) + 1) + links[b].ravel() + 1)
            see(pair // (len(vec) + 1), pair % (len(vec) + 1) - 1)


def _layer(vec: np.ndarray, degree: int) -> np.ndarray:
    """Links of one layer: nodes enter in growing batches and search what is there."""
    n = len(vec)
    links = np.full((n, degree), -1, np.int64)
    done = min(n, 2 * degree)
    first = np.tile(np.arange(done), (done, 1))
    np.fill_diagonal(first, -1)
    sim = vec[:done] @ vec[:done].T
    links[:done] = _diverse(np.where(first < 0, -2, sim), first, vec, degree)
    while done < n:
        new = np.arange(done, min(n, done + max(degree, done // 2)))
        seen = _beam(vec[new], vec[:done], links[:done], np.zeros(len(new), np.int64), BUILD_BEAM, 2.0)
        mates = vec[new] @ vec[new].T
        np.fill_diagonal(mates, -2)
        sim = np.concatenate([seen, mates], axis=1)
        k = min(2 * degree, sim.shape[1])
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sim, cand, 1)
        links[new] = _diverse(s, np.where(s > -2, cand, -1), vec, degree)
        src, dst = np.repeat(new, degree), links[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        s = np.einsum("ij,ij->i", vec[src], vec[dst])
        order = np.lexsort((-s, dst))
        src, dst = src[order], dst[order]
        nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
        src, dst, nth = src[nth < degree], dst[nth < degree], nth[nth < degree]
        hit = np.unique(dst)
        both = np.full((len(hit), 2 * degree), -1, np.int64)
        both[:, :degree] = links[hit]
        at = np.searchsorted(hit, dst)
        known = (links[dst] == src[:, None]).any(axis=1)
        both[at[~known], degree + nth[~known]] = src[~known]
        s = np.einsum("ijk,ik->ij", vec[np.maximum(both, 0)], vec[hit])
        links[hit] = _diverse(np.where(both < 0, -2, s), both, vec, degree)
        done = int(new[-1]) + 1
    return links


def build(vec: np.ndarray) -> list[Layer]:
    """Layers from the base up; every layer holds about a sixteenth of the one below."""
    v = vec.astype(np.float32)
    draw = np.random.default_rng(len(vec)).random(len(vec))
    layers, nodes = [], np.arange(len(vec))
    while len(nodes):
        layers.append(Layer(nodes, _layer(v[nodes], min(DEGREE, max(1, len(nodes) - 1)))))
        draw = draw * 16
        keep = draw[nodes] < 1
        nodes = nodes[keep] if keep.sum() < len(nodes) else nodes[:0]
    return layers


def search(query: np.ndarray, vec: np.ndarray, layers: list[Layer], beam: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) at or above the threshold that the graph finds, by exact cosine."""
    q32, v32 = query.astype(np.float32), vec.astype(np.float32)
    entry = np.full(len(query), layers[-1].nodes[0])
    for layer in reversed(layers[1:]):
        at = np.searchsorted(layer.nodes, entry)
        seen = _beam(q32, v32[layer.nodes], layer.links, at, 4, 2.0)
        entry = layer.nodes[seen.argmax(axis=1)]
    seen = _beam(q32, v32, layers[0].links, entry, beam, threshold - SLACK)
    q, node = np.nonzero(seen >= threshold - 1e-4)
    keep = [np.einsum("ij,ij->i", query[q[i:i + 65536]], vec[node[i:i + 65536]]) >= threshold for i in range(0, len(q), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return q[keep], node[keep]


def _audited(query: np.ndarray, vec: np.ndarray, layers: list[Layer], threshold: float) -> np.ndarray:
    """Found links as a matrix; the beam doubles until audited queries find what brute force does."""
    beam = BEAM
    some = np.unique(np.linspace(0, len(query) - 1, min(AUDIT, len(query))).astype(int))
    truth = query[some] @ vec.T >= threshold
    while True:
        q, node = search(query, vec, layers, beam, threshold)
        found = np.zeros((len(query), len(vec)), bool)
        found[q, node] = True
        if (found[some] & truth).sum() >= RECALL * truth.sum() or beam >= len(vec):
            return found
        beam *= 2


def _pack(layers: list[Layer]) -> bytes:
    parts = [np.array([len(layers)])]
    for x in layers:
        parts += [np.array([len(x.nodes), x.links.shape[1]]), x.nodes, x.links.ravel()]
    return np.concatenate(parts).astype("<i4").tobytes()


def _unpack(data: bytes) -> list[Layer]:
    a, at, out = np.frombuffer(data, "<i4").astype(np.int64), 1, []
    for _ in range(int(a[0])):
        n, k = int(a[at]), int(a[at + 1])
        out.append(Layer(a[at + 2:at + 2 + n], a[at + 2 + n:at + 2 + n + n * k].reshape(n, k)))
        at += 2 + n + n * k
    return out


_SHARD = "label long, dim int, shard long, ids binary, times binary, vectors binary, graph binary"


def _index(t: pa.Table) -> pa.Table:
    order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
    ids = t["vec_id"].to_numpy()[order]
    v = np.array(t["vector"].to_pylist(), np.float64)[order]
    v /= np.abs(v).max(axis=1, keepdims=True)  # no square leaves the range of doubles
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    one = lambda x: [x]
    return pa.table({
        "label": one(t["label"][0].as_py()), "dim": pa.array([v.shape[1]], pa.int32()), "shard": one(t["shard"][0].as_py()),
        "ids": one(ids.astype("<i8").tobytes()), "times": one(t["times"].to_numpy()[order].astype("<i8").tobytes()),
        "vectors": one(v.astype("<f8").tobytes()), "graph": one(_pack(build(v))),
    })


def _roots(a: np.ndarray, b: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id that each row and column reaches within a matrix of links."""
    ra, rb = a.copy(), b.copy()
    while True:
        na = np.minimum(ra, np.where(found, rb[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        nb = np.minimum(rb, np.where(found, na[:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max))
        if (na == ra).all() and (nb == rb).all():
            return na, nb
        ra, rb = na, nb


def _linker(threshold: float):
    def link(t: pa.Table) -> pa.Table:
        row = t.to_pylist()[0]
        side = {}
        for s in "ab":
            ids, times = np.frombuffer(row[f"{s}_ids"], "<i8"), np.frombuffer(row[f"{s}_times"], "<i8")
            side[s] = ids, times, np.frombuffer(row[f"{s}_vectors"], "<f8").reshape(len(ids), -1), _unpack(row[f"{s}_graph"])
        (ai, at, av, ag), (bi, bt, bv, bg) = side["a"], side["b"]
        same = row["a_shard"] == row["b_shard"]
        found = _audited(av, bv, bg, threshold)
        found |= (found if same else _audited(bv, av, ag, threshold)).T
        if same:
            np.fill_diagonal(found, True)
        ra, rb = _roots(ai, bi, found)
        ids, links, root = ai, found @ bt, ra
        if not same:
            ids, links, root = np.concatenate([ai, bi]), np.concatenate([links, found.T @ at]), np.concatenate([ra, rb])
        return pa.table({"vec_id": ids, "links": links.astype(np.int64), "root": root})

    return link


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Equal vectors of a label become one with a multiplicity.  Each label is dealt over shards
    of about ``shard`` vectors; a shard gets a layered graph, and every vector queries every
    shard of its label.  Links are verified by cosine in double precision, and a pair of
    shards reports a link count and the least linked id per vector, not the pairs, so large groups stay
    linear.  Components are joined over all reports.

    Null labels and vectors, zero vectors and ones with null or non-finite components link
    with nothing; vectors of different length are never compared; rows that share an id but
    not a vector count as one vector with the links of both; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    store = Scratch(spark)
    v = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    v = store.put(v.withColumn("_ok", F.coalesce(usable, F.lit(False))))
    key = ["label", "vector"]
    classes = store.put(v.filter("_ok").groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times")))
    n = classes.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    dealt = classes.join(n, "label").withColumn(
        "shard", F.pmod(F.xxhash64("vector"), F.ceil(F.col("_n") / shard)).cast("long")).withColumn("dim", F.size("vector"))
    shards = store.put(dealt.select("label", "dim", "shard", "vec_id", "times", "vector").groupBy("label", "dim", "shard").applyInArrow(_index, _SHARD))
    cols = ["shard", "ids", "times", "vectors", "graph"]
    a = shards.select("label", "dim", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = shards.select("label", "dim", *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, ["label", "dim"]).filter("a_shard <= b_shard")
    seen = store.put(pairs.groupBy("label", "dim", "a_shard", "b_shard").applyInArrow(
        _linker(threshold), "vec_id long, links long, root long"))
    comps = components(store, seen.filter("vec_id <> root"), "vec_id", "root")
    links = seen.groupBy("vec_id").agg(F.sum("links").alias("_links"))
    reps = classes.select(*key, F.col("vec_id").alias("_rep"))
    reps = reps.join(links.withColumnRenamed("vec_id", "_rep"), "_rep").join(comps.withColumnRenamed("node", "_rep"), "_rep", "left")
    out = v.filter("_ok").join(reps, key).select(
        "vec_id", (F.col("_links") - 1).alias("n_links"), F.coalesce("component", "_rep").alias("component_id"))
    alone = v.filter("NOT _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
