"""Whitening against numpy over the whole table."""

import math

import numpy as np
import pytest

from qtospark.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, x string, weight string"


def table(spark, vecs):
    return spark.createDataFrame([(i, v, 1, "x", "w") for i, v in enumerate(vecs)], KIND)


def brute(vecs, weights="ones", most=16):
    x = [tuple(int(math.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vecs]
    fit = list(dict.fromkeys(x)) if weights == "ones" else x
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in fit])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    white = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x]) @ u / np.sqrt(e)
    return n, dev, white, e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("weights", ["ones", "counts"])
def test_against_numpy(spark, weights):
    rng = np.random.default_rng(3)
    vecs = (rng.normal(size=(700, 24)) @ np.diag(np.linspace(3, 0.2, 24))).astype(np.float32).tolist()
    vecs += [vecs[0]] * 300 + [[c + 1e-6 for c in vecs[1]]]
    rows, error = whitening.whiten(table(spark, vecs).repartition(7), weights=weights)
    n, dev, white, share = brute(vecs, weights)
    got = {r["vec_id"]: r for r in rows.collect()}
    assert len(got) == len(vecs) and error < 1e-8
    sign = np.sign(np.array(got[5]["whitened"]) * white[5])
    for i, r in got.items():
        assert r["n"] == n and r["deviation"] == dev[i]
        assert np.allclose(np.array(r["whitened"]) * sign, white[i], rtol=1e-7, atol=1e-7)
        assert np.allclose(r["explained"], share, rtol=1e-9)


def test_odd_rows(spark):
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, 2.0, float("-inf")]]
    good = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [0.0, 2.5, 3.0], [4.0, 2.0, 1.0], [1e30, 2.0, 1.0], [0.0, 0.0, 0.0]]
    other = [[1.0, 2.0], [3.0, 5.0], [2.0, 9.0], [7.0]]  # lengths of their own; one vector has no component
    rows, error = whitening.whiten(table(spark, bad + good + other))
    got = {r["vec_id"]: r for r in rows.collect()}
    assert sorted(got) == list(range(len(bad), len(bad + good + other)))
    assert {got[i]["n"] for i in range(6, 12)} == {5} and got[12]["n"] == 3 and got[15]["n"] == 1
    assert got[10]["deviation"] is None and got[15]["whitened"] == [] and got[15]["deviation"] == 0
    n, dev, white, share = brute(other[:3])
    assert [got[i]["deviation"] for i in (12, 13, 14)] == dev and np.allclose(np.abs([got[i]["whitened"] for i in (12, 13, 14)]), np.abs(white))
    assert error < 1e-6
    none, error = whitening.whiten(table(spark, [None]))
    assert none.count() == 0 and error == 0
    same, error = whitening.whiten(table(spark, [[1.0, 2.0]] * 50))
    assert [r["whitened"] for r in same.collect()] == [[]] * 50


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = whitening.op12_embedding_whitening(spark, d).toPandas()
    vecs = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, dev, white, share = brute(vecs["embedding"].tolist())
    got = got.sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(vecs) and (got["n"] == n).all() and got["identity_error"].iloc[0] < 1e-9
    assert got["deviation"].tolist() == [x for x in dev for _ in range(16)]
    w = got["whitened"].to_numpy().reshape(-1, 16)
    assert np.allclose(w * np.sign((w * white).sum(0)), white, atol=1e-6)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 16), share, rtol=1e-8)
