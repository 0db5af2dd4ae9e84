"""Merkle manifest against a plain tree in Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from qtospark.llm import manifest

from .data import empty, rows, table

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def climb(nodes):
    """``(root, siblings of every node: [(before, after), ..])``."""
    where, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(where):
            lo = p // 8 * 8
            proofs[i].append(("".join(nodes[lo:p]), "".join(nodes[p + 1:lo + 8])))
        nodes = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        where = [p // 8 for p in where]
    return nodes[0], proofs


def leaf(r, lower=False):
    r = dict(r)
    if lower and r["text"] is not None:
        r["text"] = "".join(c.lower() if c < "\x7f" else c for c in r["text"])
    vals = [r[c] for c in manifest.FIELDS]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def brute(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(r, True)))
    order = sorted(groups, key=lambda g: b"" if g is None else b"s" + g.encode())
    subs = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    root, over = climb([subs[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (known, i, one, low), proof in zip(sorted(groups[g]), subs[g][1]):
            at = low if known and zlib.crc32(str(i).encode()) % 3 == 0 else one
            for b, a in proof + over[k]:
                at = H(b, at, a)
            text = "".join(b + a for b, a in proof + over[k])
            out.append((i if known else None, one, subs[g][0], root, H(text), at, at == root))
    return Counter(out)


def run(spark, docs, monkeypatch):
    monkeypatch.setattr(manifest, "documents", lambda s, d: docs)
    return Counter(map(tuple, manifest.op13_merkle_manifest(spark, "").collect()))


def test_odd_rows(spark, monkeypatch):
    docs = table(spark)
    got = run(spark, docs, monkeypatch)
    assert got == brute([r.asDict() for r in docs.collect()]) and sum(got.values()) == len(rows())
    assert manifest.manifest(empty(spark)).count() == 0


@pytest.mark.parametrize("sizes", [(1,), (8, 9), (64, 65, 1, 7), (513, 100), (577, 1), (3, 3, 3, 3, 3, 3, 3, 3, 3, 3)])
def test_rounds(spark, sizes):
    """Blocks of eight leaves, so that short runs meet in every round."""
    data = [{"doc_id": 10_000 * g + i, "source": "a", "lang": None if g == 1 else f"l{g}é", "n_chars": i, "text": f"T{i}"}
            for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    m = manifest.manifest(docs, levels=1)
    got = m.select("doc_id", "leaf", "subroot", "root", manifest.F.sha2(manifest.proof_text(manifest.F.col("proof")), 256).alias("p"),
                   manifest.fold(manifest.F.col("leaf"), manifest.F.col("proof")).alias("f")).collect()
    want = {x[0]: x for x in brute(data)}
    assert len(got) == len(data)
    for r in got:
        assert tuple(r)[:5] == want[r["doc_id"]][:5] and r["f"] == r["root"]


def test_tampered_is_found(spark, monkeypatch):
    data = [{"doc_id": i, "source": None, "lang": "en", "n_chars": None, "text": "Upper" if i % 2 else "lower"} for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    got = {k[0]: k[6] for k in run(spark, docs, monkeypatch)}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(60)}
