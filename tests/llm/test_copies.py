"""Operators on pairs and repeats, against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from qtospark.llm import common, embeddings, similarity_join, substrings, suffixes

from .data import empty, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_texts():
    """Crowds of near copies, a passage that many texts share, short texts, one-word texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    base, passage, chain = text(150), text(60), text(120)
    out = []
    for _ in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = word()
        out.append(t)
    for k in range(40):  # each step is near the one before, the ends are not
        chain = list(chain)
        chain[3 * k] = word()
        out.append(chain)
    out += [[*text(rng.randint(5, 60)), *passage, *text(rng.randint(5, 60))] for _ in range(90)]
    out += [[*passage, *text(rng.randint(0, 4))] for _ in range(60)]
    out += [text(rng.randint(1, 6)) for _ in range(30)] + [["one"]] * 40 + [["ONE"]]
    out += [text(rng.randint(100, 300)) for _ in range(30)]
    return [" ".join(t) for t in out]


def brute_jaccard(texts, size, num, den):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    shared = Counter()
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            shared.update((j, i) for j in where[g])
            where[g].append(i)
    links = [p for p, c in shared.items() if c * den >= num * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    return [len(s) for s in sets], components(range(len(sets)), links)


def test_jaccard_join(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, num, den in ((4, 85, 100), (5, 4, 5)):
        got = {r[0]: r[1:] for r in similarity_join.jaccard_components(docs, size, num, den).collect()}
        n, comp = brute_jaccard(texts, size, num, den)
        assert got == {i: (n[i], comp[i]) for i in range(len(texts))}


def short_texts():
    """Many short texts, each with a variant: a word appended or one changed."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for i in range(2000):
        t = [word() for _ in range(rng.randint(7, 30))]
        v = [*t, word()] if i % 2 else list(t)
        if i % 2 == 0:
            v[rng.choice([0, -1, rng.randrange(len(v))])] = word()
        out += [t, v]
    rng.shuffle(out)
    return [" ".join(t) for t in out]


def test_jaccard_join_short_texts(spark):
    texts = short_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, num, den in ((4, 85, 100), (5, 4, 5)):
        got = {r[0]: r[1:] for r in similarity_join.jaccard_components(docs, size, num, den).collect()}
        n, comp = brute_jaccard(texts, size, num, den)
        want = {i: (n[i], comp[i]) for i in range(len(texts))}
        assert len(set(comp.values())) < len(texts) - 1000 and [i for i in want if got[i] != want[i]] == []


def test_jaccard_join_short_groups_are_no_crowds(spark, monkeypatch):
    """Distinct texts of few words cannot link, so they are in no list together."""
    docs = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i}") for i in range(300)], "doc_id long, text string")
    seen = []

    def settle(self, entries, sets):
        seen.append(entries.count())
        return self.spark.createDataFrame([], "node long, component long")

    monkeypatch.setattr(similarity_join.JaccardJoin, "_settle", settle)
    similarity_join.jaccard_components(docs, 4, 85, 100)
    assert seen == [0]


def test_jaccard_join_compares_few_of_a_common_passage(spark, monkeypatch):
    """Texts put together from passages that many share: few pairs could link, and only these are compared."""
    rng = random.Random(13)
    passages = [["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)] for _ in range(10)]
    texts = [" ".join(w for p in rng.sample(passages, 3) for w in p) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared = []

    class Counting(common.Scratch):
        def put(self, df, *more):
            out = super().put(df, *more)
            if df.columns == ["x", "y", "ok"]:
                compared.append(out.count())
            return out

    monkeypatch.setattr(similarity_join, "Scratch", Counting)
    got = {r[0]: r[1:] for r in similarity_join.jaccard_components(docs, 5, 4, 5).collect()}
    n, comp = brute_jaccard(texts, 5, 4, 5)
    assert got == {i: (n[i], comp[i]) for i in range(len(texts))}
    assert 0 < sum(compared) < 3000


def test_scratch_leaves_no_shuffle_files(spark, tmp_path):
    conf = {k: spark.conf.get(k, None) for k in common.WRITING}
    left = lambda: {b.toString() for b in to_list(blocks()) if b.isShuffle()}
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    to_list = lambda s: [s.apply(i) for i in range(s.size())]
    before = left()
    out = common.Scratch(spark).put(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.2)
    assert left() <= before and out.count() == 7
    assert conf == {k: spark.conf.get(k, None) for k in common.WRITING}


def test_jaccard_join_odd_rows(spark):
    r = rows()
    got = Counter(map(tuple, similarity_join.jaccard_components(table(spark)).collect()))
    n, comp = brute_jaccard([x[1] for x in r], 5, 4, 5)
    assert got == Counter((r[i][0], n[i], r[comp[i]][0]) for i in range(len(r)))
    assert similarity_join.jaccard_components(empty(spark)).count() == 0
    kept = similarity_join.stage(spark, table(spark), "")
    assert kept.columns == table(spark).columns and {r["doc_id"] for r in kept.collect()} >= {0, 1, 3, 10, None}


def test_stage_keeps_one_row(spark):
    rng = random.Random(12)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)) for _ in range(5))
    rows = [
        (1, a), (1, a), (2, a + " tail"),  # a row repeated in full
        (None, b), (None, b), (None, b + " tail"), (None, c), (9, c),  # no ids
        (3, d), (7, d + " tail"), (7, e),  # an id that a kept row of another group has too
        (4, ""), (4, ""), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, similarity_join.stage(spark, docs, "").collect()))
    group = {t: g for g in (a, b, c, d, e) for t in (g, g + " tail")}
    assert Counter((i, group.get(t, t)) for i, t in got.elements()) == Counter(
        [(1, a), (None, b), (9, c), (3, d), (7, e), (4, ""), (4, ""), (None, None)])
    assert got[(1, a)] == 1 and got[(3, d)] == 1


def brute_repeats(texts, width):
    where = defaultdict(list)
    raws = [(t or "").encode() for t in texts]
    for i, b in enumerate(raws):
        for j in range(len(b) - width + 1):
            where[b[j:j + width]].append((i, j))
    gone = [np.zeros(len(b), bool) for b in raws]
    for v in where.values():
        if len(v) > 1:
            for i, j in v:
                gone[i][j:j + width] = True
    out = []
    for b, g in zip(raws, gone):
        out.append((len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()),
                    bytes(np.frombuffer(b, np.uint8)[~g])))
    return out


def repeated_texts():
    rng = random.Random(4)
    text = lambda n, a="abcé ": "".join(rng.choice(a) for _ in range(n))
    parts = [text(rng.randint(50, 130)) for _ in range(5)]
    out = [text(300) + parts[0] + text(100) + parts[1], parts[0] + parts[1] + parts[2], text(30) + parts[2][3:] + text(200)]
    out += [text(rng.randint(0, 90)) + rng.choice(parts) + text(rng.randint(0, 90)) + rng.choice(parts)[rng.randint(0, 9):] for _ in range(60)]
    base = text(400)
    for _ in range(25):
        t = list(base)
        t[rng.randrange(len(t))] = "X"
        out.append("".join(t))
    return [*out, base, base, "a" * 300, "ab" * 90, text(63), parts[0][:64], parts[0][:63], "", None]


def test_repeats(spark, monkeypatch):
    texts = repeated_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (4096, 3):
        monkeypatch.setattr(substrings, "GROUP", group)
        got = {r[0]: (*r[1:4], bytes(r[4])) for r in substrings.remove_repeats(docs, 64).collect()}
        for i, want in enumerate(brute_repeats(texts, 64)):
            assert got[i] == want, i


def test_repeats_buckets_are_tasks_of_their_own(spark, monkeypatch):
    """Suffix arrays take few bytes and much time: AQE must not put all of them in one task."""
    docs = spark.createDataFrame(list(enumerate(repeated_texts())), "doc_id long, text string")

    def one(t):
        return pa.table({"tid": pa.array([b""], pa.binary()), "f": pa.array([TaskContext.get().partitionId()], pa.int64()), "l": pa.array([-1], pa.int64())})

    monkeypatch.setattr(substrings, "BATCH", 16)
    monkeypatch.setattr(substrings, "_suffixes", one)
    ranges, _ = substrings.repeats(docs, 64)
    dealt = {r.f for r in ranges.filter("tid = X''").collect()}
    assert len(dealt) > 1


def test_repeats_odd_rows(spark):
    got = Counter((r[0], *r[1:4], bytes(r[4])) for r in substrings.remove_repeats(table(spark)).collect())
    want = brute_repeats([r[1] for r in rows()], 400)
    assert got == Counter((r[0], *w) for r, w in zip(rows(), want))
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        x = [rng.randint(1, rng.choice([1, 2, 5, 200])) for _ in range(rng.randint(0, 40))]
        order = suffixes.suffix_array(x)
        assert order == sorted(range(len(x)), key=lambda i: x[i:])
        shared = suffixes.common_prefixes(x, order)
        for k in range(1, len(x)):
            a, b = x[order[k]:], x[order[k - 1]:]
            n = shared[k]
            assert a[:n] == b[:n] and (a[n:n + 1] != b[n:n + 1] or not a[n:] or not b[n:])


def vectors():
    rng = np.random.default_rng(2)
    out = []
    for label in (0, 1, None):
        centre = rng.normal(size=32)
        crowd = centre + 0.09 * rng.normal(size=(150, 32))
        pairs = rng.normal(size=(60, 32))
        v = np.concatenate([crowd, np.repeat(pairs, 2, axis=0) + 0.05 * rng.normal(size=(120, 32)), rng.normal(size=(200, 32))])
        out += [(x.astype(np.float32).tolist(), label) for x in v]
    out += [(out[5][0], 0)] * 3 + [([3e30 * x for x in out[5][0]], 0), ([0.0] * 32, 0), (None, 0), ([float("nan")] * 32, 1), ([None] * 32, 1), ([], 1), ([1.0, 2.0], 1)]
    return [(i, v, k) for i, (v, k) in enumerate(out)]


def test_embeddings(spark):
    data = vectors()
    t = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    links = []
    good = {i: np.array(v, np.float64) for i, v, k in data if v and k is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    label = {i: k for i, _, k in data}
    for i in unit:
        for j in unit:
            if i < j and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links.append((i, j))
    n = Counter(x for p in links for x in p)
    comp = components([i for i, _, _ in data], links)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(t, shard=200).collect()}
    assert len(got) == len(data) and len(links) > 3000
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * 2 * len(links)
    assert all(got[i]["n_links"] <= n[i] for i in got)
    assert sum(got[i]["component_id"] == comp[i] for i in got) >= 0.97 * len(data)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0
