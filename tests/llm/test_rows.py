"""Operators that look at one row at a time, or count: tokens, files, packing, rules, mixing, scores."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from qtospark.llm import huffman, licences, mixing, packing, quality, token_counts, toxicity

from .data import empty, rows, table

P = pytest.importorskip("public_tokenizers")
BPE, SP = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def crc(v):
    return zlib.crc32(np.array(v, "<u4").tobytes())


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = sorted(map(tuple, token_counts.token_counts(table(spark), SP).collect()), key=repr)
    assert got == sorted(((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in rows()), key=repr)
    assert token_counts.token_counts(empty(spark), SP).count() == 0


def test_token_files_round_trip(spark, tmp_path, ids):
    huffman.write_ids(table(spark), BPE, str(tmp_path / "x"))
    got = huffman.read_ids(spark, str(tmp_path / "x")).collect()
    want = Counter((r[0], tuple([*ids(r[1]), 0])) for r in rows())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    huffman.write_ids(empty(spark), BPE, str(tmp_path / "y"))
    assert huffman.read_ids(spark, str(tmp_path / "y")).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(0)
    c = np.where(rng.random(3000) < 0.8, (1e6 * rng.random(3000) ** 9).astype(np.int64) + 1, 0)
    n = huffman.code_lengths(c, 13)
    assert (n[c > 0] >= 1).all() and (n[c == 0] == 0).all() and n.max() <= 13
    assert sum(2.0 ** -int(x) for x in n if x) == 1.0
    n, p = huffman.code_lengths(c, 40), c[c > 0] / c.sum()
    assert (n[c > 0] * p).sum() < -(p * np.log2(p)).sum() + 0.1
    assert list(huffman.code_lengths(np.array([5, 1, 1, 2]))) == [1, 3, 3, 2]


def test_packing(spark, ids):
    p = packing.token_pieces(table(spark), BPE)
    got = packing.place(p).collect()
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], r["length"], r["piece"], bytes(r["ids"])))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(n for s in seqs.values() for _, n in s)
    assert len(seqs) <= -(-total // 1024) + 2
    once = {r[0]: [*ids(r[1]), 2] for r in rows()}
    for d, want in once.items():
        mine = sorted(set(docs[d]))
        assert crc(want) == zlib.crc32(b"".join(x[3] for x in mine)) and [x[2] for x in mine] == list(range(len(mine)))
        assert all(x[1] == 1024 for x in mine[1:])
    assert packing.place(packing.token_pieces(empty(spark), BPE)).count() == 0
    small = table(spark).filter("doc_id < 2000").dropDuplicates(["doc_id"])
    q = packing.token_pieces(small, BPE)
    whole = packing.sequences(q, packing.place(q)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(len(once[i]) for i in once if i is not None and i < 2000)


@pytest.mark.parametrize("hist,least", [({600: 10, 400: 10, 24: 10}, 10), ({342: 7}, 4), ({1: 3000}, 3), ({1024: 5, 1: 1}, 6), ({500: 3, 20: 100}, 4)])
def test_plan(hist, least):
    steps = packing.plan(hist, 1024)
    fill = defaultdict(int)
    placed = Counter()
    for n, lo, hi, seq, per, off in steps:
        placed[n] += hi - lo
        for i in range(hi - lo):
            assert off + (i % per) * n == fill[seq + i // per]
            fill[seq + i // per] += n
    assert placed == Counter(hist) and max(fill.values()) <= 1024 and len(fill) == least


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    rep = len({j for i, x in enumerate(g) if n[x] > 1 for j in (i, i + 1, i + 2)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep


def test_quality_ledger(spark):
    extra = ["a b c " * 40, "x ### y | z <> $$ %& line\nx\nx\n\nx ", "a b a b a b a", "a b c d a b c", "\x0b\x0cq\x1cq"]
    led = quality.ledger(table(spark, extra))
    got = sorted((tuple(r)[:4] + tuple(r)[5:7] for r in led.collect()), key=repr)
    assert got == sorted(((r[0], *brute_rules(r[1])) for r in rows(extra)), key=repr)
    one = quality.ablation(led).collect()
    kept = quality.apply_policy(led).filter("kept").count()
    for r in one:
        assert r["kept_without"] == kept + r["fails_alone"] and r["fails"] >= r["fails_alone"]
    assert quality.ledger(empty(spark)).count() == 0


def test_mixing_keeps_repeated_rows(spark, tmp_path):
    more = [(1, "", "en", "a", 0), (1, "", "en", "a", 0), (None, "x y", "en", "a", 3), (None, "x y", "en", "a", 3), (2, "x y z", "en", "b", 5)]
    spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r[0] or 0, r[1]) for r in mixing.op10_mix_sources(spark, str(tmp_path)).collect()) == [(0, 2), (0, 2), (1, 0), (1, 0), (2, 3)]


def test_mixing(spark):
    m = mixing.mix(table(spark)).collect()
    n = sum(len(WORD.findall(r[1] or "")) for r in rows())
    assert sum(r["taken"] for r in m) == pytest.approx(1.5 * n, abs=8)
    by, goal, size = Counter(), {}, {}
    for r in m:
        by[r["source"]] += r["taken"]
        goal[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert all(abs(by[s] - goal[s]) <= 1 and goal[s] <= 2 * size[s] for s in goal)
    again = mixing.mix(table(spark).repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["copy"], r["start"], r["taken"], r["place"])
    assert sorted(map(key, m)) == sorted(map(key, again))
    assert mixing.mix(empty(spark)).count() == 0
    st = mixing.stage(spark, table(spark), "")
    assert st.columns == table(spark).columns
    assert sum(len(WORD.findall(r["text"])) for r in st.filter("doc_id is not null").collect()) == sum(r["taken"] for r in m if r["doc_id"] is not None)


def test_toxicity(spark):
    t, n = ["you idiot go away", "what a moron he is", "idiot moron fool"], ["a fine day", "the women sing", "we walk home"]
    data = [(1, toxicity_words(x)) for x in t for _ in range(9)] + [(0, toxicity_words(x)) for x in n for _ in range(20)]
    model = fit_toxicity(spark, data)
    base = toxicity._scores(model)
    import pyarrow as pa

    s = base(pa.array(["an idiot", "a walk home", None, "", "the women sing", "the muslims sing"]))
    assert s[0] > 0.3 > s[1] and s[2] == s[3] < 0.3
    assert toxicity.score(table(spark), model).count() == len(rows())
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.fit([], []).features == [] and toxicity.fit([(1, [0])], ["a"]).bias > 0
    kept = toxicity.keep_clean(table(spark, ["you idiot, what a moron he is"]), model)
    assert kept.columns == table(spark).columns and kept.count() == len(rows())


def test_counterfactual_penalty(spark):
    toxic = [(1, toxicity_words("the gay idiot"))] * 20 + [(1, toxicity_words("you idiot"))] * 5
    clean = [(0, toxicity_words("we sing"))] * 30 + [(0, toxicity_words("a straight road"))] * 5
    free, held = (fit_toxicity(spark, [*toxic, *clean], penalty=p) for p in (0, 50))
    gap = lambda m: abs(dict(zip(m.features, m.weights))["gay"] - dict(zip(m.features, m.weights))["lesbian"])
    assert gap(held) < 0.3 * gap(free)


def fit_toxicity(spark, data, **how):
    names = toxicity.select(spark.createDataFrame(data, "toxic int, f array<string>"), sum(y for y, _ in data), sum(not y for y, _ in data))
    assert {t for g in toxicity.IDENTITY_TERMS for t in g} <= set(names)
    return toxicity.fit([(y, sorted(names.index(f) for f in fs if f in names)) for y, fs in data], names, **how)


def toxicity_words(text):
    return sorted({f for w in text.split() for f in toxicity.word_features(w)})


def test_licences(spark):
    extra = [
        "Some words here.\n\nReleased under the MIT License.\n\nOthers follow", "Licensed under CC BY-NC 4.0.",
        "text before\nLicensed under the Apache License, Version 2.0.\nand after", "He lost his driver license, you need permission.",
        "This work is licensed under the GNU General Public License, version 3.", "Released under the Nonsense License.",
    ]
    got = {(r["doc_id"], r["family"]) for r in licences.scan(table(spark, extra)).collect()}
    assert got == {(18, "mit"), (19, "cc-by-nc"), (20, "apache"), (22, "gpl")}
    assert licences.scan(empty(spark)).count() == 0
