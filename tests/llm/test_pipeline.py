"""The pipeline against brute force, stage by stage."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from qtospark.llm import toxicity

from .test_copies import brute_jaccard, brute_repeats

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
INSULTS = ["idiot", "moron", "scum", "loser"]


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(80))
    texts = []
    for i in range(150):
        w = [word() for _ in range(rng.randint(40, 160))]
        if i % 5 == 0:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
        t = " ".join(w)
        if i % 7 == 1:
            t += " " + passage + " " + word()
        texts.append(t)
    texts += [texts[1], texts[2] + " tail", None, "", texts[3].replace(" ", "  ", 1)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    rows = corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame(rows, kind).write.parquet(f"{sf}/documents.parquet")
    toxic = {i: int(bool(set(INSULTS) & set((t or "").split()))) for i, t, *_ in rows}
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        out[name] = [tuple(r) for r in docs.collect()]
        assert k == 4 or docs.columns == [f.split()[0] for f in kind.split(", ")]
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(model.features, model.weights))

    def score(text):
        found = {f for w in WORD.findall(text or "") for f in toxicity.word_features(w)}
        return 1 / (1 + math.exp(-model.bias - sum(weight.get(f, 0.0) for f in found)))

    clean = sorted(r for r in rows if score(r[1]) < 0.7)
    assert all(r in clean for r in rows if not toxic[r[0]]) and len(clean) < len(rows) - 10
    assert sorted(out["toxicity"]) == clean
    _, comp = brute_jaccard([r[1] for r in clean], 5, 4, 5)
    kept = [r for i, r in enumerate(clean) if comp[i] == i]
    assert sorted(out["ngram_jaccard_join"]) == kept
    cut = [b[3].decode("utf-8", "ignore") for b in brute_repeats([r[1] for r in kept], 400)]
    want = [(r[0], None if r[1] is None else t) for r, t in zip(kept, cut)]
    assert sorted((r[0], r[1]) for r in out["suffix_dedup"]) == want
    size = {i: len(WORD.findall(t or "")) for i, t in want}
    mixed = Counter()
    for r in out["mixing"]:
        mixed[r[0]] += len(WORD.findall(r[1]))
    assert sum(mixed.values()) == pytest.approx(1.5 * sum(size.values()), abs=4)
    assert all(n <= 2 * size[i] for i, n in mixed.items())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = Counter((r[0], len(tok.encode(r[1], add_special_tokens=False).ids) + 1) for r in out["mixing"])
    total, seqs = Counter(), defaultdict(list)
    for doc_id, piece, start, length, _, seq, offset in out["packing"]:
        total[doc_id] += length
        seqs[seq].append((offset, length))
    want = Counter()
    for (i, n), k in ids.items():
        want[i] += n * k
    assert total == want
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024


def test_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
