"""Personal data: formats against the plain patterns, the field against brute force and held-out rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from qtospark.llm import pii

from .data import empty, rows, table

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["a@.", "a1@.-", "12.", "0123456789 -", "+1 ().-2", "1.2+ -@a5", "é@a.b 1+"])
def test_formats(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text
    numbers = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+43 (664) 123-45 67", "255.255.255.0255", "256.1.1.1", "1.2.3.4.5.6.7.8"]
    for _ in range(300):
        text = rng.choice(["", "x ", "é"]).join(rng.choice([*numbers, *letters]) for _ in range(8))
        assert pii.base_spans(text) == brute(text), text


def test_formats_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000, "1." * 200_000, "+" * 400_000, "a@" * 200_000, "+1" + " " * 400_000, "@" + "a" * 400_000):
        pii.base_spans(text)


def test_viterbi():
    rng = np.random.default_rng(1)
    for n in (1, 5, 63, 64, 65, 200, 700):
        e, first = rng.normal(size=(n, 4)), rng.random(n) < 0.1
        first[0] = True
        follow, start = rng.normal(size=(4, 4)) * 2, rng.normal(size=4)
        got = pii.viterbi(e, first, follow, start)
        cuts = [*np.flatnonzero(first), n]
        for i, j in zip(cuts, cuts[1:]):
            v, back = start + e[i], []
            for t in range(i + 1, j):
                c = v[:, None] + follow
                back.append(c.argmax(0))
                v = c.max(0) + e[t]
            path = [int(v.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert path[::-1] == got[i:j].tolist()
    e, follow, start = rng.normal(size=(6, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    score = lambda p: start[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(follow[a, b] for a, b in zip(p, p[1:]))
    assert tuple(pii.viterbi(e, np.arange(6) == 0, follow, start)) == max(itertools.product(range(4), repeat=6), key=score)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled(spark))


def found(field, text):
    labels, _ = pii.label_words(field, pa.array([text]))
    return {(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, labels, pii.base_spans(text))}


def test_held_out_rows():
    """Fitted on two thirds of the labelled rows, the field finds the spans of the rest."""
    data = pii.labelled_rows()
    held = [zlib.crc32(t.encode()) % 3 == 1 for t, _ in data]
    model = pii.fit([r for r, h in zip(data, held) if not h])
    hits = misses = false = 0
    for text, spans in (r for r, h in zip(data, held) if h):
        got, want = found(model, text), {(k, text[s:e].strip("()")) for k, s, e in spans}
        got = {(k, t.strip("()")) for k, t in got}
        hits, misses, false = hits + len(got & want), misses + len(want - got), false + len(got - want)
    assert hits / (hits + misses) > 0.9 and hits / (hits + false) > 0.9


def test_other_words(field):
    assert found(field, "Please call Mr Robert Yeltan, tel 0664 / 123 4567, today.") >= {("name", "Robert Yeltan")}
    assert ("email", "karl dot nesh at example dot org") in found(field, "You reach us under karl dot nesh at example dot org or by post.")
    assert ("phone", "(512) 555-0199") in found(field, "the office (512) 555-0199 is open")
    for plain in ("The Thing of Reesh and the Ouren. Onder the hat.", "THE OF AND IN THAT!! IT", "in 1999 and 2004, version 2.0.1", "meet me at noon at the gate"):
        assert found(field, plain) == set()


def test_rows(spark, field):
    extra = ("Mail x@y.zz, 10.0.0.1; 4111 1111 1111 1111 é +43 664 1234567 Dr. Maria Huber.", "a@b.c," * 3000, "1 " * 50_000)
    got = {r["doc_id"]: r for r in pii.find(table(spark, extra).filter("doc_id is not null"), field).collect()}
    want = {r[0]: r[1] or "" for r in rows(extra) if r[0] is not None}
    assert set(got) == set(want)
    for i, text in want.items():
        base = brute(text)
        assert [got[i][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(pii.report(base).encode()).hexdigest()
        assert set(filter(None, pii.report(base).split(","))) <= set(got[i]["spans"].split(","))
    assert "name:" in got[18]["spans"] and got[0]["spans"] == ""
    assert pii.find(table(spark, extra), field).count() == len(rows(extra)) and pii.find(empty(spark), field).count() == 0


def test_labels_do_not_depend_on_the_batch(field):
    texts = [r[1] or "" for r in rows()] + [t for t, _ in pii.labelled_rows()[:40]]
    labels, offs = pii.label_words(field, pa.array(texts))
    for i, t in enumerate(texts):
        alone, _ = pii.label_words(field, pa.array([t]))
        assert alone.tolist() == labels[offs[i]:offs[i + 1]].tolist()


def test_documents(spark, field):
    """On the given documents all fixed formats are found, and the field marks few others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = pii.find(docs, field).collect()
    extra = 0
    for r in got:
        base = brute(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.report(base).encode()).hexdigest()
        extra += len(list(filter(None, r["spans"].split(",")))) - len(base)
    assert extra < 0.05 * len(got)
