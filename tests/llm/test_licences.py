"""Licence scan against a plain scan that judges every paragraph with every template."""

import math

import regex

from qtospark.llm import licences as L

from .data import empty

NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above copyright notice appears.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "boost": "Distributed under the Boost Software License, Version 1.0. (See accompanying file)",
    "bsd": "// SPDX-License-Identifier: BSD-3-Clause",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
}
CLEAN = [
    "He lost his driver license, you need permission.", "Released under the Nonsense License.", "The software is provided by our partner, as is usual.",
    "The general public has subject matter of its own; the program made useful documentation available.", "according to accepted ideas",
]


def corpus():
    texts = [*NOTICES.values(), *CLEAN]
    texts.append("First lines.\n\n" + NOTICES["mit"] + "\n \t\nOther text.\n\n" + NOTICES["gpl"])
    texts.append("\n\n".join(NOTICES.values()))
    texts.append("many words of a long text about data " * 5000 + "\n\n" + NOTICES["apache"])
    rows = [(i, t) for i, t in enumerate(texts)]
    # ids shared by different texts, repeated rows, no id, no text
    return rows + [(0, NOTICES["apache"]), (0, NOTICES["apache"]), (0, NOTICES["mit"]), (None, NOTICES["mit"]), (None, NOTICES["gpl"]), (None, None), (900, ""), (901, " \n\n ")]


def judge(c, paragraph):
    clean = regex.sub(r"[^\p{L}\p{N}.]+|\.(?!\p{N})", " ", paragraph.lower()).strip(" ")
    w = regex.split(" +", clean)
    grams = L._grams(w)
    z = c.bias + sum(c.weights[c.grams.index(g)] for g in grams if g in c.at)
    k = int(z.argmax())
    prob = 1 / sum(math.exp(v - z[k]) for v in z)
    family = c.families[k]
    if family == L.NONE or prob < L.MIN_PROBABILITY:
        return None
    share = max(len(grams & f) / len(f) for f in (L._grams(t.split(), (3,)) for t in L.TEMPLATES[family]))
    return (family, round(prob, 6), round(share, 6)) if share >= L.MIN_TEMPLATE else None


def plain(rows):
    c = L.Classifier()
    c.at = set(c.grams)
    out = []
    for i, t in rows:
        for n, p in enumerate(regex.split(r"\n[\x20\x09-\x0D]*\n", t or "")):
            v = judge(c, p)
            if v:
                out.append((i, n, *v))
    return sorted(out, key=repr)


def test_scan_equals_plain_scan(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, family string, paragraph int")
    got = sorted(((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 6), round(r["template"], 6)) for r in L.scan(df).collect()), key=repr)
    want = plain(rows)
    assert got == want
    for i, family in enumerate(NOTICES):
        assert any(g[0] == i and g[2] == family for g in got), family
    assert not [g for g in got if g[0] is not None and len(NOTICES) <= g[0] < len(NOTICES) + len(CLEAN)]
    assert sorted(g[2] for g in got if g[0] is None) == ["gpl", "mit"]
    assert L.scan(empty(spark)).count() == 0


def test_query_keeps_rows_apart(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op4_licence_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted(r["families"] for r in got if r["doc_id"] == 0) == ["apache", "apache", "mit", "mit"]
    assert sum(r["n_paragraphs"] for r in got) == len(plain(rows))


def test_needed_words_are_needed():
    need = set(L.needed_words())
    for t in (t for ts in L.TEMPLATES.values() for t in ts):
        runs = L._grams(t.split(), (3,))
        assert sum(not need & set(r.split()) for r in runs) < L.MIN_TEMPLATE * len(runs)
