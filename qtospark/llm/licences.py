"""Licence scan of paragraphs by a trained n-gram classifier with template confirmation.

The classifier is fitted on the driver from the templates below, whose number is fixed.
Scanning uses DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Usual wordings by licence family.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
        "spdx license identifier mit",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "the software is provided as is and the author disclaims all warranties with regard to this software",
        "licensed under the isc license",
        "spdx license identifier isc",
    ],
    "apache": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "released under the apache license 2.0",
        "spdx license identifier apache 2.0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty",
        "released under the gnu general public license",
        "spdx license identifier gpl 2.0",
        "spdx license identifier gpl 3.0",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "spdx license identifier lgpl 2.1",
        "spdx license identifier lgpl 3.0",
    ],
    "agpl": [
        "licensed under the gnu affero general public license",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "spdx license identifier agpl 3.0",
    ],
    "gfdl": [
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "spdx license identifier gfdl 1.3",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "spdx license identifier mpl 2.0",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "licensed under the eclipse public license version 2.0",
        "spdx license identifier epl 2.0",
    ],
    "cddl": [
        "the contents of this file are subject to the terms of the common development and distribution license",
        "spdx license identifier cddl 1.0",
    ],
    "eupl": [
        "licensed under the european union public licence version 1.2",
        "spdx license identifier eupl 1.2",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
        "licensed under the bsd 3 clause license",
        "released under the bsd license",
        "spdx license identifier bsd 3 clause",
        "spdx license identifier bsd 2 clause",
    ],
    "boost": [
        "distributed under the boost software license version 1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
        "spdx license identifier bsl 1.0",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "spdx license identifier zlib",
    ],
    "artistic": [
        "licensed under the artistic license 2.0",
        "spdx license identifier artistic 2.0",
    ],
    "ofl": [
        "this font software is licensed under the sil open font license version 1.1",
        "spdx license identifier ofl 1.1",
    ],
    "odbl": [
        "made available under the open database license",
    ],
    "wtfpl": [
        "do what the fuck you want to public license",
        "spdx license identifier wtfpl",
    ],
    "cc-by": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4.0",
        "licensed under a creative commons attribution noncommercial 4.0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4.0",
        "licensed under a creative commons attribution sharealike 4.0 international license",
    ],
    "cc-by-nd": [
        "licensed under cc by nd 4.0",
        "licensed under a creative commons attribution noderivatives 4.0 international license",
    ],
    "cc0": [
        "released under cc0 1.0 public domain dedication",
        "this is free and unencumbered software released into the public domain",
        "spdx license identifier cc0 1.0",
    ],
    "proprietary": [
        "all rights reserved unauthorized copying of this file is strictly prohibited",
        "copyright all rights reserved proprietary and confidential",
    ],
}
#: Sentences that use such words without granting a licence.
OTHERS = [
    "the driver lost his license last year", "you need a license to fish here", "a license plate was found",
    "copyright law is taught in the second year", "the copyright debate went on", "he asked for permission to leave",
    "permission denied while opening the file", "the warranty covers two years", "the license fee was raised",
    "a pilot license costs money", "the licensed electrician came", "the software license server is down",
    "she works under license in germany", "public domain films are shown", "the apache helicopter landed",
    "gnu antelopes graze on the plain", "the license agreement was signed by both", "redistribution of income is debated",
    "the software is provided by a vendor in ohio", "any person obtaining a copy of the key must sign for it",
    "the open database of birds was made available under pressure", "an eclipse of the sun drew the public",
    "the terms of the general agreement were subject to debate", "a font that is easy to read in all sizes",
]
#: Everyday words; a feature must hold another word.
COMMON = set("a all an and any are as at be but by do following for form from he his in including into is it its last list made may must new no not of on or other she that the this to two under up use version was were which will with without work works you".split())
NONE = "unknown"
MIN_PROBABILITY, MIN_TEMPLATE = 0.5, 0.6
#: Words put around the templates for the fit.
FILLER = "the of and to in a for with text data page about more work new".split()


def _grams(words: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(words[i:i + n]) for n in sizes for i in range(len(words) - n + 1)}


def needed_words() -> list[str]:
    """Words of which every paragraph that a template can confirm holds at least one.

    Of each template so many words are named, the longest first, that the three-word runs without any of them fall
    short of ``MIN_TEMPLATE``.  A paragraph without these words therefore ends without a licence whatever
    the classifier says of it.
    """
    out: list[str] = []
    for t in (t for ts in TEMPLATES.values() for t in ts):
        runs, all_runs = [r.split() for r in _grams(t.split(), (3,))], len(_grams(t.split(), (3,)))
        # never a word with a digit or point, since the text search sees those before words are parted
        free = sorted({w for w in t.split() if w.isalpha() and w.isascii()}, key=lambda w: (w not in out, w in COMMON, -len(w), w))
        for w in free:
            if len(runs) < MIN_TEMPLATE * all_runs:
                break
            left = [r for r in runs if w not in r]
            if len(left) < len(runs):
                runs = left
                out += [w] if w not in out else []
    return out


def _examples() -> list[tuple[str, list[str]]]:
    """Templates whole, and in halves with a word lost, among other words; other sentences."""
    rng = np.random.default_rng(1)
    out: list[tuple[str, list[str]]] = []
    for family, texts in [*TEMPLATES.items(), (NONE, OTHERS)]:
        for t in texts:
            w = t.split()
            for k in range(4):
                v = [x for x in w if k == 0 or rng.random() > 0.08]
                around = [list(rng.choice(FILLER, rng.integers(0, 6))) for _ in range(2)] if k else [[], []]
                out.append((family, [*around[0], *v, *around[1]]))
    out += [(NONE, list(rng.choice([*FILLER, "license", "licensed", "copyright", "public"], 8))) for _ in range(40)]
    return out


class Classifier:
    """Softmax regression on n-grams of templates and other sentences that hold a word beyond everyday ones,
    with a temperature fitted on examples that the first fit has not seen."""

    def __init__(self) -> None:
        data = _examples()
        self.families = [*TEMPLATES, NONE]
        texts = [t.split() for ts in [*TEMPLATES.values(), OTHERS] for t in ts]
        self.grams = sorted({g for w in texts for g in _grams(w) if not COMMON.issuperset(g.split())})
        at = {g: i for i, g in enumerate(self.grams)}
        x = np.zeros((len(data), len(self.grams)))
        for i, (_, w) in enumerate(data):
            x[i, [at[g] for g in _grams(w) if g in at]] = 1
        y = np.array([self.families.index(f) for f, _ in data])
        even = np.arange(len(data)) % 2 == 0
        w, b = self._fit(x[even], y[even])
        z = x[~even] @ w + b
        loss = {t: -self._log_soft(z / t)[np.arange((~even).sum()), y[~even]].mean() for t in np.arange(0.3, 3.01, 0.1)}
        self.temperature = float(min(loss, key=loss.get))
        w, b = self._fit(x, y)
        self.weights, self.bias = w / self.temperature, b / self.temperature

    @staticmethod
    def _log_soft(z: np.ndarray) -> np.ndarray:
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
        goal = np.eye(len(self.families))[y]
        w, b = np.zeros((x.shape[1], goal.shape[1])), np.zeros(goal.shape[1])
        for _ in range(steps):
            e = (np.exp(self._log_soft(x @ w + b)) - goal) / len(y)
            w -= 2.0 * (x.T @ e + 1e-4 * w)
            b -= 2.0 * e.sum(axis=0)
        return w, b


def _words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})", " "))
    return F.split(clean, " +")


def _ngrams(w: str) -> str:
    one = "transform(sequence(0, greatest(size({w}) - {n}, 0)), i -> array_join(slice({w}, i + 1, {n}), ' '))"
    return "array_distinct(concat(" + ", ".join(one.format(w=w, n=n) for n in (1, 2, 3)) + "))"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, paragraph, family, probability, template``: paragraphs that state a licence."""
    return _found(_candidates(docs, id_col, text_col)).select("doc_id", "paragraph", "family", "probability", "template")


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row, doc_id, _p``: every row with a key of its own and the numbered paragraphs that a template can confirm.

    Written once, so that keys stay the same; texts are not read again.
    """
    # short words only as whole words; "_" parts words here as it does in _words
    may = "|".join(w if len(w) > 4 else f"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)" for w in needed_words())
    t = F.col(text_col)
    parts = F.transform(F.split(t, r"\n[\x20\x09-\x0D]*\n"), lambda p, i: F.struct(i.cast("int").alias("paragraph"), p.alias("text")))
    some = F.when(F.lower(t).rlike(may), F.filter(parts, lambda p: F.lower(p["text"]).rlike(may)))
    return Scratch(docs.sparkSession).put(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), some.alias("_p")))


def _found(rows: DataFrame) -> DataFrame:
    """Licence paragraphs of the rows of ``_candidates``.

    Paragraphs are parted by blank lines.  A prediction stands when its probability reaches one half and a template of its
    family shares 60 % of its three-word runs with the paragraph; families that tie go by the order of ``TEMPLATES``.
    Every paragraph is judged that a template can confirm (see ``needed_words``); the others cannot end in a licence.
    Null and empty texts have no paragraph; every row is a document of its own, rows that share an id or
    have none included, and repeated rows give repeated results; texts of any length are read whole; an empty table gives no rows.
    """
    spark = rows.sparkSession
    c = Classifier()
    k = len(c.families)
    table = spark.createDataFrame(
        [(g, [float(v) for v in c.weights[i]]) for i, g in enumerate(c.grams)], "gram string, w array<double>")
    forms = spark.createDataFrame(
        [(f, i, g, len(_grams(t.split(), (3,)))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for g in _grams(t.split(), (3,))],
        "family string, form int, gram string, form_size int")
    p = rows.select("_row", "doc_id", F.explode("_p").alias("_p"))
    p = p.select("_row", "doc_id", "_p.paragraph", _words(F.col("_p.text")).alias("_w"))
    grams = p.select("_row", "doc_id", "paragraph", F.explode(F.expr(_ngrams("_w"))).alias("gram"))
    key = ["_row", "doc_id", "paragraph"]
    hit = grams.join(F.broadcast(table), "gram")  # as many rows as the templates have n-grams
    sums = hit.groupBy(*key).agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)])
    z = [F.col(f"z{i}") + float(c.bias[i]) for i in range(k)]
    sums = sums.withColumn("_top", F.greatest(*z))
    total = sum((F.exp(v - F.col("_top")) for v in z[1:]), F.exp(z[0] - F.col("_top")))
    family = F.coalesce(*[F.when(v == F.col("_top"), F.lit(f)) for v, f in zip(z, c.families)])
    best = sums.select(*key, family.alias("family"), (F.lit(1.0) / total).alias("probability"))
    best = best.filter((F.col("family") != NONE) & (F.col("probability") >= MIN_PROBABILITY))
    like = grams.join(F.broadcast(forms), "gram").groupBy("_row", "paragraph", "family", "form").agg(
        (F.count(F.lit(1)) / F.max("form_size")).alias("_share"))
    like = like.groupBy("_row", "paragraph", "family").agg(F.max("_share").alias("template"))
    return best.join(like.filter(F.col("template") >= MIN_TEMPLATE), ["_row", "paragraph", "family"])


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence paragraphs, families and least probability."""
    rows = _candidates(documents(spark, sf_dir), "doc_id", "text")
    found = _found(rows).groupBy("_row").agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.round(F.min("probability"), 6).alias("probability"), F.round(F.min("template"), 6).alias("template"))
    return rows.select("_row", "doc_id").join(found, "_row", "left").select(
        "doc_id", F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"),
        F.coalesce("families", F.lit("")).alias("families"), "probability", "template")
