"""Small documents with every awkward case: nulls, blanks, copies, long texts, clashing columns."""

import random

KINDS = "doc_id long, text string, lang string, source string, n_chars long, size long, _t string, vocab string, score double"


def rows(extra=()):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = text(120)
    texts = [
        None, "", "   \n\t ", "The quick  brown fox\n\n jumps", "The quick  brown fox\n\n jumps", text(30_000),
        "<|endoftext|> x <s> </s> a<|endoftext|>b", "a" * 5000, "x b　c \n  d  ", " lead and trail ", base, base,
        base.replace(" ", "  ", 1), base + " tail", "\r\n".join([text(9)] * 8), "one", "one two three", "can't we'll\tgo", *extra,
    ]
    out = [(i, t, "en", ["a", "b", None, ""][i % 4], 0, 7, "x", "y", 0.5) for i, t in enumerate(texts)]
    out += [(2000 + i, text(rng.randint(1, 1500)), None, "hot", 1, None, None, None, None) for i in range(60)]
    return [*out, out[3], out[10], (None, "no id here", None, None, None, None, None, None, None)]


def table(spark, extra=()):
    return spark.createDataFrame(rows(extra), KINDS)


def empty(spark):
    return spark.createDataFrame([], KINDS)
