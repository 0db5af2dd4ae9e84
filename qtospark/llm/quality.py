"""Quality rules as a ledger of failure bits and measurements, with versioned policies.

Only DataFrame functions: every rule is evaluated once per document, and policies and
ablations read nothing but the bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, documents

#: Characters counted as symbols, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50

#: Rules by bit.  Limits compare whole numbers, so that every engine decides alike.
RULES: list[tuple[str, str]] = [
    ("few_words", f"n_words < {MIN_WORDS}"),
    ("repeated_windows", f"100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("long_words", "word_chars > 15 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policy versions: a document fails when one of these bits is set.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["long_words"] | BIT["short_words"],
}


def _words(text: Column) -> Column:
    """Words as an array; null and blank texts have none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _repeat_words(words: str, w: str = "v") -> str:
    """Words covered by three-word windows that occur twice or more.

    Windows become pairs of digest and place in one sorted array; neighbours with an equal
    digest are repeats.  Places of repeats, in order, add 3 words each, less the overlap with the place
    before.  Sorting keeps very long texts at n log n.
    """
    grams = (
        f"sort_array(transform(sequence(1, size({w}) - 2), i -> struct("
        f"xxhash64(element_at({w}, i), element_at({w}, i + 1), element_at({w}, i + 2)) AS g, i AS i)))"
    )
    twice = (
        "filter(s, (x, k) -> (k > 0 AND element_at(s, greatest(k, 1)).g = x.g) "
        "OR (k < size(s) - 1 AND element_at(s, least(k + 2, size(s))).g = x.g))"
    )
    covered = (
        "aggregate(array_sort(transform(r, x -> x.i)), named_struct('last', -9, 'n', 0L), "
        "(a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)"
    )
    inner = f"aggregate(array({grams}), 0L, (z, s) -> aggregate(array({twice}), 0L, (y, r) -> {covered}))"
    # a lambda variable holds the words, or each place would split the text again
    return f"aggregate(array({words}), 0L, (x0, {w}) -> CASE WHEN size({w}) < 4 THEN 0L ELSE {inner} END)"


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failures``.

    ``failures`` has the bit of every failed rule.  A null text counts as empty: no words,
    fails ``few_words``.  Every row is judged by itself, so repeated rows and ties need no
    rule; an empty table gives an empty ledger; other columns are ignored.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("_t")).withColumn("_w", _words(F.col("_t")))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    m = d.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_w")).cast("long").alias("n_repeat_words"),
    )
    bits = F.lit(0)
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule), BIT[name]).otherwise(0))
    return m.withColumn("failures", bits)


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``kept``: none of the policy's bits is set."""
    return led.withColumn("kept", F.col("failures").bitwiseAND(POLICIES[policy]) == 0)


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule does in a policy: ``rule, fails, fails_alone, kept_without``.

    One pass over the bits: documents are counted per bit pattern (64 at most), and each rule's
    figures are sums over patterns.
    """
    mask = POLICIES[policy]
    pat = led.groupBy(F.col("failures").bitwiseAND(mask).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n, _ in RULES if BIT[n] & mask]))
    p = pat.select("b", "n", rules.alias("r")).select("b", "n", "r.rule", "r.bit")
    hit = F.col("b").bitwiseAND(F.col("bit")) != 0
    return p.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("b") == F.col("bit"), F.col("n")).otherwise(0)).alias("fails_alone"),
        F.sum(F.when(F.col("b").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(documents(spark, sf_dir)))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(BASE) != 0).alias("base_failed"), "kept", "failures")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, struct_pack(a := w[i], b := w[i+1], c := w[i+2]) AS g
      FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
        + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars > 15 * n_words)::INT
        + 32 * (word_chars < 2 * n_words)::INT)::INT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
       failures = 0 AS kept, failures FROM b
"""
