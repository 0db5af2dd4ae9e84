"""Merkle manifest of a dataset, its proofs exchanged between partitions like a butterfly.

Rows are leaves.  Per group they are numbered in order and dealt to blocks of ``FANOUT ** LEVELS``
leaves; a block hashes its own subtree.  Then blocks swap roots round by round: in round ``r`` the
blocks that differ only in digit ``r`` of their number (to base ``FANOUT``) meet, and each of them hashes
the common ancestor and notes the roots of the others as its next piece of proof.  After the last
round every block holds the whole upper proof, and no pass back down is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Fixed values of the contract: nodes of a run, and the upper-case letters that tampering lowers.
FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block holds FANOUT ** LEVELS leaves.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    """Digest of a row: every value as ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def fold(start: Column, proof: Column) -> Column:
    """Root that follows from a leaf and its proof."""
    return F.aggregate(proof, start, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, from left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def numbered(store: Scratch, df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``idx`` (from 0, in ``order``) and ``size`` of the row's ``group``.

    Rows are range-sorted and written with their partition; only counts by group and partition
    meet, so a group of any size spans as many tasks as it needs.
    """
    d = store.put(df.repartitionByRange(group, *order).withColumn("_pid", F.spark_partition_id()))
    counts = d.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group)
    offs = counts.select(group, "_pid", (F.sum("_c").over(w.orderBy("_pid")) - F.col("_c")).alias("_off"), F.sum("_c").over(w).alias("size"))
    local = F.row_number().over(Window.partitionBy(group, "_pid").orderBy(*order)) - 1
    return d.withColumn("_l", local).join(offs, [group, "_pid"]).withColumn("idx", F.col("_l") + F.col("_off")).drop("_l", "_off", "_pid")


def _runs(nodes: Column) -> Column:
    """Parents of a list of nodes."""
    last = F.floor((F.size(nodes) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def _others(nodes: Column, at: Column) -> Column:
    """Siblings of the node at place ``at`` of a list: those before it and those after it in its run."""
    first = (F.floor(at / FANOUT) * FANOUT).cast("int")
    return F.struct(
        F.array_join(F.slice(nodes, first + 1, at - first), "").alias("before"),
        F.array_join(F.slice(nodes, at + 2, first + FANOUT - 1 - at), "").alias("after"))


def blocks(store: Scratch, leaves: DataFrame, group: str, digest: str, carry: list[str], levels: int = LEVELS) -> DataFrame:
    """``group, block, size, items, level_1 .., node``: the subtree of every block of leaves.

    ``leaves`` has ``idx`` and ``size``; ``items`` are the block's leaves in order with the
    columns ``carry``, at most ``FANOUT ** levels`` of them.  A level is built while more than one node of
    the group remains; above, the list stays as it is.
    """
    width = FANOUT ** levels
    at = F.floor(F.col("idx") / width).alias("block")
    item = F.struct("idx", F.col(digest).alias("digest"), *carry)
    b = leaves.select(group, at, "size", item.alias("item")).groupBy(group, "block").agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list("item")).alias("items"))
    below = F.col("items.digest")
    for k in range(levels):
        b = b.withColumn(f"level_{k + 1}", F.when(F.col("size") > FANOUT ** k, _runs(below)).otherwise(below))
        below = F.col(f"level_{k + 1}")
    return store.put(b.withColumn("node", below[0]))


def exchange(store: Scratch, state: DataFrame, group: str, rnd: int) -> DataFrame:
    """One round: ``group, block, n_blocks, node, path`` one level up, for all blocks.

    A run of children that reach ``FANOUT ** rnd`` blocks each meets once for every place in a child, so
    a key holds at most ``FANOUT`` nodes.  The last child may be short: its blocks also stand
    in for the places that it lacks.
    """
    reach = FANOUT ** rnd
    done = state.filter(F.col("n_blocks") <= reach)
    s = state.filter(F.col("n_blocks") > reach)
    s = s.withColumn("child", F.floor(F.col("block") / reach)).withColumn("place", F.col("block") % reach)
    s = s.withColumn("held", F.least(F.lit(reach), F.col("n_blocks") - F.col("child") * reach))
    s = s.withColumn("wide", F.when(F.col("child") % FANOUT == 0, F.col("held")).otherwise(F.lit(reach)).cast("long"))
    s = s.withColumn("slot", F.explode(F.sequence(F.col("place"), F.col("wide") - 1, F.col("held"))))
    own = F.col("slot") == F.col("place")
    sent = F.struct(
        F.col("child"), F.col("node"), F.when(own, F.col("block")).alias("block"),
        F.col("n_blocks"), F.when(own, F.col("path")).alias("path"))
    met = s.groupBy(group, F.floor(F.col("child") / FANOUT).alias("parent"), "slot").agg(F.collect_list(sent).alias("met"))
    met = met.withColumn("met", F.array_sort("met", lambda a, b: (a["child"] - b["child"]).cast("int")))
    met = met.withColumn("nodes", F.col("met.node")).withColumn("up", F.sha2(F.array_join("nodes", ""), 256))
    got = met.select(group, "nodes", "up", F.posexplode("met").alias("at", "m")).filter(F.col("m.block").isNotNull())
    step = got.select(
        group, F.col("m.block").alias("block"), F.col("m.n_blocks").alias("n_blocks"), F.col("up").alias("node"),
        F.concat("m.path", F.array(_others(F.col("nodes"), F.col("at")))).alias("path"))
    return store.put(step.unionByName(done.select(*step.columns)))


def climb(store: Scratch, tree: DataFrame, group: str, levels: int = LEVELS) -> DataFrame:
    """``group, block, root, path``: every block with the proof above it, after all rounds."""
    width = FANOUT ** levels
    none = F.array().cast("array<struct<before:string,after:string>>")
    state = tree.select(group, "block", F.floor((F.col("size") + (width - 1)) / width).alias("n_blocks"), "node", none.alias("path"))
    most, rnd = state.agg(F.max("n_blocks")).first()[0] or 0, 0
    while most > FANOUT ** rnd:
        state = exchange(store, state, group, rnd)
        rnd += 1
    return state.select(group, "block", F.col("node").alias("root"), "path")


def spread(tree: DataFrame, upper: DataFrame, group: str, carry: list[str], keep: list[str], levels: int = LEVELS) -> DataFrame:
    """``group, leaf, carry.., keep.., proof``: a row for every leaf, its proof up to the end of ``path``."""
    t = tree.join(upper, [group, "block"])
    lists = [F.col("items.digest"), *(F.col(f"level_{k + 1}") for k in range(levels))]

    def one(item: Column) -> Column:
        place = (item["idx"] % (FANOUT ** levels)).cast("int")
        inner = []
        for k in range(levels):
            at = F.floor(place / (FANOUT ** k)).cast("int")
            inner.append(F.when(F.col("size") > FANOUT ** k, F.array(_others(lists[k], at))).otherwise(
                F.array().cast("array<struct<before:string,after:string>>")))
        return F.struct(
            item["digest"].alias("leaf"), *(item[c].alias(c) for c in carry), F.concat(*inner, F.col("path")).alias("proof"))

    return t.select(group, *keep, F.inline(F.transform("items", one)))


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
    carry: tuple[str, ...] = (), levels: int = LEVELS,
) -> DataFrame:
    """``id, carry.., leaf, subroot, root, proof`` of every row; ``proof`` lists the siblings before and
    after the node, level by level, from the leaf via its group's root to the root.

    Leaves of a group ascend by id, null first; rows that share an id ascend by leaf, and equal rows are
    leaves of their own.  Null is a group of its own and the first; groups follow bytewise.  Texts of any
    length are hashed where they are read and not moved.  An empty table gives no rows.  Other
    columns are not read.
    """
    store = Scratch(docs.sparkSession)
    d = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("s"), F.col(group_col)), F.lit("")).alias("_g"),
        leaf(*(F.col(c) for c in fields)).alias("_leaf"), *(F.col(c).alias(f"_carry_{c}") for c in carry),
    ).withColumn("_row", F.monotonically_increasing_id())
    names = ["_id", *(f"_carry_{c}" for c in carry)]
    d = numbered(store, store.put(d), "_g", ["_id", "_leaf", "_row"])
    tree = blocks(store, d, "_g", "_leaf", names, levels)
    upper = climb(store, tree, "_g", levels)
    # the groups' roots are the leaves of a tree of their own
    tops = upper.filter("block = 0").select("_g", F.col("root").alias("subroot"), F.lit("").alias("_all"))
    tops = numbered(store, tops, "_all", ["_g"])
    crown = blocks(store, tops, "_all", "subroot", ["_g"], levels)
    top = spread(crown, climb(store, crown, "_all", levels), "_all", ["_g"], ["root"], levels)
    top = store.put(top.select("_g", F.col("leaf").alias("subroot"), "root", F.col("proof").alias("_over")))
    upper = upper.drop("root").join(top, "_g").withColumn("path", F.concat("path", "_over")).drop("_over")
    out = spread(tree, upper, "_g", names, ["subroot", "root"], levels)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_carry_{c}").alias(c) for c in carry), "leaf", "subroot", "root", "proof")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the documents, and what a check of tampered copies of a third of them finds.

    A null id is never tampered with; a tampered text without upper-case letters still verifies.
    """
    d = documents(spark, sf_dir)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = leaf(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS))
    d = d.withColumn("changed", F.when(chosen, lowered))
    m = manifest(d, carry=("changed",))
    m = m.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return m.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _encoded(field: str, value: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN '-' ELSE strlen({value})::VARCHAR || ':' || {value} END"


_LEAF = reduce(lambda a, b: f"{a} || {b}", (_encoded(c, f"{c}::VARCHAR") for c in FIELDS))
_CHANGED = reduce(lambda a, b: f"{a} || {b}", (
    _encoded(c, f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else f"{c}::VARCHAR") for c in FIELDS))

#: The remainder of 1 bit after the other is divided by the polynomial of crc32.
_BIT = "list_reduce(list_prepend({x}, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: " + _BIT.format(x="xor(a, b)") + "), 4294967295)"

ORACLE = f"""
WITH RECURSIVE leafs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({_LEAF}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN sha256({_CHANGED}) END AS changed
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leafs),
tree AS (
  SELECT lang, 0 AS lvl, idx, leaf AS h, n FROM ranked
  UNION ALL
  SELECT lang, lvl + 1, idx // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)), (n + {FANOUT - 1}) // {FANOUT}
  FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // {FANOUT}, n),
subs AS (SELECT lang, h AS subroot FROM tree WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, lang, subroot AS h, count(*) OVER () AS n FROM subs),
crown AS (
  SELECT lvl, idx, h, n FROM tops
  UNION ALL
  SELECT lvl + 1, idx // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)), (n + {FANOUT - 1}) // {FANOUT}
  FROM crown WHERE n > 1 GROUP BY lvl, idx // {FANOUT}, n),
side AS (
  SELECT lang, lvl, idx,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY lang, lvl, idx // {FANOUT} ORDER BY idx)),
over AS (
  SELECT lvl, idx,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM crown WHERE n > 1 WINDOW w AS (PARTITION BY lvl, idx // {FANOUT} ORDER BY idx)),
walk AS (
  SELECT r, lang, 0 AS lvl, idx, coalesce(changed, leaf) AS h, '' AS proof FROM ranked
  UNION ALL
  SELECT w.r, w.lang, w.lvl + 1, w.idx // {FANOUT}, sha256(s.before || w.h || s.after), w.proof || s.before || s.after
  FROM walk w JOIN side s ON w.lang IS NOT DISTINCT FROM s.lang AND w.lvl = s.lvl AND w.idx = s.idx),
ended AS (SELECT r, arg_max(lang, lvl) AS lang, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM walk GROUP BY r),
walk2 AS (
  SELECT e.r, 0 AS lvl, t.idx, e.h, e.proof FROM ended e JOIN ranked k ON e.r = k.r JOIN tops t ON k.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT w.r, w.lvl + 1, w.idx // {FANOUT}, sha256(s.before || w.h || s.after), w.proof || s.before || s.after
  FROM walk2 w JOIN over s ON w.lvl = s.lvl AND w.idx = s.idx),
final AS (SELECT r, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM walk2 GROUP BY r)
SELECT k.doc_id, k.leaf, s.subroot, c.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = c.h AS verified
FROM ranked k JOIN subs s ON k.lang IS NOT DISTINCT FROM s.lang JOIN final f ON f.r = k.r
JOIN (SELECT h FROM crown WHERE n = 1) c ON true
"""
