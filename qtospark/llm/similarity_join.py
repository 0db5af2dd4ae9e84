"""N-gram Jaccard join by grouped prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, documents, slices, words

REGION = 0.2  # share of the hash range whose shingles are a document's prefix
COMMON = 24  # a shingle in the prefixes of more groups moves to the end of the order
SLICE = 2 << 20  # bytes of text that are split into shingles at once
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z are lower-cased.  Fewer words
    than ``size`` are one shingle, no words none."""
    vocab, codes, offs = words(pc.ascii_lower(pc.fill_null(texts, "")))
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab))[codes]
    with np.errstate(over="ignore"):
        s = np.full(max(0, len(h) - size + 1), np.uint64(size))
        for j in range(size):
            s = _mixed(s * _STEP + h[j:len(h) - size + 1 + j])
        out = []
        for lo, hi in zip(offs, offs[1:]):
            if hi - lo >= size:
                out.append(np.unique(s[lo:hi - size + 1]))
            elif hi > lo:
                v = np.array([hi - lo], np.uint64)
                for x in h[lo:hi]:
                    v = _mixed(v * _STEP + x)
                out.append(v)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _profile(size: int, region: float):
    cut = np.uint64(int(region * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            sets = shingle_sets(b.column("text"), size)
            low = [s[:np.searchsorted(s, cut)] for s in sets]
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(n, pa.int64()),
                pa.array([_number(s.tobytes()) if len(s) else None for s in sets], pa.int64()),
                pa.array([_number(k.to_bytes(8, "little"), p.tobytes()) if k else None for k, p in zip(n, low)], pa.int64()),
                pa.array([p.view(np.int64) for p in low], pa.list_(pa.int64())),
            ], ["doc_id", "n", "cid", "gid", "prefix"])

    return run


def _rest(size: int, region: float):
    cut = np.uint64(int(region * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            sets = shingle_sets(b.column("text"), size)
            keys = [_number(s.tobytes()) for s in sets]
            out = pa.RecordBatch.from_arrays([
                b.column("cid"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s[np.searchsorted(s, cut):].view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], ["gid", "n", "prefix"])  # here each set is a group of its own
            yield out.filter(pc.equal(pa.array(keys, pa.int64()), b.column("cid")))

    return run


def _whole(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            data = [s.tobytes() for s in shingle_sets(b.column("text"), size)]
            out = pa.RecordBatch.from_arrays([b.column("cid"), pa.array(data, pa.binary())], ["cid", "s"])
            yield out.filter(pc.equal(pa.array([_number(d) for d in data], pa.int64()), b.column("cid")))

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        common = []
        for x, y in zip(b.column("sx"), b.column("sy")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            common.append(int((q[np.minimum(at, len(q) - 1)] == p).sum()))
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("x", "y", "nx", "ny")], pa.array(common, pa.int64())], ["x", "y", "nx", "ny", "common"])


class JaccardJoin:
    """Links between documents whose shingle sets have a Jaccard similarity of ``num/den`` or more.

    Sets are ordered by one global order of shingles: those in the low ``REGION`` of the hash
    range first, common ones last.  Linked sets share a shingle within their first
    n - need + 1.  Documents with equal prefix (their shingles in the region) and equal size form a group;
    shingles join groups.

    1. Shingles in at most COMMON groups give group pairs, with the number shared.  A pair
       stays if what is shared, plus what common shingles and the rest could add, reaches the need.
    2. Where the prefix of a group holds too few uncommon shingles, its member sets, which may
       differ in all the rest, are joined one by one on that rest likewise.
    3. Of these, sets made almost wholly of common shingles (large groups of near copies) are
       listed by each common shingle of their prefix in the final order, the rarer ones first.  Two
       of them that share no uncommon shingle link only if, from the first one they share on, both
       have as many left as the need (``most``).

    Pairs, groups and lists are then settled among their member sets: every two members
    must end in one component or be compared.  In each round one member of a list, in later ones
    more, is compared with those of other components, at first only with the most promising; a list whose members are in one component is
    done.  So a crowd of copies costs about one comparison each, and none is left out.
    """

    def __init__(self, docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        self.store = Scratch(self.spark)
        self.size, self.num, self.den = size, num, den
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def _need(self, a: Column, b: Column) -> Column:
        """Least intersection of sets of these sizes."""
        return F.ceil((a + b) * self.num / (self.num + self.den) - 1e-9)

    def _fits(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def _postings(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Shingles in two groups or more ``(h, gid, n, c)``, and ``(gid, hot)``: common ones per group."""
        p = sets.select("gid", "n", F.explode("prefix").alias("h"))
        c = p.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        p = self.store.put(p.join(c, "h"))
        return p, p.filter(F.col("c") > COMMON).groupBy("gid").agg(F.count(F.lit(1)).alias("hot"))

    def _pairs(self, postings: DataFrame) -> DataFrame:
        """``ga, gb, na, nb, shared`` over uncommon shingles, sizes apart left out."""
        lists = postings.filter(F.col("c") <= COMMON).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "gid"))).alias("g"))
        two = F.explode(F.expr(
            "flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), "
            f"y -> x.n * {self.den} >= y.n * {self.num}), y -> struct(x.gid AS ga, y.gid AS gb, x.n AS na, y.n AS nb))))"))
        return lists.select(two.alias("p")).groupBy("p.ga", "p.gb", "p.na", "p.nb").agg(F.count(F.lit(1)).alias("shared"))

    def _texts(self, keyed: DataFrame, key: str) -> DataFrame:
        """``key, text`` for rows ``(doc_id, key)``; texts are read again.  Of rows that share an id,
        the readers keep those whose key it is."""
        return self.docs.join(keyed, "doc_id").select(key, "text")

    def components(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` of every row."""
        put, size = self.store.put, self.size
        t = put(self.docs.mapInArrow(_profile(size, REGION), "doc_id long, n long, cid long, gid long, prefix array<long>"))
        ids = put(t.select("doc_id", "n", "cid", "gid"))
        t_ids = ids.filter("n > 0")
        # of a repeated id all texts are read; where there is none, what is read needs no comparison with the rest
        repeated = not ids.groupBy("doc_id").count().filter("count > 1").isEmpty()
        once = lambda df, key: df.dropDuplicates([key]) if repeated else df
        reps = t.filter("n > 0").groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        reps = put(reps)
        self.store.drop(t)
        post, hot = self._postings(reps)
        info = put(reps.select("gid", "n", F.size("prefix").alias("r")).join(hot, "gid", "left").fillna(0, ["hot"]))
        side = lambda s: info.select(F.col("gid").alias(f"g{s}"), F.col("r").alias(f"r{s}"), F.col("hot").alias(f"h{s}"))
        na, nb = F.col("na"), F.col("nb")
        rest = F.least(na - F.col("ra"), nb - F.col("rb"))
        pairs = self._pairs(post).join(side("a"), "ga").join(side("b"), "gb")
        pairs = pairs.filter(F.col("shared") + F.least("ha", "hb") + rest >= self._need(na, nb))
        pairs = pairs.select("ga", "gb", "na", "nb", "shared")
        least = F.col("n") - F.ceil(F.col("n") * self.num / self.den - 1e-9) + 1  # length of a prefix
        members = put(t_ids.groupBy("gid", "cid", "n").agg(F.min("doc_id").alias("doc_id")))
        short = put(members.join(info.filter(F.col("r") - F.col("hot") < least).select("gid", "r", "hot"), "gid"))
        # the second part of the order, for every set of the groups with too few uncommon shingles in the first
        more = put(once(self._texts(short.select("doc_id", "cid"), "cid").mapInArrow(_rest(size, REGION), "gid long, n long, prefix array<long>"), "gid"))
        post2, hot2 = self._postings(more)
        short = put(short.join(hot2.select(F.col("gid").alias("cid"), F.col("hot").alias("hot2")), "cid", "left").fillna(0, ["hot2"]))
        side2 = lambda s: short.select(F.col("cid").alias(f"g{s}"), F.col("r").alias(f"r{s}"), F.col("hot2").alias(f"h{s}"))
        pairs2 = self._pairs(post2).join(side2("a"), "ga").join(side2("b"), "gb")
        pairs2 = pairs2.filter(F.least("ra", "rb") + F.col("shared") + F.least("ha", "hb") >= self._need(na, nb))
        # the last part: common shingles, for sets that have hardly any other
        last = short.select("gid", "cid", "n", (least - (F.col("r") - F.col("hot")) - (F.col("n") - F.col("r") - F.col("hot2"))).alias("k")).filter("k > 0")
        often = lambda p, key: p.filter(F.col("c") > COMMON).select(F.col("gid").alias(key), F.struct("c", "h").alias("h"))
        last = last.join(often(post, "gid"), "gid").select("cid", "n", "k", "h").unionByName(last.join(often(post2, "cid"), "cid").select("cid", "n", "k", "h"))
        order = F.array_sort(F.collect_list("h"))
        lists = last.groupBy("cid", "n", "k").agg(order.alias("hs")).select(
            "cid", "n", F.size("hs").alias("_all"), F.posexplode(F.slice("hs", F.lit(1), F.col("k").cast("int"))).alias("_at", "h"))
        lists = lists.select("cid", "n", (F.col("_all") - F.col("_at")).cast("long").alias("most"), "h.h")
        # groups without an uncommon shingle have been joined set by set; other sets of equal size may be unable to link
        crowd = members.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("_m")).filter((F.col("_m") > 1) & (self._need(F.col("n"), F.col("n")) < F.col("n")))
        crowd = crowd.join(info.filter("r > hot"), "gid", "left_semi").select("gid")
        score = (F.col("shared") / F.col("na")).alias("score")
        two = pairs.select(F.xxhash64("ga", "gb").alias("list"), score, F.explode(F.array("ga", "gb")).alias("gid"))
        entries = two.unionByName(crowd.select(F.xxhash64(F.lit("g"), "gid").alias("list"), F.lit(2.0).alias("score"), "gid"))
        entries = entries.join(members, "gid").select("list", "score", "cid", "n")
        both = F.inline(F.array(F.struct(F.col("ga").alias("cid"), na.alias("n")), F.struct(F.col("gb").alias("cid"), nb.alias("n"))))
        entries = entries.unionByName(pairs2.select(F.xxhash64(F.lit("s"), "ga", "gb").alias("list"), score, both))
        lists = lists.select(F.xxhash64(F.lit("h"), "h").alias("list"), F.lit(1.0).alias("score"), "cid", "n", "most")
        entries = put(entries.withColumn("most", F.col("n")).unionByName(lists))
        used = entries.select("cid").distinct().join(t_ids.groupBy("cid").agg(F.min("doc_id").alias("doc_id")), "cid")
        sets = put(once(self._texts(used.select("doc_id", "cid"), "cid").mapInArrow(_whole(size), "cid long, s binary"), "cid"))
        self.store.drop(post, post2, reps, more, info, members, short)
        comp = self._settle(entries, sets)
        roots = ids.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
        roots = roots.withColumn("_root", F.coalesce("component", "cid"))
        least_id = roots.filter("_root IS NOT NULL").groupBy("_root").agg(F.min("doc_id").alias("_least"))
        return roots.join(least_id, "_root", "left").select(
            "doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))

    def _settle(self, entries: DataFrame, sets: DataFrame) -> DataFrame:
        """Components ``(node, component)`` of sets over the links found."""
        put, k = self.store.put, 0
        none = self.spark.createDataFrame([], "x long, y long, ok boolean")
        tested, comp = none, self.spark.createDataFrame([], "node long, component long")
        while True:
            lab = put(entries.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
            turn = F.struct(F.xxhash64("cid").alias("o"), F.col("cid").alias("p"), F.col("n").alias("np"), F.col("component").alias("pc"), F.col("most").alias("pm"))
            live = lab.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
            part = F.pmod(F.xxhash64("cid", F.lit(k)), F.lit(4 ** max(0, k - 1)))  # more members at once in later rounds
            live = lab.join(live, "list", "left_semi").groupBy("list", part.alias("part")).agg(F.min(turn).alias("t"))
            live = put(live.select("list", "t.*").drop("o"))
            if live.isEmpty():
                self.store.drop(lab, live, sets)
                return comp
            cand = lab.join(live, "list").filter((F.col("component") != F.col("pc")) & self._fits(F.col("n"), F.col("np"))
                                                 & (F.least("most", "pm") >= self._need(F.col("n"), F.col("np"))))
            cand = cand.groupBy("cid", "n", "p", "np").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("lists"))
            if k < 1:  # each set with its best partner
                best = F.max_by(F.struct("p", "np"), F.struct("score", "lists", "p"))
                cand = cand.groupBy("cid", "n").agg(best.alias("b")).select("cid", "n", "b.p", "b.np")
            x, y = F.least("cid", "p"), F.greatest("cid", "p")
            cand = cand.select(x.alias("x"), y.alias("y"), F.when(x == F.col("cid"), F.col("n")).otherwise(F.col("np")).alias("nx"),
                               F.when(x == F.col("cid"), F.col("np")).otherwise(F.col("n")).alias("ny")).distinct()
            cand = cand.join(tested.select("x", "y"), ["x", "y"], "left_anti")
            both = cand.join(sets.select(F.col("cid").alias("x"), F.col("s").alias("sx")), "x")
            both = both.join(sets.select(F.col("cid").alias("y"), F.col("s").alias("sy")), "y").select("x", "y", "nx", "ny", "sx", "sy")
            seen = both.mapInArrow(_overlap, "x long, y long, nx long, ny long, common long")
            c = F.col("common")
            seen = put(seen.select("x", "y", (c * self.den >= (F.col("nx") + F.col("ny") - c) * self.num).alias("ok")))
            tested = tested.unionByName(seen)
            known = comp.select(F.col("node").alias("x"), F.col("component").alias("y"))
            comp = components(self.store, known.unionByName(seen.filter("ok").select("x", "y")), "x", "y")
            left = lab.drop("component").join(live, "list", "left_semi")
            if k >= 1:  # a member compared with all others of its list has no more to do there
                left = left.join(live.select("list", F.col("p").alias("cid")), ["list", "cid"], "left_anti")
            before, entries = entries, put(left)
            self.store.drop(before, lab, live)
            k += 1


def jaccard_components(
    docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents linked when the Jaccard similarity of
    their word-``size`` shingles is ``num/den`` or more, directly or over others.

    Null and blank texts have no shingles and link with nothing (their component is their own
    id); shorter texts are one shingle; equal texts link whatever their number; rows that
    share an id share a component only if their texts link; an empty table gives no rows.
    """
    return JaccardJoin(docs, size, num, den, id_col, text_col).components()


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), size=4, num=85, den=100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the row with the least id, null last; of rows that
    share it, one.  Rows are known by a key that is written once."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    rows = Scratch(spark).put(docs.withColumn(key, F.monotonically_increasing_id()))
    c = jaccard_components(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    ids = rows.select(key, F.col("doc_id").alias("_id")).join(c, key)
    least = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", F.col(key).alias("_k")))
    kept = ids.groupBy("component_id").agg(least.alias("_m")).select(F.col("_m._k").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
