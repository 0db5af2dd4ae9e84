"""Openings of a scope meet its rooms, many scopes an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import name_key

#: Pairs of an opening and a room that are measured at once.
PAIRS = 1_000_000
WAYS = ["name", "position", "name_position", "reihum"]


def _nearest(who: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray,
             rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``who`` with any of ``rows[lo:hi]``, the nearest of them (then the lowest ``rank``) and its distance."""
    who = who[hi[who] > lo[who]]
    parts = np.searchsorted(np.cumsum(hi[who] - lo[who]), np.arange(PAIRS, (hi[who] - lo[who]).sum() + PAIRS, PAIRS))
    found, far = [np.empty(0, np.int64)], [np.empty(0)]
    for w in np.split(who, np.unique(parts)):
        if not len(w):
            continue
        size = hi[w] - lo[w]
        first = np.cumsum(size) - size
        cand = rows[np.arange(size.sum()) - np.repeat(first - lo[w], size)]
        ex, ey = np.repeat(x[at[w]], size) - x[cand], np.repeat(y[at[w]], size) - y[cand]
        d = np.sqrt(ex * ex + ey * ey)
        d[np.isnan(d)] = np.inf
        best = np.minimum.reduceat(d, first)
        tied = np.where(d == np.repeat(best, size), rank[cand], len(rank))
        lowest = np.minimum.reduceat(tied, first)
        mine = np.flatnonzero(tied == np.repeat(lowest, size))
        found.append(cand[mine])
        far.append(best)
    return who, np.concatenate(found), np.concatenate(far)


def _assign(t: pa.Table, cap: float) -> dict[str, pa.Array]:
    """Rows of whole scopes, rooms and openings each in order of their turn, to pairs of an opening and its room."""
    cols = {c: t[c].combine_chunks() for c in t.column_names}
    room = cols["_room"].to_numpy(zero_copy_only=False)
    scope = cols["_scope"].dictionary_encode().indices.to_numpy()
    names = cols["nk"].dictionary_encode()
    key = scope.astype(np.int64) * (len(names.dictionary) + 1) + pc.fill_null(names.indices, -1).to_numpy().astype(np.int64)
    named = cols["nk"].is_valid().to_numpy(zero_copy_only=False)
    has_x = cols["x"].is_valid().to_numpy(zero_copy_only=False)
    placed = has_x & cols["y"].is_valid().to_numpy(zero_copy_only=False)
    x, y = (pc.fill_null(cols[c], 0.0).to_numpy() for c in ("x", "y"))
    rooms, op = np.flatnonzero(room), np.flatnonzero(~room)
    rank = np.empty(len(room), np.int64)
    rank[rooms[pc.sort_indices(cols["room_id"].take(pa.array(rooms))).to_numpy()]] = np.arange(len(rooms))

    def within(rows: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(k[rows], k[op], "left"), np.searchsorted(k[rows], k[op], "right")

    alike = rooms[np.argsort(key[rooms], kind="stable")]
    lo, hi = within(alike, key)
    n = np.where(named[op], hi - lo, 0)
    counted = np.concatenate([[0], np.cumsum(has_x[alike])])
    some = counted[hi] > counted[lo]

    hit, way = np.full(len(op), -1), np.zeros(len(op), np.int64)
    w = np.flatnonzero(n == 1)
    hit[w] = alike[lo[w]]
    here = np.sort(rooms[placed[rooms]])
    at_scope = (np.searchsorted(scope[here], scope[op], "left"), np.searchsorted(scope[here], scope[op], "right"))
    w, r, d = _nearest(np.flatnonzero((n == 0) & placed[op]), *at_scope, here, op, x, y, rank)
    hit[w[d < cap]], way[w] = r[d < cap], 1
    by_place = (n > 1) & placed[op] & some
    here = alike[placed[alike]]
    w, r, _ = _nearest(np.flatnonzero(by_place), *within(here, key), here, op, x, y, rank)
    hit[w], way[w] = r, 2

    # in turn: a place among all openings of the name, or among those without a position
    turn = np.argsort(key[op], kind="stable")
    first = np.searchsorted(key[op][turn], key[op][turn], "left")
    bare = np.concatenate([[0], np.cumsum(~placed[op][turn])])
    place = np.empty(len(op), np.int64)
    place[turn] = np.where(some[turn], bare[1:] - bare[first] - 1, np.arange(len(op)) - first)
    w = np.flatnonzero((n > 1) & ~by_place)
    hit[w], way[w] = alike[lo[w] + place[w] % n[w]], 3

    got = np.flatnonzero(hit >= 0)
    o, r = pa.array(op[got]), pa.array(hit[got])
    return {
        "opening_id": cols["opening_id"].take(o), "room_id": cols["room_id"].take(r), "zuordnung": pa.array(WAYS).take(pa.array(way[got])),
        **{c: v.take(o) for c, v in cols.items() if c.startswith("_o_")}, **{c: v.take(r) for c, v in cols.items() if c.startswith("_r_")}}


def assign_batches(rooms: DataFrame, openings: DataFrame, scope: str, cap: float) -> DataFrame:
    """``(opening_id, room_id, zuordnung, _o_.., _r_..)`` of :func:`qtospark.plans.trades.assign_openings`.

    ``rooms(room_id, scope, name, cx, cy, _r_..)`` and ``openings(opening_id, scope, name, cx, cy, _o_..)`` are dealt out by scope
    as one list and put in order of turn there; tasks take whole scopes, as many as a batch holds, and measure the pairs
    of a batch in slices.  A scope must fit a task.
    """
    place = [F.col(scope).alias("_scope"), "name", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y")]
    mine, theirs = [c for c in rooms.columns if c.startswith("_r_")], [c for c in openings.columns if c.startswith("_o_")]
    rows = rooms.select(F.lit(True).alias("_room"), "room_id", *place, *mine).unionByName(
        openings.select(F.lit(False).alias("_room"), "opening_id", *place, *theirs), allowMissingColumns=True)
    # digest and name key are made behind the shuffle: one cannot be packed, and with the other the method that reads
    # the tables is too long for the JVM to compile
    rows = rows.filter("_scope IS NOT NULL").repartition(F.col("_scope"))
    rows = rows.withColumn("_h", F.coalesce(F.md5("room_id"), F.md5("opening_id")))
    rows = rows.withColumn("nk", F.when(F.col("_room") | (F.col("name") != ""), name_key(F.col("name")))).drop("name")
    rows = rows.sortWithinPartitions("_scope", "_h", "room_id", "opening_id", *mine).drop("_h")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in ("opening_id", "room_id", "zuordnung", *theirs, *mine)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            s = t["_scope"].combine_chunks()
            change = np.flatnonzero(pc.not_equal(s.slice(1), s.slice(0, len(s) - 1)).to_numpy(zero_copy_only=False))
            if not len(change):  # one scope so far
                held.append(b)
                continue
            yield pa.RecordBatch.from_pydict(_assign(t.slice(0, change[-1] + 1), cap))
            held = t.slice(change[-1] + 1).to_batches()
        if held:
            yield pa.RecordBatch.from_pydict(_assign(pa.Table.from_batches(held), cap))

    return rows.mapInArrow(run, out)
