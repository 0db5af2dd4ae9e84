"""Steps that the trade and span queries share: same rows by either path, few shuffles."""
import math
import random

import pytest
from pyspark.sql import functions as F

from qtospark.operators import spatial
from qtospark.plans import spans as S
from qtospark.plans import trades as T

ROOM = "room_id string, projekt_id long, name string, cx double, cy double, h double"
OPENING = "opening_id string, projekt_id long, raum string, cx double, cy double, art string"


def _house():
    rng = random.Random(4)
    names = ["Bad", "WC", "Flur", "Zimmer 3", "bad"]
    rooms = [(f"r{i:03}", i % 3, rng.choice(names), *(rng.choice([(None, None), (rng.randint(0, 900) / 1.0, rng.randint(0, 900) / 1.0)])), float(i)) for i in range(60)]
    rooms.append(("r900", 7, "Flur", 5.0, 5.0, 9.0))
    openings = [(f"o{i:03}", i % 4, rng.choice(names + ["Keller", None, ""]), *(rng.choice([(None, None), (rng.randint(0, 900) / 1.0, rng.randint(0, 900) / 1.0)])), f"a{i}") for i in range(200)]
    openings += [(f"p{i}", 7, "Keller", 5.0 + 100 * i, 5.0, "x") for i in range(6)]
    return rooms, openings


def _plain(rooms, openings):
    import hashlib

    key = lambda n: n.lower().replace(" ", "") if n else None
    digest = lambda i: (hashlib.md5(i.encode()).hexdigest(), i)
    seats, out = {}, set()
    for o in sorted(openings, key=lambda o: digest(o[0])):
        mine = [r for r in rooms if r[1] == o[1]]
        named = [r for r in mine if key(o[2]) is not None and key(r[2]) == key(o[2])]
        near = lambda rs: min(((math.sqrt((o[3] - r[3]) ** 2 + (o[4] - r[4]) ** 2), r[0]) for r in rs if r[3] is not None), default=None)
        if len(named) == 1:
            out.add((o[0], named[0][0], "name"))
        elif not named:
            hit = near(mine) if o[3] is not None else None
            if hit and hit[0] < 400:
                out.add((o[0], hit[1], "position"))
        elif o[3] is not None and any(r[3] is not None for r in named):
            out.add((o[0], near(named)[1], "name_position"))
        else:
            k = (o[1], key(o[2]))
            i = seats[k] = seats.get(k, -1) + 1
            out.add((o[0], sorted((r[0] for r in named), key=digest)[i % len(named)], "reihum"))
    return out


@pytest.mark.parametrize("small", [256, 15, 0])
def test_assignment_of_small_and_large_scopes(spark, monkeypatch, small):
    monkeypatch.setattr(T, "SMALL_SCOPE", small)
    rooms, openings = _house()
    r, o = spark.createDataFrame(rooms, ROOM), spark.createDataFrame(openings, OPENING)
    got = T.assign_openings(r, o, room_cols=("h",), opening_cols=("art",)).collect()
    assert {(x.opening_id, x.room_id, x.zuordnung) for x in got} == _plain(rooms, openings)
    h, art = {x[0]: x[5] for x in rooms}, {x[0]: x[5] for x in openings}
    assert all(x.h == h[x.room_id] and x.art == art[x.opening_id] for x in got)


def test_assignment_shuffles_each_side_once(spark):
    rooms, openings = _house()
    a = T.assign_openings(spark.createDataFrame(rooms, ROOM), spark.createDataFrame(openings, OPENING))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("small", [200, 20, 0])
@pytest.mark.parametrize("radius", [200.0, None])
def test_nearest_by_list_and_by_grid(spark, monkeypatch, small, radius):
    monkeypatch.setattr(spatial, "SMALL_GROUP", small)
    rng = random.Random(5)
    at = lambda: (float(rng.randint(0, 40) * 20), float(rng.randint(0, 40) * 20))
    left = [(f"l{i:03}", i % 4, *at()) for i in range(80)]
    right = [(f"r{i:03}", 0 if i % 3 else 1 + i % 2, *at()) for i in range(90)]
    a, b = spark.createDataFrame(left, "l string, k int, cx double, cy double"), spark.createDataFrame(right, "r string, k int, cx double, cy double")
    got = {x.l: (x.r, x.dist, x.tied) for x in spatial.nearest(a, b, ["k"], "l", "r", radius, ties=True).collect()}
    want = {}
    for i, k, x, y in left:
        c = sorted((math.sqrt((x - p[2]) ** 2 + (y - p[3]) ** 2), p[0], p[2:]) for p in right if p[1] == k)
        if c and (radius is None or c[0][0] <= radius):
            want[i] = (c[0][1], c[0][0], len({p for d, _, p in c if d == c[0][0]}) > 1)
    assert got == want


def test_positions_without_a_total_are_not_exported(spark, monkeypatch):
    """The SQL rounds a total before it asks whether it is positive."""
    from qtospark.catalog import io_q

    rows = [(8, "putz", "1.1", "m²", 0.0004, 1), (8, "putz", "1.2", "m²", 0.0006, 1), (8, "maler", "1.1", "m²", 1e-13, 2)]
    p = spark.createDataFrame(rows, "projekt_id long, gewerk string, posnr string, einheit string, endsumme double, n_zeilen long")
    monkeypatch.setattr(io_q, "_pos", lambda t: p)
    assert [(r.gewerk, r.posnr) for r in io_q.boq_export(None).collect()] == [("putz", "1.2")]


def test_spans_are_built_kind_by_kind(spark):
    """One generated method with all kinds is too long to be compiled."""
    from qtospark.sources import adapters as A

    s = A.spans(spark, "/root/testdata/sf0.001")
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "inline" not in plan
    assert s.count() == 6 * A.base(spark, "/root/testdata/sf0.001", "lineitem").count()


def test_first_characters_of_classes(spark):
    want = {
        "F: 3,20 m²": "flaeche", "U: 8,1 m": "umfang", "RH=2,50": "hoehe", "H 2,5": "hoehe", "fph 90": "parapet", "FBH 0,9": "parapet", "stuk 2,1": "sturz",
        "aw3": "wand", "IW": "wand", "top 3": "wohnung", "+ 1,20": "kote", "-3,05": "kote", "ei2 30": "tuercode", "t 4": "tuercode", "rs 1": "tuercode",
        "fe_4": "fenstercode", "120": "mass", "1,25": "mass", "Bad": "raum", "xyz": "sonst", "F 3": "sonst", "9999": "sonst", "": "sonst",
    }
    d = S.classify(spark.createDataFrame([(k,) for k in want], "text string"))
    assert {r.text: r.klasse for r in d.select("text", "klasse").collect()} == want


def test_tokens_and_labels_are_not_broadcast(spark):
    rooms = spark.createDataFrame([("r1", 1, "Bad-Wohnung", 2.5), ("r2", 1, "Flur", 3.0)], "room_id string, plan_key long, name string, flaeche_m2 double")
    spans = spark.createDataFrame([("s1", 1, 1, "Wohnung 3", 0.0, 0.0), ("s2", 1, 2, "TOP 1", 9.0, 9.0)], "span_id string, plan_id long, seite long, text string, cx double, cy double")
    e = S.text_evidence(rooms, spans)
    assert [r.room_id for r in e.collect()] == ["r1"]
    assert "Broadcast" not in e._jdf.queryExecution().executedPlan().toString().replace("BroadcastQueryStage", "Broadcast")
    labels = spans.filter("text like 'TOP%'")
    f = S.assign_flats(spans, labels)
    assert {r.span_id: r.wohnung for r in f.collect()} == {"s1": "Haus", "s2": "TOP 1"}
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    rng = random.Random(1)
    xs = [sum(round(rng.uniform(-50, 50), 4) for _ in range(12)) for _ in range(3000)] + [80.99849999999999, 32.4145, 177.55349999999999, -1e-14, -0.0004, 0.0]
    from qtospark.functions.numbers import german_format, sql_round

    d = spark.createDataFrame(list(enumerate(xs)), "i long, x double").withColumn("r", sql_round(F.col("x"), 3))
    got = [(r.r, r.z) for r in d.select("r", german_format(F.col("r")).alias("z"), "i").orderBy("i").collect()]
    sql = "select round(x, 3), replace(format('{:.2f}', round(x, 3)), '.', ',') from (select unnest(?::DOUBLE[]) x, generate_subscripts(?::DOUBLE[], 1) i) order by i"
    assert got == duckdb.connect().execute(sql, [xs, xs]).fetchall()


def test_assignment_deals_both_sides_out_together(spark, monkeypatch):
    """Scopes that are cut by the ends of batches, and pairs measured in slices."""
    from qtospark.operators import assignment

    rooms, openings = _house()
    monkeypatch.setattr(assignment, "PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        a = T.assign_openings(spark.createDataFrame(rooms, ROOM), spark.createDataFrame(openings, OPENING))
        deals = a._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got = {(x.opening_id, x.room_id, x.zuordnung) for x in a.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _plain(rooms, openings) and deals == 1


def test_methods_that_read_the_tables_are_compiled(spark):
    """The JVM does not compile methods of more than 8000 bytes."""
    from qtospark.catalog import Tables

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        lines = T.trade_lines(t.rooms, t.openings, T.best_building(t.building), by_room=False)
        plan = T.positions(lines)._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= 8000


@pytest.mark.parametrize("values", [(0.1, 0.2, -0.3), (-0.3, 0.1, 0.2), (0.3, -0.1, -0.2), (-0.1, -0.2, 0.3)])
def test_totals_of_zero_have_no_sign(spark, values):
    from qtospark.sources import files

    lines = spark.createDataFrame([(8, "fliesen", "1.2", "m²", v) for v in values], "projekt_id long, gewerk string, posnr string, einheit string, wert double").coalesce(1)
    p = T.positions(lines)
    assert files.csv_lines(p, ["endsumme"], ["projekt_id"]).first().zeile == "0,00" and p.first().endsumme == 0.0


@pytest.mark.parametrize("most", [400, 30, 0])
def test_greedy_assignment_of_small_and_large_groups(spark, monkeypatch, most):
    """Small groups are walked once: rounds would write every row again in each of them."""
    from qtospark.operators import matching

    rng = random.Random(9)
    at = lambda: (float(rng.randint(0, 12) * 20), float(rng.randint(0, 12) * 20))
    left = [(f"l{i:03}", i % 4 if i % 3 else 0, *at()) for i in range(70)]
    right = [(f"r{i:03}", i % 4, *at()) for i in range(60)]
    a, b = spark.createDataFrame(left, "l string, k int, cx double, cy double"), spark.createDataFrame(right, "r string, k int, cx double, cy double")
    rounds, plain = [], matching._by_rounds
    monkeypatch.setattr(matching, "_by_rounds", lambda *v: rounds.append(1) or plain(*v))
    got = {x.l: (x.r, x.dist) for x in matching.greedy_nearest(a, b, ["k"], "l", "r", 100.0, most=most).collect()}
    pairs = sorted((math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2), p[0], q[0]) for p in left for q in right if p[1] == q[1])
    want, used = {}, set()
    for d, i, j in pairs:
        if d <= 100.0 and i not in want and j not in used:
            want[i] = (j, d)
            used.add(j)
    assert got == want and bool(rounds) == (most < 100)


def test_sums_that_no_order_changes(spark):
    """The band of a room's openings at its limit must not hang on the order of its openings."""
    import functools
    import itertools
    import operator

    from qtospark.functions.numbers import steady_sum
    from qtospark.plans import precalc

    areas = [(1.7, 1.7), (2.6, 2.1), (1.5, 1.1)]
    rooms = spark.createDataFrame([("r", 8, "Bad", "TOP 1", 10.0, 12.0)], "room_id string, projekt_id long, name string, wohnung string, flaeche_m2 double, umfang_m double")
    orders = list(itertools.permutations(areas))
    o = [[("r", b, h) for b, h in p] for p in orders]
    got = {precalc.storey_scaled_paint(rooms, spark.createDataFrame(x, "room_id string, breite_m double, hoehe_m double").coalesce(1), 4, 4, 2.7, 2.6).first().wand_eg for x in o}
    plain = {functools.reduce(operator.add, [b * h for b, h in p]) for p in orders}
    assert len({v <= 10 for v in plain}) == 2 or len({v <= 2.5 for v in plain}) == 2
    assert len(got) == 1
    rng = random.Random(3)
    for values in ([rng.uniform(-9, 9) for _ in range(50)], [1e12, 0.1], [0.1, 0.7], [2.5], [None], [None, 0.3]):
        s = spark.createDataFrame([(v,) for v in values], "v double").agg(steady_sum(F.col("v")).alias("s")).first().s
        known = [v for v in values if v is not None]
        assert s == (math.fsum(known) if known else None), values
