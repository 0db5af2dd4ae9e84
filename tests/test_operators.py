"""Distributed operators against brute force, with a crowd of copies holding a third of the rows."""

import itertools
import math
import random

from pyspark.sql import functions as F

from qtospark.operators.graph import connected_components, greedy_leaders, mutual_best
from qtospark.operators.matching import greedy_nearest
from qtospark.operators.ordering import mode_first, mode_smallest, order_stats, ordinal, running_number, running_sum
from qtospark.operators.spatial import box_join, nearest, proximity_edges


def points(n, seed, crowd=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if crowd and i % 3 == 0:
            x, y = 500.0, 500.0
        else:
            x, y = float(rnd.randint(0, 1500)), float(rnd.randint(0, 1500))
        out.append((f"{seed}-{i:04d}", i % 2, x, y))
    return out


def test_order_stats(spark):
    rnd = random.Random(1)
    rows = [("a", float(rnd.randint(0, 9))) for _ in range(101)] + [("b", float(v)) for v in (4, 1, 3, 2)] + [("c", None), ("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in order_stats(df, ["k"], "v", {"med": "median", "up": "upper", "lo": "lower", "q1": "q1", "q3": "q3", "p": "p2", "n": "n"}).collect()}
    for k in "abc":
        s = sorted(v for kk, v in rows if kk == k and v is not None)
        n = len(s)
        assert (got[k].up, got[k].lo, got[k].q1, got[k].q3, got[k].n) == (s[n // 2], s[(n - 1) // 2], s[n // 4], s[3 * n // 4], n)
        assert got[k].med == (s[n // 2] + s[(n - 1) // 2]) / 2 and got[k].p == s[int(0.02 * (n - 1))]


def test_modes(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 2, 2), ("a", 2, 3), ("a", 3, 4), ("a", 1, 5)], "k string, v int, o int")
    assert mode_smallest(df, ["k"], "v", "m").first().m == 2
    assert mode_first(df, ["k"], "v", "o", "m").first().m == 3


def test_numbering_of_a_hot_group(spark):
    rows = [(f"id{i}", "hot" if i % 3 else f"k{i % 7}", i % 50, float(i % 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, k string, t int, v double")
    o = ordinal(df, ["k"], "id", "o", "n").collect()
    for k in {r.k for r in o}:
        mine = [r for r in o if r.k == k]
        assert sorted(r.o for r in mine) == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
    got = {r.id: r.nr for r in running_number(df, ["k"], F.floor(F.col("t") / 10), ["t", "id"], "nr").collect()}
    sums = {r.id: r.c for r in running_sum(df, ["k"], F.floor(F.col("t") / 10), ["t", "id"], "v", "c").collect()}
    for k in {r[1] for r in rows}:
        acc = 0.0
        for i, r in enumerate(sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])), 1):
            acc += r[3]
            assert got[r[0]] == i and sums[r[0]] == acc


def _near(left, right, cap=None):
    out = {}
    for i, k, x, y in left:
        best = min(((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, kk, a, b in right if kk == k), default=None)
        if best and (cap is None or best[0] <= cap):
            out[i] = best[1]
    return out


def test_nearest(spark):
    left, right = points(150, 1), points(150, 2)
    sch = "{} string, k int, cx double, cy double"
    l, r = spark.createDataFrame(left, sch.format("lid")), spark.createDataFrame(right, sch.format("rid"))
    for radius in (200.0, None):
        got = {x.lid: x.rid for x in nearest(l, r, ["k"], "lid", "rid", radius).collect()}
        assert got == _near(left, right, radius)


def test_box_join_semi_anti(spark):
    left, right = points(60, 3), points(60, 4)
    l, r = spark.createDataFrame(left, "lid string, k int, cx double, cy double"), spark.createDataFrame(right, "rid string, k int, cx double, cy double")
    hit = {a[0] for a in left for b in right if a[1] == b[1] and abs(a[2] - b[2]) <= 80 and abs(a[3] - b[3]) <= 40}
    assert {x.lid for x in box_join(l, r, ["k"], 80.0, 40.0, how="left_semi").collect()} == hit
    assert {x.lid for x in box_join(l, r, ["k"], 80.0, 40.0, how="left_anti").collect()} == {a[0] for a in left} - hit


def test_greedy_assignment(spark):
    left, right = points(60, 5, crowd=False), points(60, 6, crowd=False)
    l, r = spark.createDataFrame(left, "lid string, k int, cx double, cy double"), spark.createDataFrame(right, "rid string, k int, cx double, cy double")
    pairs = sorted((math.hypot(a[2] - b[2], a[3] - b[3]), a[0], b[0]) for a in left for b in right if a[1] == b[1])
    pairs = [p for p in pairs if p[0] <= 400]
    ul, ur, want = set(), set(), {}
    for d, a, b in pairs:
        if a not in ul and b not in ur:
            ul.add(a), ur.add(b)
            want[a] = b
    assert {x.lid: x.rid for x in greedy_nearest(l, r, ["k"], "lid", "rid", 400.0).collect()} == want
    cand = spark.createDataFrame(pairs, "d double, a string, b string")
    assert {x.a: x.b for x in mutual_best(cand, "a", "b", F.col("d")).collect()} == want


def test_greedy_assignment_of_a_crowd(spark):
    rng = random.Random(8)
    spots = [(float(rng.randint(0, 300)), float(rng.randint(0, 300))) for _ in range(11)]
    at = lambda i: spots[0] if i % 3 == 0 else spots[1 + i % 10]
    left = [(f"l{i:03d}", 1, *at(i)) for i in range(120)]
    right = [(f"r{i:03d}", 1, at(i)[0] + 3.0, at(i)[1] + 1.0) for i in range(90)]
    l, r = spark.createDataFrame(left, "lid string, k int, cx double, cy double"), spark.createDataFrame(right, "rid string, k int, cx double, cy double")
    want, used = {}, set()
    for d, a, b in sorted((math.hypot(a[2] - b[2], a[3] - b[3]), a[0], b[0]) for a in left for b in right):
        if d <= 400 and a not in want and b not in used:
            want[a] = b
            used.add(b)
    assert {x.lid: x.rid for x in greedy_nearest(l, r, ["k"], "lid", "rid", 400.0).collect()} == want


def test_components_of_chain_and_star(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("s000", f"s{i:03d}") for i in range(1, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert all(v == ("c000" if k.startswith("c") else "s000") for k, v in got.items()) and len(got) == 261


def test_proximity_components(spark):
    pts = points(120, 7)
    df = spark.createDataFrame(pts, "id string, k int, cx double, cy double")
    for metric in ("box", "euclid"):
        e = proximity_edges(df, ["k"], "id", 120.0, metric=metric)
        got = {r.node: r.component for r in connected_components(e).collect()}
        parent = {p[0]: p[0] for p in pts}

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in itertools.combinations(pts, 2):
            dx, dy = abs(a[2] - b[2]), abs(a[3] - b[3])
            if a[1] == b[1] and ((dx < 120 and dy < 120) if metric == "box" else math.sqrt(dx * dx + dy * dy) < 120):
                ra, rb = sorted((find(a[0]), find(b[0])))
                parent[rb] = ra
        assert all(got.get(p[0], p[0]) == find(p[0]) for p in pts)
        assert e.count() < 25 * len(pts)  # a crowd of n copies gives O(n) edges


def test_greedy_leaders(spark):
    rnd = random.Random(8)
    nodes = [(f"n{i:02d}", rnd.randint(0, 3)) for i in range(40)]
    order = sorted(nodes, key=lambda n: (n[1], n[0]))
    pos = {n[0]: i for i, n in enumerate(order)}
    pairs = [(a, b) if pos[a] < pos[b] else (b, a) for a, b in {tuple(rnd.sample([n[0] for n in nodes], 2)) for _ in range(80)}]
    near = {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
    want, kept = {}, []
    for n, _ in order:
        hit = next((k for k in kept if k in near.get(n, ())), None)
        want[n] = hit or n
        if hit is None:
            kept.append(n)
    got = greedy_leaders(spark.createDataFrame(nodes, "id string, r int"), spark.createDataFrame(pairs, "a string, b string"), "id", "r")
    assert {r.id: r.leader for r in got.collect()} == want


def test_wide_order_stats(spark):
    """Groups of very many distinct values, one with most of all rows, a skewed one and a null."""
    import random

    from qtospark.operators.ordering import order_stats, wide_order_stats

    rng = random.Random(8)
    rows = [("a", rng.random()) for _ in range(4000)] + [("b", rng.random() ** 40 * 1e9) for _ in range(700)]
    rows += [("c", 1.5)] * 300 + [("c", 2.5), ("d", None), ("e", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    picks = {"m": "median", "up": "upper", "lo": "lower", "q1": "q1", "q3": "q3", "p2": "p2", "p98": "p98", "n": "n"}
    got = {tuple(r) for r in wide_order_stats(df, ["k"], "v", picks, ranges=32).collect()}
    assert got == {tuple(r) for r in order_stats(df, ["k"], "v", picks).collect() if r["n"]} and len(got) == 4
    s = sorted(v for _, v in rows if v is not None)
    one = wide_order_stats(df, [], "v", {"m": "median", "n": "n"}, ranges=32).collect()
    assert [tuple(r) for r in one] == [((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2, len(s))]


def test_reference_rows_span_blocks(spark):
    """Segments of lines that cross the blocks of the running number."""
    from qtospark.plans.calibration import parse_reference_lists, reference_rows

    text = "Titel:\nMauer\n\nHLZ 25\n# Notiz\n12,5 m²\nDecke;3,5;m³\nlose\nAbschnitt:\nBeton C25 ..... 7 m³\nRest\nmehr\n9 Stk\n4 Stk\nEnde"
    want = {("Mauer HLZ 25", 12.5, "m²"), ("Decke", 3.5, "m³"), ("Beton C25 .....", 7.0, "m³"), ("Rest mehr", 9.0, "stk")}
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "nur Text")], "list_id int, text string")
    assert {tuple(r)[1:] for r in parse_reference_lists(df).collect()} == want
    lines = spark.createDataFrame([(1, i, z) for i, z in enumerate(text.split("\n"))], "list_id int, nr int, zeile string")
    for block in (1, 2, 5):
        assert {tuple(r)[2:] for r in reference_rows(lines, block=block).collect()} == want


def test_nearest_without_limit(spark):
    """Far clusters, crowds and ties; every row finds what a look at all points finds."""
    import math
    import random

    from qtospark.operators.spatial import nearest

    rng = random.Random(9)
    left = [(g, f"l{g}{i:03}", rng.uniform(-9e4, 9e4), rng.choice([0.0, 5e4]) + rng.uniform(-300, 300)) for g in (1, 2, 3) for i in range(40)]
    right = [(g, f"r{g}{i:03}", float(cx + rng.randint(-40, 40)), float(cy + rng.randint(-40, 40))) for g, cx, cy in ((1, 0, 0), (1, -50_000, 20_000), (2, 70_000, 30_000)) for i in range(60)]
    a = spark.createDataFrame(left, "g int, l string, cx double, cy double")
    b = spark.createDataFrame(right, "g int, r string, cx double, cy double")
    got = {r["l"]: (r["r"], r["dist"]) for r in nearest(a, b, ["g"], "l", "r").collect()}
    for g, i, x, y in left:
        near = min(((math.sqrt((x - p[2]) ** 2 + (y - p[3]) ** 2), p[1]) for p in right if p[0] == g), default=None)
        assert (i in got) == (near is not None)
        if near:
            assert abs(got[i][1] - near[0]) < 1e-6 and (got[i][0] == near[1] or abs(near[0] - got[i][1]) < 1e-9)


def test_copy_subtree(spark):
    from qtospark.plans.merge import copy_subtree

    roots = spark.createDataFrame([(1,), (1,)], "id long")
    plans = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "plan_id long, p long")
    rooms = spark.createDataFrame([("a", 1, 10, "x"), ("b", 1, 11, "y"), ("c", 2, 11, "z"), ("d", None, 10, None)], "room string, p long, plan_id long, name string")
    openings = spark.createDataFrame([("o1", "a"), ("o2", "c"), ("o3", "d"), ("o4", None)], "o string, room string")
    made = copy_subtree([("plans", plans, "plan_id", {"p": "roots"}), ("rooms", rooms, "room", {"p": "roots", "plan_id": "plans"}),
                         ("openings", openings, "o", {"room": "rooms"})], roots, "roots", "k", 100)
    assert {tuple(r) for r in made["plans"].collect()} == {(110, 101, 10)}
    assert {tuple(r) for r in made["rooms"].collect()} == {("a~k", 101, 110, "x", "a"), ("b~k", 101, None, "y", "b"), ("d~k", None, 110, None, "d")}
    assert {tuple(r) for r in made["openings"].collect()} == {("o1~k", "a~k", "o1"), ("o3~k", "d~k", "o3")}
