"""Pages that one task looks through give what the distributed way gives."""

import random

from pyspark.sql import functions as F

from qtospark.plans import drawing as D
from qtospark.plans import merge as M
from qtospark.plans import spans as S

PAGE = "plan_id int, seite int, "


def pages(rng, n):
    return [(p, s) for p in range(n) for s in (1, 2) for _ in range(rng.randint(1, 14))] + [(99, None)] * 3


def test_level_line_pair_by_pair(spark):
    rng = random.Random(11)
    rows = [(p, float(rng.randint(0, 30) * 20), rng.randint(0, 40) / 4, f"o{i:03}") for i, (p, _) in enumerate(pages(rng, 12))]
    df = spark.createDataFrame(rows, "plan_id int, y double, v double, o string")
    pairwise, blocks = (sorted(map(tuple, D.best_level_line(df, ["plan_id"], few=few).collect())) for few in (48, 0))
    assert pairwise == blocks and len(blocks) > 5


def test_filled_walls_of_small_pages(spark):
    rng = random.Random(12)
    rows = []
    for p, s in pages(rng, 8) * 3:
        x, y, w = rng.randint(0, 8) * 6.0, rng.randint(0, 5) * 20.0, rng.choice([3.0, 6.0, 9.0])
        rows.append((p, s, x, y, x + w, y + rng.randint(5, 20) * 10.0, 0.2))
    df = spark.createDataFrame(rows, PAGE + "x0 double, y0 double, x1 double, y1 double, fill double")
    one, rounds = (sorted(map(str, D.filled_walls(df, 100.0, most=most).collect())) for most in (400, 0))
    assert one == rounds and len(one) > 10


def test_floor_plan_view_of_small_pages(spark):
    rng = random.Random(13)
    rows = [(p, s, f"s{i:03}", float(rng.randint(0, 60) * 10), float(rng.randint(0, 20) * 10)) for i, (p, s) in enumerate(pages(rng, 10))]
    df = spark.createDataFrame(rows, PAGE + "span_id string, cx double, cy double")
    one, cells = (sorted(map(str, D.floor_plan_view(df, ["plan_id", "seite"], 10.0, most=most).collect())) for most in (400, 0))
    assert one == cells and len(one) > 10


def test_count_objects_of_small_pages(spark):
    rng = random.Random(14)
    rows = [(f"s{i:03}", p, s, "Terrasse", None if i % 9 == 0 else float(rng.randint(0, 9) * 60), float(rng.randint(0, 9) * 60)) for i, (p, s) in enumerate(pages(rng, 10))]
    df = spark.createDataFrame(rows, "span_id string, plan_id int, seite int, text string, cx double, cy double")
    one, rounds = (sorted(map(tuple, S.count_objects(df, "terrasse", 120.0, most=most).collect())) for most in (400, 0))
    assert one == rounds and len(one) == 11


def test_cousin_rooms_of_small_flats(spark):
    rng = random.Random(15)
    names = ["Wohnzimmer", "Wohnküche", "Zimmer 3", "Bad", "Kinderzimmer 1", "Waschküche", "", None]
    rows = [(f"r{i:03}", p, s, rng.choice(names), rng.choice([None, 0.0, 9.0, 11.0, 14.0, 30.0]), rng.choice([None, 12.0, 14.0, 30.0]), rng.choice([None, 2.6]), rng.choice(["", "Parkett"]))
            for i, (p, s) in enumerate(pages(rng, 12))]
    df = spark.createDataFrame(rows, "room_id string, projekt_id int, wohnung int, name string, flaeche_m2 double, umfang_m double, hoehe_m double, bodenbelag string")
    one, edges = (sorted(map(str, M.cousin_rooms(df, most=most).collect())) for most in (400, 0))
    assert one == edges == sorted(map(str, M.merge_components(df, M.cousin_edges(df)).collect())) and len(one) == len(rows)


def some_openings(rng):
    size = lambda: rng.choice([None, 0.0, 0.8, 0.85, 0.9, 1.05, 2.1])
    return [(f"o{i:03}", p, rng.choice(["tuer", "fenster"]), rng.choice(["Bad", " bad", "", None]), size(), size(), rng.choice([None, 0.9]), rng.choice([None, "AW"]),
             rng.choice([None, "", "FE_1", "fe_1 "]), rng.choice([None, 0.5, 0.9]), rng.choice(["text", "vision"]), rng.choice([None, 0.0, 20.0, 45.0]), rng.choice([0.0, 25.0]))
            for i, (p, s) in enumerate(pages(rng, 12)) if s]


OPENING = ("opening_id string, projekt_id int, art string, raum string, breite_m double, hoehe_m double, fph_m double, wand_typ string, code string, "
           "konfidenz double, quelle string, cx double, cy double")


def test_cluster_openings_of_small_rooms(spark):
    df = spark.createDataFrame(some_openings(random.Random(16)), OPENING)
    one, rounds = (sorted(map(str, M.cluster_openings(df, most=most).collect())) for most in (400, 0))
    assert one == rounds and len(one) > 20


def test_combine_openings_of_small_projects(spark):
    df = spark.createDataFrame(some_openings(random.Random(17)), OPENING)
    one, rounds = (sorted(map(str, M.combine_openings(df.filter("art <> 'tuer'"), df.filter("art = 'tuer'"), most=most).collect())) for most in (400, 0))
    assert one == rounds and 20 < len(one) < df.count()


def test_nearest_wall_of_small_plans(spark):
    rng = random.Random(18)
    w = [(p, f"w{i:03}", rng.choice("hv"), float(rng.randint(0, 20) * 5), float(lo := rng.randint(0, 10) * 10), lo + 10.0 * rng.randint(1, 9)) for i, (p, _) in enumerate(pages(rng, 8))]
    o = [(p, f"o{i:03}", None if i % 11 == 0 else rng.randint(0, 30) * 4.0, rng.randint(0, 30) * 4.0, i / 2) for i, (p, _) in enumerate(pages(rng, 8))]
    walls = spark.createDataFrame(w, "plan_id int, wand_id string, achse string, pos double, lo double, hi double")
    openings = spark.createDataFrame(o, "plan_id int, opening_id string, cx double, cy double, flaeche double")
    lists, cells = (sorted(map(tuple, S.nearest_wall(openings, walls, 25.0, ("flaeche",), most=most).collect())) for most in (200, 0))
    assert lists == cells and len(lists) > 40


def test_copy_subtree_shuffles_no_other_companies(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        plans = spark.range(100_000).selectExpr("id AS plan_id", "id - id % 8 AS p")
        rooms = spark.range(100_000).selectExpr("CAST(id AS STRING) AS room", "id - id % 8 AS p")
        made = M.copy_subtree([("plans", plans, "plan_id", {"p": "roots"}), ("rooms", rooms, "room", {"p": "roots"})],
                              plans.filter("p % 97 = 8").select(F.col("p").alias("id")).distinct(), "roots", "demo", 1000)
        assert "SortMergeJoin" not in made["rooms"]._jdf.queryExecution().executedPlan().toString()
        assert made["rooms"].count() == made["plans"].count() > 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_roof_texts_are_searched_once(spark):
    from qtospark.plans import materials

    text = "Dach\nDachfläche Nord: 5,50 x 4 = 22,00 m²\nDachfläche Süd: 10 m²\nMineralwolle 18 cm\nSchalung 2,4 cm\nTrittschall 3 cm"
    pages_ = spark.createDataFrame([("a", 1, text), ("b", 1, "Dachfläche gesamt: 1.050,5 m²"), ("c", 1, "Dach\nMineralwolle 20 cm")], "page string, ord int, text string")
    areas, _, layers = materials.roof_readings(pages_, "page")
    got = materials.roof_materials(materials.roof_totals(areas, "page"), layers, "page")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
    rows = {(r.page, r.material): round(r.menge, 4) for r in got.collect()}
    assert len(rows) == 10 and rows["a", "Dacheindeckung"] == 33.6 and rows["b", "Dachlatten"] == 3466.65
    assert rows["a", "Mineralwolle 18.0cm"] == 5.76 and rows["a", "Schalung 2.4cm"] == 32.0


def test_totals_of_zero_are_not_positive(spark):
    from qtospark.plans import quality

    rooms = spark.createDataFrame([(1, 100.0), (1, None), (2, 30.3), (2, 3.0)], "projekt_id int, flaeche_m2 double")
    lines = [(1, "estrich", v) for v in (0.1, 0.2, -0.3)] + [(1, "bodenbelag", 95.0), (1, "fensterbank", 1.0), (2, "estrich", 29.97), (2, "fensterbank", 1.0)]
    p = spark.createDataFrame([(k, g, "1", v) for k, g, v in lines], "projekt_id int, gewerk string, posnr string, endsumme double").coalesce(1)
    found = {(r.projekt_id, r.check) for r in quality.calculation_consistency(p, rooms).collect()}
    assert found == {(1, "negativ")}


def assembly_spans(rng):
    kinds = [("parapet", "FPH"), ("sturz", "STUK"), ("mass", "1,00"), ("wand", "aw1"), ("tuercode", "T1"), ("raum", "Bad")]
    rows = []
    for i, (p, s) in enumerate(pages(rng, 16) * 3):
        k, text = rng.choice(kinds)
        wert = {"parapet": rng.choice([0.0, 0.1, 0.9]), "sturz": rng.choice([1.5, 2.1, 2.4])}.get(k, rng.choice([0.3, 0.8, 0.9, 1.2, None]))
        rows.append((f"s{i:04}", p, s, None if i % 13 == 0 else float(rng.randint(0, 9) * 12), float(rng.randint(0, 9) * 12), text, k, wert))
    return rows


ASSEMBLY = "span_id string, plan_id int, seite int, cx double, cy double, text string, klasse string, wert double"


def test_assemble_openings_of_small_pages(spark):
    df = spark.createDataFrame(assembly_spans(random.Random(19)), ASSEMBLY)
    lists, cells = (S.assemble_openings(df, most=most) for most in (400, 0))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # a page looks through its own list
    lists, cells = (sorted(map(str, x.collect())) for x in (lists, cells))
    assert lists == cells and len(lists) > 20 and any("wand_typ='AW'" in r for r in lists) and any("tuer" in r for r in lists)


def test_marks_without_company_are_not_walked(spark, monkeypatch):
    rng = random.Random(20)
    rows = [(p, s, f"s{i:03}", i, None if i % 11 == 0 else float(rng.randint(0, 12) * 15), float(rng.randint(0, 12) * 15), rng.choice([0.5, 1.0, 2.1])) for i, (p, s) in enumerate(pages(rng, 16))]
    marks = spark.createDataFrame(rows, PAGE + "span_id string, ord int, cx double, cy double, wert double")
    walked, walk = [], D.ordered_walk
    monkeypatch.setattr(D, "ordered_walk", lambda df, *a, **k: walked.append(df.count()) or walk(df, *a, **k))
    one, rounds = (sorted(map(str, D.rbl_pairs(marks, ["plan_id", "seite"], most=most).collect())) for most in (2000, 0))
    assert one == rounds and len(one) > 5
    assert 2 * len(one) <= walked[0] < len(rows) / 2


def test_door_codes_near_no_opening(spark):
    from qtospark.operators.spatial import none_near

    rng = random.Random(21)
    spot = lambda i: (None if i % 17 == 0 else float(rng.randint(0, 15) * 20), float(rng.randint(0, 15) * 20))
    codes = spark.createDataFrame([(p, s, f"c{i:03}", i, f"T{i % 4}", *spot(i)) for i, (p, s) in enumerate(pages(rng, 14))], PAGE + "span_id string, ord int, text string, cx double, cy double")
    openings = spark.createDataFrame([(p, s, *spot(i)) for i, (p, s) in enumerate(pages(rng, 14))], PAGE + "cx double, cy double")
    keys = ["plan_id", "seite"]
    lists, cells = (sorted(map(str, none_near(codes, openings, keys, 52.5, most=most).collect())) for most in (400, 0))
    assert lists == cells and 10 < len(lists) < codes.count()
    one, rounds = (sorted(map(str, D.lone_door_codes(codes, openings, keys, most=most).collect())) for most in (2000, 0))
    assert one == rounds and len(one) > 5


def test_layer_tables_of_small_pages(spark):
    rng = random.Random(22)
    words = ["120 mm", "80 mm", "15 mm", "1 mm", "AW1 Wand im Bestand", "IW 2a Trennwand neu", "Stahlbeton lt. Statik", "Mineralwolle", "Gipskartonbauplatte", "Holzständer", "AW1", " "]
    rows = [(p, s, f"s{i:04}", i % 50, None if i % 23 == 0 else rng.randint(0, 6) * 60.0, float(rng.randint(0, 20) * 18), float(i % 7 * 60 + i % 2 * 30), rng.choice(words))
            for i, (p, s) in enumerate(pages(rng, 16) * 4)]
    df = spark.createDataFrame(rows, PAGE + "span_id string, ord int, cx double, cy double, x0 double, text string")
    lists, cells = (D.layer_tables(df, ["plan_id", "seite"], most=most) for most in (400, 0))
    assert "Join" not in lists._jdf.queryExecution().executedPlan().toString()  # heads look through the list of their page
    lists, cells = (sorted(map(str, x.collect())) for x in (lists, cells))
    assert lists == cells and len(lists) > 10 and any("beton" in r for r in lists)


def test_snap_to_dimension_of_small_pages(spark):
    rng = random.Random(23)
    dims = spark.createDataFrame(
        [(p, s, None if i % 19 == 0 else float(rng.randint(0, 12) * 15), float(rng.randint(0, 12) * 15), rng.choice([100.0, 104.0, 96.0, 300.0, 312.0])) for i, (p, s) in enumerate(pages(rng, 14))] * 2,
        PAGE + "x double, y double, cm double")
    walls = spark.createDataFrame(
        [(f"w{i:03}", p, s, float(rng.randint(0, 12) * 15), float(rng.randint(0, 12) * 15), rng.choice([100.0, 305.0, 500.0])) for i, (p, s) in enumerate(pages(rng, 15))],
        "wand_id string, " + PAGE + "cx double, cy double, cm_gemessen double")
    lists, cells = (S.snap_to_dimension(walls, dims, most=most) for most in (400, 0))
    assert "Aggregate" not in lists._jdf.queryExecution().executedPlan().toString()  # no pair leaves the join
    lists, cells = (sorted(map(tuple, x.collect())) for x in (lists, cells))
    assert lists == cells and len(lists) == walls.count() and 10 < sum(r[2] for r in lists) < len(lists)


def test_scatter_of_heights_at_its_limit(spark):
    from qtospark.plans import quality

    limit = [2.3, 2.6, 2.9]  # a deviation of exactly 0.30, by doubles just below or above it
    rows = [(k, h + 0.01 * k) for k in range(40) for h in limit] + [(90, 2.3), (90, 2.6), (90, 2.91), (91, 2.5), (91, 1e6), (91, 2.6), (92, 2.3), (92, 3.9)]
    rooms = spark.createDataFrame([(k, f"r{i:03}", "Bad", round(h, 2)) for i, (k, h) in enumerate(rows)], "projekt_id int, room_id string, name string, hoehe_m double")
    doubles = rooms.groupBy("projekt_id").agg(F.stddev_samp("hoehe_m").alias("s")).filter("s > 0.3 AND projekt_id < 40").count()
    found = quality.height_findings(rooms).filter("check = 'hoehen_streuung'")
    assert doubles > 0 and {r.projekt_id for r in found.collect()} == {90, 91}


def test_totals_of_projects_carry_no_room_keys(spark):
    from qtospark.plans import trades
    from qtospark.sources import adapters

    rooms, openings, building = (adapters.table(spark, "/root/testdata/sf0.001", n) for n in ("rooms", "openings", "building"))
    best = trades.best_building(building)
    lines = [trades.trade_lines(rooms, openings, best, ["putz", "fliesen"], by_room=b) for b in (True, False)]
    assert lines[1].filter("rkey IS NOT NULL").isEmpty() and not lines[0].filter("rkey IS NOT NULL").isEmpty()
    keyed, free = (sorted(map(str, trades.positions(x).withColumn("endsumme", F.round("endsumme", 3)).collect())) for x in lines)
    assert keyed == free and len(free) > 50
    plan = trades.assign_openings(rooms, openings)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    deal = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = [line for i, line in enumerate(plan) if i > deal and depth(line) > depth(plan[deal]) and all(depth(x) > depth(plan[deal]) for x in plan[deal + 1:i])]
    assert below and not any("md5(" in line for line in below)
