"""Golden lists and invariants of the domain jobs."""

import pytest
from pyspark.sql import functions as F

from qtospark.plans import calibration as K
from qtospark.plans import materials as M
from qtospark.plans import merge as G
from qtospark.plans import spans as S
from qtospark.plans import trades as T
from qtospark.plans import truth as R

# fixed values: rooms, building data and openings of one house, and its foreman's list
ROOMS = [
    ("Zimmer 1", 10.53, 13.20, 2.95), ("Bad", 8.75, 11.90, 2.70), ("Zimmer 2", 19.66, 19.55, 2.95), ("Flur", 15.84, 22.57, 2.70),
    ("WC", 1.83, 5.68, 2.95), ("Waschen", 6.20, 10.98, 2.95), ("Wohnraum Küche", 31.12, 25.95, 2.95),
    ("Terrasse überdacht", 60.74, 37.46, 2.95), ("Parkplatz überdacht", 36.00, 24.00, 2.95), ("Geräte-Abstellraum", 14.82, 16.67, 2.95),
]
WINDOWS = [(1.30, 1.28), (1.30, 1.28), (1.30, 1.28), (0.90, 0.88), (0.60, 0.60), (0.60, 0.58), (0.60, 0.60)]
DOORS = [(0.80, 2.05), (0.80, 2.05), (0.80, 2.20), (0.80, 2.30), (0.80, 2.05), (2.20, 2.00)]
EXPECTED = [
    ("Bodenplatte", "EKV", 125, 0.12), ("Bodenplatte", "XPS-SF G30 120", 125, 0.12), ("Bodenplatte", "AQ 65", 25, 0.15), ("Bodenplatte", "PE-Folie", 3, 0.40),
    ("Bodenplatte", "C16/20", 13, 0.25), ("Frostschürze", "XPS-SF G30 140", 75, 0.20), ("Frostschürze", "Noppenfolie", 75, 0.20), ("Frostschürze", "Steckeisen", 125, 0.25),
    ("Mauerwerk EG", "HLZ 50", 48, 0.15), ("Mauerwerk EG", "HLZ 12", 7, 0.22), ("Decke über EG", "Schaltafel", 250, 0.15), ("Decke über EG", "EKV", 340, 0.15), ("Decke über EG", "ISO-Korb", 48, 0.20),
]


@pytest.fixture(scope="module")
def house(spark):
    rooms = spark.createDataFrame([(f"r{i}", 1, "EG", *r) for i, r in enumerate(ROOMS)], "room_id string, projekt_id long, geschoss string, name string, flaeche_m2 double, umfang_m double, hoehe_m double")
    rooms = rooms.withColumn("wohnung", F.lit("TOP 1")).withColumn("cx", F.lit(None).cast("double")).withColumn("cy", F.lit(None).cast("double")).withColumn("bodenbelag", F.lit("Fliesen"))
    op = [(f"w{i}", 1, "fenster", b, h) for i, (b, h) in enumerate(WINDOWS)] + [(f"t{i}", 1, "tuer", b, h) for i, (b, h) in enumerate(DOORS)]
    openings = spark.createDataFrame(op, "opening_id string, projekt_id long, art string, breite_m double, hoehe_m double")
    for c, t in (("wand_typ", "string"), ("code", "string"), ("raum", "string"), ("cx", "double"), ("cy", "double")):
        openings = openings.withColumn(c, F.lit(None).cast(t))
    openings = openings.withColumn("fph_m", F.lit(0.0)).withColumn("quelle", F.lit("text"))
    building = spark.createDataFrame([(1, 50.0, 25.0, 20.0, 25.0, 2.95, 0, 0, 0.95)], "projekt_id long, aussenwand_cm double, innenwand_tragend_cm double, decke_cm double, bodenplatte_cm double, geschosshoehe_m double, anzahl_saeulen int, anzahl_kamine int, konfidenz double")
    for c in ("aussenwand_flaeche_m2", "aussenumfang_m", "bodenplatte_m2", "decke_m2"):
        building = building.withColumn(c, F.lit(None).cast("double"))
    return rooms, openings, building


def test_golden_material_list(spark, house):
    rooms, openings, building = house
    measured = spark.createDataFrame([(1, 62.0, 125.0, None, 0.95, None)], "projekt_id long, aussenumfang_m double, bodenplatte_flaeche_m2 double, fundament_umfang_m double, m_konfidenz double, umfang_konfidenz double")
    dist = spark.createDataFrame([(1, "aussen", 50, 73.3), (1, "aussen", 20, 26.7), (1, "innen", 25, 28.6), (1, "innen", 12, 71.4)], "projekt_id long, seite string, dicke_cm int, pct double")
    over = spark.createDataFrame([(1, "sauberkeitsschicht_cm", 10.0)], "projekt_id long, faktor string, wert double")
    lines = M.material_list(rooms, openings, building, measured, M.params_map(over), dist).collect()
    for part, word, want, tol in EXPECTED:
        got = next(l.menge for l in lines if l.bauteil == part and word.lower() in l.material.lower())
        assert abs(got - want) / want <= tol, (part, word, got, want)
    assert all(l.menge >= 0 and 0 < l.konfidenz <= 1 for l in lines)


def test_lines_sum_to_positions_and_crosstab(house):
    rooms, openings, building = house
    lines = T.trade_lines(rooms, openings, building).cache()
    pos = {(p.gewerk, p.posnr): p.endsumme for p in T.positions(lines).collect()}
    f_innen = sum(r[1] for r in ROOMS if r[0].split()[0] not in ("Terrasse", "Parkplatz"))
    assert abs(pos[("estrich", "1.1")] - f_innen) < 1e-6
    cells, cover = T.crosstab(lines)
    bound = cells.agg(F.sum("menge")).first()[0]
    free = lines.filter("rkey is null").agg(F.sum("wert")).first()[0] or 0.0
    total = lines.agg(F.sum("wert")).first()[0]
    assert abs(bound + free - total) < 1e-6 and 0 < cover.first().deckung_pct <= 100


def test_same_named_rooms_keep_their_numbers(spark, house):
    _, openings, building = house
    rooms = spark.createDataFrame(
        [(f"b{i}", 1, "Bad", f"TOP {i}", "EG", 5.0 + i, 9.0 + i, 2.5, None, None, None) for i in range(3)],
        "room_id string, projekt_id long, name string, wohnung string, geschoss string, flaeche_m2 double, umfang_m double, hoehe_m double, bodenbelag string, cx double, cy double")
    lines = T.trade_lines(rooms, openings, building, ["estrich"])
    assert sorted(r.wert for r in lines.filter("posnr = '1.2'").collect()) == [9.0, 10.0, 11.0]
    assert lines.select("rkey").distinct().count() == 3
    three = spark.createDataFrame([(f"f{i}", 1, "bad") for i in range(3)], "opening_id string, projekt_id long, raum string").withColumn("cx", F.lit(None).cast("double")).withColumn("cy", F.lit(None).cast("double"))
    a = T.assign_openings(rooms, three).collect()
    assert len({r.room_id for r in a}) == 3 and {r.zuordnung for r in a} == {"reihum"}


def test_reference_list_layouts(spark):
    text = "Frostschürze:\nBeton C25/30;48,5;m³\nDecke Beton ......... 1.234,56 m³\n# Notiz\nHLZ 50cm H.I. Plan\n48 Paletten\nNoppenfolie 1m\nMauerwerk:\n12 Stk\n"
    df = spark.createDataFrame([("l", text)], "list_id string, text string")
    got = [(r.bezeichnung, r.menge, r.einheit) for r in K.parse_reference_lists(df).collect()]
    assert got == [("Beton C25/30", 48.5, "m³"), ("Decke Beton .........", 1234.56, "m³"), ("HLZ 50cm H.I. Plan", 48.0, "paletten")]


def test_learned_factor_guards(spark):
    ev = [(1, "bodenplatte_aufschlag", 1.20), (1, "bodenplatte_aufschlag", 1.18), (2, "bodenplatte_aufschlag", 1.2)] + [(3, "decke_auskragung", r) for r in (1.0, 1.02, 1.01, 0.99, 1.6)]
    df = spark.createDataFrame(ev, "firma_id long, faktor string, ratio double")
    got = {r.firma_id: (round(r.wert, 4), r.n_belege) for r in K.learn_factors(df, ["firma_id"]).collect()}
    assert got == {1: (1.3685, 2), 3: (round(1.05 * 1.005, 4), 4)}


def test_wall_shares(spark):
    ref = [(1, "HLZ 50cm H.I. Plan", 48.0), (1, "HLZ 38cm H.I. Plan", 4.0), (1, "HLZ 25cm Plan", 6.0), (1, "HLZ 20cm Plan", 8.0), (1, "HLZ 12cm Plan", 6.0)]
    df = spark.createDataFrame(ref, "list_id long, bezeichnung string, menge double").withColumn("einheit", F.lit("Paletten"))
    got = {r.d: round(r.pct) for r in K.wall_shares(df, ["list_id"]).collect()}
    assert got[50] == 89 and (got[25], got[20], got[12]) == (22, 37, 41)


def test_text_beats_vision(spark):
    rows = [("a", "text", 2.6), ("a", "vision", 3.2), ("b", "text", 2.6), ("b", "vision", 2.62), ("c", "vision", 2.6), ("c", "vision", 2.61), ("d", "text", 2.6)]
    r = {x.k: x for x in R.double_check_numeric(spark.createDataFrame(rows, "k string, t string, v double"), "k", "v", "t", 0.05).collect()}
    assert (r["a"].status, r["a"].wert, r["a"].text_bevorzugt) == ("widerspruch", 2.6, True)
    assert r["b"].status == "bestätigt" and r["c"].status == "verstaerkt" and "d" not in r


def test_count_ensemble(spark):
    rows = [("a", 3.0), ("a", 3.0), ("a", 3.0), ("b", 3.0), ("b", 3.0), ("b", 5.0), ("c", 4.0), ("c", 2.0), ("d", 7.0)]
    anchors = spark.createDataFrame([("d", 8.0), ("e", 2.0)], "k string, text_wert double")
    r = {x.k: x for x in R.reconcile_counts(spark.createDataFrame(rows, "k string, v double"), "k", "v", anchors).collect()}
    assert (r["a"].wert, r["a"].status) == (3, "bestaetigt") and (r["b"].wert, r["b"].status, r["b"].alternativen) == (3, "mehrheit", [5])
    assert (r["c"].wert, r["c"].status) == (2, "unklar") and (r["d"].wert, r["d"].konfidenz) == (8, 0.97) and (r["e"].wert, r["e"].n) == (2, 0)


def test_hull_from_printed_chains(spark):
    h, v = [300.0, 500.0, 448.0], [500.0, 575.0]
    dims = [(f"h{i}", 1, 1, 100.0 + 90 * i, 50.0, c) for i, c in enumerate(h)] + [(f"v{i}", 1, 1, 900.0, 200.0 + 90 * i, c) for i, c in enumerate(v)]
    d = spark.createDataFrame(dims, "span_id string, plan_id long, seite long, x double, y double, cm double")
    fp = spark.createDataFrame([(1, 12.48 * 10.75 / 1.07)], "plan_id long, footprint_m2 double")
    r = S.hull_from_chains(S.chain_sums(d), fp).first()
    assert (r.breite_m, r.tiefe_m, round(r.umfang_m, 2)) == (12.48, 10.75, 46.46)


def _combine(rows):
    out = [dict(r, _art="fenster") for r in rows if r["art"] != "tuer"]
    for t in sorted((r for r in rows if r["art"] == "tuer"), key=lambda r: r["opening_id"]):
        m = None
        for i, w in enumerate(out):
            if None in (t["cx"], w["cx"]) or w["projekt_id"] != t["projekt_id"] or abs(w["cx"] - t["cx"]) > 30 or abs(w["cy"] - t["cy"]) > 30:
                continue
            both = t["breite_m"] and t["hoehe_m"] and w["breite_m"] and w["hoehe_m"]
            if not both or (abs(w["breite_m"] - t["breite_m"]) <= 0.2 and abs(w["hoehe_m"] - t["hoehe_m"]) <= 0.2):
                m = i
                break
        if m is None:
            out.append(t)
    return len(out)


def test_window_door_combination(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(60):
        sized = rnd.random() < 0.95
        rows.append({"opening_id": f"o{i:03d}", "projekt_id": i % 2, "art": "tuer" if i % 2 else "fenster", "cx": float(rnd.randint(0, 6) * 25), "cy": float(rnd.randint(0, 6) * 25),
                     "breite_m": round(rnd.choice([0.8, 0.9, 1.2, 2.0]), 2) if sized else None, "hoehe_m": 2.0 if sized else None})
    rows.sort(key=lambda r: r["opening_id"])
    for r in rows:
        r["projekt_id"] = int(r["opening_id"][1:]) // 30
    df = spark.createDataFrame(rows, "opening_id string, projekt_id long, art string, cx double, cy double, breite_m double, hoehe_m double")
    # sized-only walk equals the list walk; unsized leaders are replaced by a sized door
    sized = [r for r in rows if r["breite_m"]]
    s = df.filter("breite_m is not null")
    assert G.combine_openings(s.filter("art <> 'tuer'"), s.filter("art = 'tuer'")).count() == _combine(sized)
    full = G.combine_openings(df.filter("art <> 'tuer'"), df.filter("art = 'tuer'"))
    assert full.agg(F.sum("n_quellen")).first()[0] == len(rows)


def test_opening_clusters(spark):
    rows = [("a", "Bad", 0.80, 2.00, "text", 0.9), ("b", "Bad", 0.85, 2.02, "text", 0.8), ("c", "Bad", 1.20, 1.20, "text", 0.7), ("d", "Bad", None, None, "text", 0.9),
            ("e", "Bad", 0.8, 2.0, "vision", 0.99), ("f", "WC", 0.6, 0.6, "vision", 0.5), ("g", "WC", None, None, "vision", 0.5)]
    df = spark.createDataFrame([(i, 1, "fenster", r, b, h, q, k, None, None, None) for i, r, b, h, q, k in rows],
                               "opening_id string, projekt_id long, art string, raum string, breite_m double, hoehe_m double, quelle string, konfidenz double, fph_m double, wand_typ string, code string")
    assert {r.leader: r.n for r in G.cluster_openings(df).collect()} == {"a": 2, "c": 1, "f": 1}
