"""Queries of the quantity core."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import openings as op
from ..functions.numbers import sql_round
from ..functions.similarity import with_category
from ..functions.text import is_wet_room, tile_height
from ..plans import trades as T
from . import Tables, query

KAT = """(CASE WHEN name IN ('Wohnzimmer','Schlafzimmer','Küche','Bad','WC','Flur','Vorraum','Kinderzimmer 1',
 'Kinderzimmer 2','Abstellraum','Bad-WC','Wohnküche','Zimmer 3','Büro','Waschküche') THEN 'Innenraum_warm'
 WHEN name IN ('Terrasse','Loggia','Terasse') THEN 'Loggia' WHEN name = 'Stiegenhaus' THEN 'Stiegenhaus'
 WHEN name IN ('Keller','Garage','Technik') THEN 'Nebenraum_kalt' END)"""
WET = "(name IN ('Bad','WC','Bad-WC','Waschküche'))"
NK = "lower(regexp_replace({c}, '[\\s\\-_/]+', '', 'g'))"
TILE = "(CASE WHEN name = 'WC' THEN 1.5 ELSE 2.0 END)"

BD = """
, bd0 AS (SELECT * FROM building QUALIFY row_number() OVER (PARTITION BY projekt_id ORDER BY konfidenz DESC, rang DESC, plan_id DESC) = 1)
, bd AS (SELECT projekt_id, firma_id, anzahl_saeulen, anzahl_kamine, aussenwand_flaeche_m2, aussenumfang_m, bodenplatte_m2, decke_m2, quelle_h,
   CASE WHEN aussenwand_cm > 0 THEN aussenwand_cm ELSE 38.0 END::DOUBLE AS aussenwand_cm,
   CASE WHEN innenwand_tragend_cm > 0 THEN innenwand_tragend_cm ELSE 25.0 END::DOUBLE AS innenwand_tragend_cm,
   CASE WHEN decke_cm > 0 THEN decke_cm ELSE 20.0 END::DOUBLE AS decke_cm,
   CASE WHEN bodenplatte_cm > 0 THEN bodenplatte_cm ELSE 25.0 END::DOUBLE AS bodenplatte_cm,
   CASE WHEN geschosshoehe_m > 0 THEN geschosshoehe_m ELSE 2.7 END::DOUBLE AS geschosshoehe_m FROM bd0)
"""
FACTS = BD + f"""
, facts AS (SELECT r.*, {KAT} AS kat, {WET} AS nass, nullif(r.umfang_m, 0) AS u, nullif(r.flaeche_m2, 0) AS f,
   coalesce(nullif(r.hoehe_m, 0), b.geschosshoehe_m) AS h, b.aussenwand_cm, b.innenwand_tragend_cm, b.decke_cm, b.bodenplatte_cm,
   b.decke_m2, b.bodenplatte_m2
  FROM rooms r JOIN bd b USING (projekt_id))
"""


def assign_sql(out: str = "asg", rooms: str = "rooms") -> str:
    return f"""
, {out}_r AS (SELECT room_id, projekt_id, {NK.format(c='name')} AS nk, cx, cy FROM {rooms})
, {out}_o AS (SELECT opening_id, projekt_id, cx, cy, {NK.format(c='raum')} AS nk FROM openings)
, {out}_n AS (SELECT projekt_id, nk, count(*) AS n, min(room_id) AS one FROM {out}_r GROUP BY ALL)
, {out}_t AS (SELECT o.*, n.n, n.one FROM {out}_o o LEFT JOIN {out}_n n USING (projekt_id, nk))
, {out}_near AS (SELECT t.opening_id, r.room_id FROM {out}_t t JOIN {out}_r r USING (projekt_id, nk) WHERE t.n > 1 AND t.cx IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY t.opening_id ORDER BY sqrt((t.cx-r.cx)*(t.cx-r.cx)+(t.cy-r.cy)*(t.cy-r.cy)), r.room_id) = 1)
, {out}_turn AS (SELECT opening_id, projekt_id, nk, (row_number() OVER (PARTITION BY projekt_id, nk ORDER BY md5(opening_id), opening_id) - 1) % n AS seat
   FROM {out}_t WHERE n > 1 AND cx IS NULL)
, {out}_seat AS (SELECT room_id, projekt_id, nk, row_number() OVER (PARTITION BY projekt_id, nk ORDER BY md5(room_id), room_id) - 1 AS seat FROM {out}_r)
, {out}_any AS (SELECT t.opening_id, r.room_id FROM {out}_t t JOIN {out}_r r USING (projekt_id) WHERE t.n IS NULL AND t.cx IS NOT NULL
   AND sqrt((t.cx-r.cx)*(t.cx-r.cx)+(t.cy-r.cy)*(t.cy-r.cy)) < 400
   QUALIFY row_number() OVER (PARTITION BY t.opening_id ORDER BY sqrt((t.cx-r.cx)*(t.cx-r.cx)+(t.cy-r.cy)*(t.cy-r.cy)), r.room_id) = 1)
, {out} AS (SELECT opening_id, one AS room_id, 'name' AS zuordnung FROM {out}_t WHERE n = 1
  UNION ALL SELECT opening_id, room_id, 'name_position' FROM {out}_near
  UNION ALL SELECT opening_id, room_id, 'reihum' FROM {out}_turn JOIN {out}_seat USING (projekt_id, nk, seat)
  UNION ALL SELECT opening_id, room_id, 'position' FROM {out}_any)
"""


OUTER = "(CASE WHEN wand_typ IS NOT NULL THEN lower(wand_typ) LIKE 'a%' ELSE art <> 'tuer' END)"


def net_sql(limit: float, wand: str, b: str = "coalesce(breite_m,0)", h: str = "coalesce(o_h,0)") -> dict:
    over = f"({b}*{h} > {limit})"
    depth = f"greatest(0.04, {wand}/100.0 - 0.06)"
    around = f"(2*{h} + {b} + CASE WHEN fph_m > 0.15 THEN {b} ELSE 0 END)"
    return {
        "over": over, "abzug": f"round({b}*{h}, 3)", "tiefe": f"round({depth}, 3)",
        "laibung": f"round({depth}*{around}, 3)", "abw": around,
    }


def _wall_trade(trade: str, limit: float) -> str:
    n = net_sql(limit, "wand")
    return f"""
 SELECT projekt_id, rkey, '{trade}' AS gewerk, CASE WHEN h > 3.2 THEN '1.1h' ELSE '1.1' END AS posnr, 'm²' AS einheit, u*h AS wert FROM fk WHERE kat = 'Innenraum_warm' AND u IS NOT NULL
 UNION ALL SELECT projekt_id, rkey, '{trade}', '1.2', 'm²', f FROM fk WHERE kat = 'Innenraum_warm' AND f IS NOT NULL
 UNION ALL SELECT projekt_id, rkey, '{trade}', CASE WHEN h > 3.2 THEN '1.1h' ELSE '1.1' END, 'm²', -{n['abzug']} FROM ao WHERE {n['over']}
 UNION ALL SELECT projekt_id, rkey, '{trade}', '1.1a', 'lfm', {n['abw']} FROM ao WHERE {n['over']} AND {n['tiefe']} <= 0.25
 UNION ALL SELECT projekt_id, rkey, '{trade}', '1.1b', 'm²', {n['laibung']} FROM ao WHERE {n['over']} AND {n['tiefe']} > 0.25"""


def _facade(trade: str, pos: str, limit: float) -> str:
    n = net_sql(limit, "aussenwand_cm")
    return f"""
 SELECT projekt_id, NULL AS rkey, '{trade}' AS gewerk, '{pos}' AS posnr, 'm²' AS einheit, round(aussenwand_flaeche_m2, 2) AS wert FROM bd WHERE aussenwand_flaeche_m2 > 0
 UNION ALL SELECT projekt_id, NULL, '{trade}', '{pos}', 'm²', -{n['abzug']} FROM fo WHERE {n['over']}"""


RKEY = "name || '|' || wohnung || '|' || geschoss || '|' || coalesce(format('{:.2f}', flaeche_m2), '')"
AO = assign_sql() + f"""
, fk AS (SELECT *, {RKEY} AS rkey FROM facts)
, ao AS (SELECT k.projekt_id, k.rkey, k.h, o.breite_m, o.hoehe_m AS o_h, o.fph_m,
   CASE WHEN {OUTER.replace('wand_typ', 'o.wand_typ').replace('art', 'o.art', 1)} THEN k.aussenwand_cm ELSE k.innenwand_tragend_cm END AS wand
  FROM asg JOIN openings o USING (opening_id) JOIN fk k USING (room_id) WHERE k.kat = 'Innenraum_warm' AND k.u IS NOT NULL)
, fo AS (SELECT o.projekt_id, o.breite_m, o.hoehe_m AS o_h, o.fph_m, b.aussenwand_cm FROM openings o JOIN bd b USING (projekt_id)
   WHERE {OUTER} AND b.aussenwand_flaeche_m2 > 0)
"""
_nd = net_sql(4.0, "aussenwand_cm")
LINES = {
    "putz": _wall_trade("putz", 4.0) + " UNION ALL " + _facade("putz", "1.3", 4.0),
    "maler": _wall_trade("maler", 2.5),
    "rohbau": _facade("rohbau", "1.0", 0.5) + """
 UNION ALL SELECT projekt_id, rkey, 'rohbau', '1.1', 'm²', u*h FROM fk WHERE kat = 'Innenraum_warm' AND u IS NOT NULL
 UNION ALL SELECT projekt_id, rkey, 'rohbau', '1.2', 'm³', f*(decke_cm/100.0) FROM fk WHERE kat = 'Innenraum_warm' AND f IS NOT NULL AND coalesce(decke_m2,0) = 0
 UNION ALL SELECT projekt_id, rkey, 'rohbau', '1.2', 'm³', -f*(decke_cm/100.0) FROM fk WHERE kat = 'Stiegenhaus' AND f IS NOT NULL AND coalesce(decke_m2,0) <> 0
 UNION ALL SELECT projekt_id, NULL, 'rohbau', '1.2', 'm³', decke_m2*decke_cm/100.0 FROM bd WHERE decke_m2 <> 0
 UNION ALL SELECT projekt_id, rkey, 'rohbau', '1.3', 'm³', f*bodenplatte_cm/100.0 FROM fk WHERE kat = 'Innenraum_warm' AND f IS NOT NULL AND coalesce(bodenplatte_m2,0) = 0
 UNION ALL SELECT projekt_id, NULL, 'rohbau', '1.3', 'm³', bodenplatte_m2*bodenplatte_cm/100.0 FROM bd WHERE bodenplatte_m2 <> 0""",
    "beton": """ SELECT projekt_id, NULL AS rkey, 'beton' AS gewerk, '1.1' AS posnr, 'm³' AS einheit, anzahl_saeulen*0.5::DOUBLE AS wert FROM bd WHERE anzahl_saeulen > 0
 UNION ALL SELECT projekt_id, NULL, 'beton', '1.2', 'Stk', anzahl_kamine::DOUBLE FROM bd WHERE anzahl_kamine > 0""",
    "estrich": """ SELECT projekt_id, rkey, 'estrich' AS gewerk, '1.1' AS posnr, 'm²' AS einheit, f AS wert FROM fk WHERE kat = 'Innenraum_warm' AND f IS NOT NULL
 UNION ALL SELECT projekt_id, rkey, 'estrich', '1.2', 'lfm', u FROM fk WHERE kat = 'Innenraum_warm' AND u IS NOT NULL""",
    "daemmung": _facade("daemmung", "1.1", 4.0) + f"""
 UNION ALL SELECT projekt_id, NULL, 'daemmung', '1.1a', 'lfm', {_nd['abw']} FROM fo WHERE {_nd['over']} AND {_nd['tiefe']} <= 0.25
 UNION ALL SELECT projekt_id, NULL, 'daemmung', '1.1b', 'm²', {_nd['laibung']} FROM fo WHERE {_nd['over']} AND {_nd['tiefe']} > 0.25""",
    "geruest": " SELECT projekt_id, NULL AS rkey, 'geruest' AS gewerk, '1.1' AS posnr, 'm²' AS einheit, round(aussenwand_flaeche_m2, 2) AS wert FROM bd WHERE aussenwand_flaeche_m2 > 0",
}
TILES = assign_sql("wsg", "wet") + f"""
, wo AS (SELECT w.projekt_id, {RKEY.replace('name','w.name').replace('wohnung','w.wohnung').replace('geschoss','w.geschoss').replace('flaeche_m2','w.flaeche_m2')} AS rkey, coalesce(breite_m,0) AS b, coalesce(o.hoehe_m,0) AS oh, fph_m, {TILE.replace('name','w.name')} AS th
   FROM wsg JOIN openings o USING (opening_id) JOIN wet w USING (room_id) WHERE w.u IS NOT NULL)
, wb AS (SELECT *, least(th, fph_m + oh) - greatest(0, fph_m) AS band FROM wo)
"""
LINES["fliesen"] = f""" SELECT projekt_id, rkey, 'fliesen' AS gewerk, '1.1' AS posnr, 'm²' AS einheit, f AS wert FROM fk WHERE nass AND f IS NOT NULL
 UNION ALL SELECT projekt_id, rkey, 'fliesen', '1.2', 'm²', u*{TILE} FROM fk WHERE nass AND u IS NOT NULL
 UNION ALL SELECT projekt_id, rkey, 'fliesen', '1.2', 'm²', -round(b*band, 2) FROM wb WHERE b > 0 AND band > 0 AND round(b*band, 2) >= 0.1"""
EARTH = """
, eb AS (SELECT projekt_id, bool_or(upper(geschoss) IN ('KG','UG')) AS keller,
   sum(CASE WHEN upper(geschoss) IN ('KG','UG') AND kat IN ('Innenraum_warm','Nebenraum_kalt','Stiegenhaus') THEN coalesce(f,0) ELSE 0 END) AS f_kg,
   sum(CASE WHEN upper(geschoss) IN ('EG','') AND kat IN ('Innenraum_warm','Nebenraum_kalt','Stiegenhaus') THEN coalesce(f,0) ELSE 0 END) AS f_eg FROM facts GROUP BY 1)
, ed AS (SELECT b.projekt_id, coalesce(nullif(b.bodenplatte_m2,0), CASE WHEN coalesce(keller,false) THEN f_kg ELSE f_eg END) AS slab, b.aussenumfang_m,
   CASE WHEN coalesce(keller,false) THEN 2.6 ELSE 0.5 END AS dig FROM bd b LEFT JOIN eb USING (projekt_id))
, ee AS (SELECT *, coalesce(nullif(aussenumfang_m,0), 4*sqrt(slab)) AS umf FROM ed WHERE slab > 0)
"""
LINES["erdarbeiten"] = """ SELECT projekt_id, NULL AS rkey, 'erdarbeiten' AS gewerk, '1.1' AS posnr, 'm³' AS einheit, (slab+umf*0.8)*0.2 AS wert FROM ee
 UNION ALL SELECT projekt_id, NULL, 'erdarbeiten', '1.2', 'm³', (slab+umf*0.8)*dig FROM ee
 UNION ALL SELECT projekt_id, NULL, 'erdarbeiten', '1.3', 'm³', slab*0.15 FROM ee
 UNION ALL SELECT projekt_id, NULL, 'erdarbeiten', '1.4', 'm³', umf*0.8*dig FROM ee"""
LINES["fenster"] = f""" SELECT projekt_id, NULL AS rkey, 'fenster' AS gewerk, CASE WHEN art <> 'tuer' THEN '1.1' WHEN {OUTER} THEN '1.2' ELSE '1.3' END AS posnr,
   'Stk' AS einheit, count(*)::DOUBLE AS wert FROM openings GROUP BY projekt_id, 4, round(coalesce(breite_m,0),2), round(coalesce(hoehe_m,0),2)"""
POS = """ SELECT projekt_id, gewerk, posnr, einheit, round(sum(round(wert, 4)), 3) AS endsumme, count(*) AS n_zeilen FROM lines GROUP BY ALL"""
WETCTE = ", wet AS (SELECT * FROM facts WHERE nass)"


def lines_sql(trades: list[str]) -> str:
    pre = FACTS + AO
    if "fliesen" in trades:
        pre += WETCTE + TILES
    if "erdarbeiten" in trades:
        pre += EARTH
    return pre + ", lines AS (" + " UNION ALL ".join(f"SELECT * FROM ({LINES[t]})" for t in trades) + ")"


def _lines(t: Tables, trades: list[str] | None, by_room: bool = False):
    return T.trade_lines(t.rooms, t.openings, T.best_building(t.building), trades, by_room=by_room)


def _register(name: str, trade: str, ids: str):
    @query(name, ids, lines_sql([trade]) + POS, "rooms openings building")
    def run(t: Tables):
        return T.positions(_lines(t, [trade])).withColumn("endsumme", sql_round(F.col("endsumme"), 3))


_register("trade_plaster", "putz", "C1 A1 F17 F18 F19 F21 J1 J2 J3 J4 P4")
_register("trade_structure", "rohbau", "C2 A3 F18")
_register("trade_screed", "estrich", "C3")
_register("trade_painter", "maler", "C4 F19")
_register("trade_concrete", "beton", "C5")
_register("trade_tiles", "fliesen", "C6 P3")
_register("trade_windows", "fenster", "C7 A5")
_register("trade_insulation", "daemmung", "C8")
_register("trade_scaffolding", "geruest", "C9")
_register("trade_earthworks", "erdarbeiten", "C10")
ALL = list(T.TRADES)


@query("trade_all_positions", "C11", lines_sql(ALL) + POS, "rooms openings building")
def trade_all(t: Tables):
    return T.positions(_lines(t, None)).withColumn("endsumme", sql_round(F.col("endsumme"), 3))


@query("trade_totals", "A42 S13", lines_sql(ALL) + """
 SELECT coalesce(gewerk, 'GESAMT') AS gewerk, coalesce(einheit, '') AS einheit, round(sum(round(wert, 4)), 2) AS summe, count(*) AS n
 FROM lines GROUP BY GROUPING SETS ((gewerk, einheit), (einheit))""", "rooms openings building")
def trade_totals(t: Tables):
    lines = _lines(t, None)
    # one rollup-style pass: per trade and unit, and per unit over all trades
    return (
        lines.groupingSets([["gewerk", "einheit"], ["einheit"]], "gewerk", "einheit")
        .agg(sql_round(F.sum(sql_round(F.col("wert"), 4)), 2).alias("summe"), F.count(F.lit(1)).alias("n"))
        .select(F.coalesce("gewerk", F.lit("GESAMT")).alias("gewerk"), F.coalesce("einheit", F.lit("")).alias("einheit"), "summe", "n")
    )


@query("opening_room_assignment", "J1 J2 J3 J4", assign_sql() + "SELECT opening_id, room_id, zuordnung FROM asg", "rooms openings")
def assignment(t: Tables):
    return T.assign_openings(t.rooms, t.openings)


@query("opening_piece_list", "A5 C7", f"""
 SELECT projekt_id, CASE WHEN art <> 'tuer' THEN '1.1' WHEN {OUTER} THEN '1.2' ELSE '1.3' END AS posnr,
  round(coalesce(breite_m,0),2) AS b, round(coalesce(hoehe_m,0),2) AS h, count(*) AS anzahl,
  coalesce(array_to_string(list_sort(list_distinct(list(code) FILTER (WHERE code IS NOT NULL))), ', '), '') AS codes
 FROM openings GROUP BY 1, 2, 3, 4""", "openings")
def piece_list(t: Tables):
    return T.opening_piece_list(t.openings).select("projekt_id", "posnr", "b", "h", "anzahl", "codes")


_ns = net_sql(4.0, "wand", h="coalesce(hoehe_m,0)")


@query("opening_schedule", "C12 F18 P4 F17 F21", BD + f"""
, x AS (SELECT o.*, {OUTER} AS aussen, CASE WHEN {OUTER} THEN b.aussenwand_cm ELSE b.innenwand_tragend_cm END AS wand FROM openings o JOIN bd b USING (projekt_id))
 SELECT opening_id, projekt_id, raum, art AS typ, CASE WHEN aussen THEN 'AW' ELSE 'IW' END AS wand, round(coalesce(breite_m,0),2) AS breite_m,
  round(coalesce(hoehe_m,0),2) AS hoehe_m, round(coalesce(breite_m,0)*coalesce(hoehe_m,0),3) AS flaeche_m2,
  CASE WHEN {_ns['over']} THEN 'Abzug + Laibung' ELSE 'übermessen' END AS regel,
  CASE WHEN {_ns['over']} THEN {_ns['abzug']} ELSE 0 END AS abzug_m2, CASE WHEN {_ns['over']} THEN {_ns['laibung']} ELSE 0 END AS laibung_m2,
  ({_ns['over']} AND fph_m > 0.15) AS sohlbank FROM x""", "openings building")
def schedule(t: Tables):
    return T.opening_schedule(t.openings, T.best_building(t.building))


@query("opening_schedule_summary", "C12", BD + f"""
, x AS (SELECT o.*, CASE WHEN {OUTER} THEN b.aussenwand_cm ELSE b.innenwand_tragend_cm END AS wand FROM openings o JOIN bd b USING (projekt_id))
 SELECT projekt_id, count(*) AS n, count(*) FILTER (WHERE NOT {_ns['over']}) AS n_uebermessen, count(*) FILTER (WHERE {_ns['over']}) AS n_abzug,
  round(sum(CASE WHEN {_ns['over']} THEN {_ns['abzug']} ELSE 0 END), 4) AS abzug_m2, round(sum(CASE WHEN {_ns['over']} THEN {_ns['laibung']} ELSE 0 END), 4) AS laibung_m2
 FROM (SELECT * REPLACE (coalesce(breite_m,0) AS breite_m, coalesce(hoehe_m,0) AS hoehe_m) FROM x) GROUP BY 1""", "openings building")
def schedule_summary(t: Tables):
    s = T.opening_schedule(t.openings, T.best_building(t.building))
    return s.groupBy("projekt_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("abzug_m2") == 0).alias("n_uebermessen"),
        F.count_if(F.col("abzug_m2") > 0).alias("n_abzug"), F.round(F.sum("abzug_m2"), 4).alias("abzug_m2"),
        F.round(F.sum("laibung_m2"), 4).alias("laibung_m2"))


@query("crosstab_cells", "A45 F7", lines_sql(ALL) + """
 SELECT projekt_id, rkey, gewerk || '::' || posnr AS skey, round(sum(wert), 3) AS menge FROM lines WHERE rkey IS NOT NULL GROUP BY ALL HAVING abs(sum(wert)) >= 0.005""", "rooms openings building")
def crosstab_cells(t: Tables):
    cells, _ = T.crosstab(_lines(t, ALL, by_room=True))
    return cells.withColumn("menge", sql_round(F.col("menge"), 3))


@query("crosstab_wide", "A45", lines_sql(["estrich"]) + """
 SELECT projekt_id, rkey, round(sum(wert) FILTER (WHERE posnr='1.1'), 3) AS flaeche, round(sum(wert) FILTER (WHERE posnr='1.2'), 3) AS rand
 FROM lines WHERE rkey IS NOT NULL GROUP BY 1, 2""", "rooms openings building")
def crosstab_wide(t: Tables):
    cells, _ = T.crosstab(_lines(t, ["estrich"], by_room=True))
    w = T.crosstab_pivot(cells, ["estrich::1.1", "estrich::1.2"])
    return w.select("projekt_id", "rkey", F.round("`estrich::1.1`", 3).alias("flaeche"), F.round("`estrich::1.2`", 3).alias("rand"))


@query("crosstab_coverage", "A45", lines_sql(ALL) + """
, c AS (SELECT projekt_id, rkey, gewerk, posnr, sum(wert) AS m FROM lines WHERE rkey IS NOT NULL GROUP BY ALL)
, v AS (SELECT projekt_id, sum(abs(m)) AS verankert FROM c GROUP BY 1)
, w AS (SELECT projekt_id, sum(abs(wert)) AS frei FROM lines WHERE rkey IS NULL GROUP BY 1)
 SELECT projekt_id, round(coalesce(verankert,0), 3) AS verankert, round(coalesce(frei,0), 3) AS frei,
  round(coalesce(verankert,0) / (coalesce(verankert,0)+coalesce(frei,0)) * 100, 5) AS deckung_pct FROM v FULL JOIN w USING (projekt_id)""", "rooms openings building")
def crosstab_coverage(t: Tables):
    _, cover = T.crosstab(_lines(t, ALL, by_room=True))
    return cover.select("projekt_id", sql_round(F.col("verankert"), 3).alias("verankert"), sql_round(F.col("frei"), 3).alias("frei"), sql_round(F.col("deckung_pct"), 5).alias("deckung_pct"))


_OWN_RULES = """(SELECT projekt_id, '9.' || CAST(projekt_id % 7 AS STRING) AS posnr,
 CASE projekt_id % 7 WHEN 0 THEN 'boden' WHEN 1 THEN 'wand_netto' WHEN 2 THEN 'wand_brutto' WHEN 3 THEN 'umfang' WHEN 4 THEN 'sockel' WHEN 5 THEN 'decke' ELSE 'unbekannt' END AS regel,
 CASE WHEN projekt_id % 3 = 0 THEN 'WC' ELSE NULL END AS raum_filter, CAST(projekt_id % 4 AS DOUBLE) AS verschnitt_pct
 FROM (SELECT DISTINCT projekt_id FROM {rooms}) p)"""
_n4 = net_sql(4.0, "25.0", b="coalesce(o.breite_m,0)", h="coalesce(o.hoehe_m,0)")


@query("own_positions", "C13", FACTS + assign_sql() + f"""
, pr AS (SELECT a.room_id, sum(CASE WHEN {_n4['over']} THEN {_n4['abzug']} ELSE 0 END) AS abz, sum(CASE WHEN o.art='tuer' THEN coalesce(o.breite_m,0) END) AS tb
   FROM asg a JOIN openings o USING (opening_id) GROUP BY 1)
, rl AS {_OWN_RULES.format(rooms='rooms')}
, q AS (SELECT f.*, coalesce(abz,0) AS abz, coalesce(tb,0) AS tb FROM facts f LEFT JOIN pr USING (room_id))
, v AS (SELECT rl.projekt_id, posnr, regel, verschnitt_pct, CASE regel WHEN 'boden' THEN f WHEN 'decke' THEN f WHEN 'umfang' THEN u WHEN 'wand_brutto' THEN u*h
   WHEN 'wand_netto' THEN u*h-abz WHEN 'sockel' THEN (CASE WHEN u IS NOT NULL THEN greatest(0, u-tb) END) END AS wert FROM rl JOIN q USING (projekt_id)
   WHERE raum_filter IS NULL OR {NK.format(c='raum_filter')} = {NK.format(c='name')})
 SELECT projekt_id, posnr, regel, round(sum(wert), 3) AS menge, count(*) AS n_zeilen, round(sum(wert)*(1+verschnitt_pct/100.0), 5) AS endsumme
 FROM v WHERE wert IS NOT NULL GROUP BY projekt_id, posnr, regel, verschnitt_pct""", "rooms openings building")
def own_positions(t: Tables):
    rules = t.rooms.select("projekt_id").distinct().selectExpr(
        "projekt_id", "'9.' || CAST(projekt_id % 7 AS STRING) AS posnr",
        "CASE projekt_id % 7 WHEN 0 THEN 'boden' WHEN 1 THEN 'wand_netto' WHEN 2 THEN 'wand_brutto' WHEN 3 THEN 'umfang' WHEN 4 THEN 'sockel' WHEN 5 THEN 'decke' ELSE 'unbekannt' END AS regel",
        "CASE WHEN projekt_id % 3 = 0 THEN 'WC' END AS raum_filter", "CAST(projekt_id % 4 AS DOUBLE) AS verschnitt_pct")
    r = T.own_positions(rules, t.rooms, t.openings, T.best_building(t.building))
    return r.select("projekt_id", "posnr", "regel", F.round("menge", 3).alias("menge"), "n_zeilen", F.round("endsumme", 5).alias("endsumme"))


@query("room_categories", "P1 P2 P3 F25 X1", f"""
 SELECT room_id, {KAT} AS kategorie, {WET} AS nass, (nullif(umfang_m,0) IS NULL AND {KAT} IS NULL AND coalesce(flaeche_m2,0) >= 100) AS aussenanlage FROM rooms""", "rooms")
def room_categories(t: Tables):
    u = F.coalesce(F.col("umfang_m"), F.lit(0.0)) == 0
    big = F.coalesce("flaeche_m2", F.lit(0.0)) >= 100.0
    return with_category(t.rooms.select("room_id", "name", "umfang_m", "flaeche_m2")).select(
        "room_id", "kategorie", is_wet_room(F.col("name")).alias("nass"),
        (u & F.col("kategorie").isNull() & big).alias("aussenanlage"))


@query("building_defaults", "A21 C11 J28", BD + "SELECT projekt_id, aussenwand_cm, innenwand_tragend_cm, decke_cm, bodenplatte_cm, geschosshoehe_m FROM bd", "building")
def building_defaults(t: Tables):
    return T.fill_building(T.best_building(t.building)).select(
        "projekt_id", "aussenwand_cm", "innenwand_tragend_cm", "decke_cm", "bodenplatte_cm", "geschosshoehe_m")


@query("room_schedule", "C29 A42", FACTS + f"""
, k AS (SELECT projekt_id, geschoss, f, u, u*h AS wand FROM facts WHERE kat = 'Innenraum_warm')
 SELECT projekt_id, coalesce(geschoss, 'GESAMT') AS geschoss, round(sum(f), 3) AS boden, round(sum(f), 3) AS decke, round(sum(wand), 3) AS wand, round(sum(u), 3) AS sockel, count(*) AS n
 FROM k GROUP BY GROUPING SETS ((projekt_id, geschoss), (projekt_id))""", "rooms building")
def room_schedule(t: Tables):
    f = T.room_facts(t.rooms, T.best_building(t.building)).filter("innen")
    return (
        f.groupingSets([["projekt_id", "geschoss"], ["projekt_id"]], "projekt_id", "geschoss")
        .agg(F.round(F.sum("f"), 3).alias("boden"), F.round(F.sum("f"), 3).alias("decke"),
             F.round(F.sum(F.col("u") * F.col("h")), 3).alias("wand"), F.round(F.sum("u"), 3).alias("sockel"),
             F.count(F.lit(1)).alias("n"))
        .select("projekt_id", F.coalesce("geschoss", F.lit("GESAMT")).alias("geschoss"), "boden", "decke", "wand", "sockel", "n")
    )


@query("deduction_rules", "F17 F19 F20 F21", """
, x AS (SELECT opening_id, coalesce(breite_m,0)*coalesce(hoehe_m,0) AS a FROM openings)
 SELECT opening_id, a > 4.0 AS abzug_putz, a > 2.5 AS abzug_maler, a > 0.5 AS abzug_rohbau FROM x""", "openings")
def deduction_rules(t: Tables):
    a = op.opening_area(F.col("breite_m"), F.col("hoehe_m"))
    return t.openings.select("opening_id", *[(a > op.threshold(g)).alias(f"abzug_{g}") for g in ("putz", "maler", "rohbau")])
