"""Queries of the material order list."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import materials as M
from ..sources.adapters import L_ID
from ..plans.trades import best_building, fill_building
from . import Tables, query
from .trades_q import BD, KAT, OUTER

BASE = BD + f"""
, rk AS (SELECT *, {KAT} AS kat FROM rooms)
, su AS (SELECT projekt_id, sum(CASE WHEN kat='Innenraum_warm' THEN coalesce(flaeche_m2,0) ELSE 0 END) AS f_innen, sum(CASE WHEN kat='Loggia' THEN coalesce(flaeche_m2,0) ELSE 0 END) AS f_loggia,
   sum(CASE WHEN kat='Innenraum_warm' THEN coalesce(umfang_m,0) ELSE 0 END) AS u_innen, sum(coalesce(flaeche_m2,0)) AS f_alle, sum(CASE WHEN kat IN ('Nebenraum_kalt','Loggia') THEN coalesce(flaeche_m2,0) ELSE 0 END) AS f_kalt,
   sum(CASE WHEN contains(lower(name),'garage') THEN coalesce(flaeche_m2,0) ELSE 0 END) AS f_garage, bool_or(contains(lower(name),'garage') AND coalesce(flaeche_m2,0) >= 100) AS halle FROM rk GROUP BY 1)
, de AS (SELECT projekt_id, sum(CASE WHEN {OUTER} AND a > 0.5 THEN round(a,3) ELSE 0 END) AS abzug_aw, sum(CASE WHEN NOT ({OUTER}) AND a > 0.5 THEN round(a,3) ELSE 0 END) AS abzug_iw
   FROM (SELECT *, coalesce(breite_m,0)*coalesce(hoehe_m,0) AS a FROM openings) GROUP BY 1)
, me AS (SELECT projekt_id, CASE WHEN projekt_id % 3 = 0 THEN aussenumfang_m END AS au, CASE WHEN projekt_id % 3 = 0 THEN bodenplatte_m2 END AS bpf FROM bd)
, b0 AS (SELECT s.*, coalesce(abzug_aw,0) AS abzug_aw, coalesce(abzug_iw,0) AS abzug_iw, me.au, me.bpf, bd.geschosshoehe_m AS h, bd.aussenwand_cm AS aw_cm, bd.decke_cm AS d_cm, bd.bodenplatte_cm AS bp_cm,
   coalesce(halle,false) OR coalesce(f_alle >= 200 AND f_kalt/nullif(f_alle,0) > 0.6, false) AS stb, CASE WHEN s.projekt_id % 5 = 0 THEN 1.2 ELSE 1.05 END::DOUBLE AS k_decke FROM su s JOIN bd USING (projekt_id) JOIN me USING (projekt_id) LEFT JOIN de USING (projekt_id))
, b1 AS (SELECT *, CASE WHEN bpf > 0 THEN bpf ELSE f_innen*1.15 END AS bp, greatest(2.0, h-d_cm/100.0) AS h_mw FROM b0)
, b2 AS (SELECT *, (bp + f_loggia*1.15)*k_decke AS decke, coalesce(CASE WHEN au > 0 THEN au END, CASE WHEN bp > 0 THEN 2*(sqrt(bp/1.3)*1.3+sqrt(bp/1.3))*1.40/1.40*1.55 ELSE 0 END) AS umf FROM b1)
, base AS (SELECT *, umf*h_mw AS aw_brutto, (greatest(0, (u_innen - greatest(0, umf - 8*aw_cm/100.0))/2.0)*h_mw) AS iw_brutto,
   greatest(0, umf*h_mw - abzug_aw) AS aw, greatest(0, (greatest(0, (u_innen - greatest(0, umf - 8*aw_cm/100.0))/2.0)*h_mw) - abzug_iw) AS iw, umf*1.15 AS tr FROM b2)
"""


def _inputs(t: Tables):
    bd = fill_building(best_building(t.building))
    third = F.col("projekt_id") % 3 == 0
    measured = bd.select(
        "projekt_id", F.when(third, F.col("aussenumfang_m")).alias("aussenumfang_m"), F.when(third, F.col("bodenplatte_m2")).alias("bodenplatte_flaeche_m2"),
        F.lit(None).cast("double").alias("fundament_umfang_m"), F.col("konfidenz").alias("m_konfidenz"), F.lit(None).cast("double").alias("umfang_konfidenz"))
    over = bd.filter("projekt_id % 5 = 0").select("projekt_id", F.lit("decke_auskragung").alias("faktor"), F.lit(1.2).alias("wert"))
    return t.rooms, t.openings, bd, measured, M.params_map(over)


@query("material_base", "C14 A3 C21 C22 F15", BASE + """SELECT projekt_id, stb, round(f_innen,5) AS f_innen, round(bp,6) AS bodenplatte, round(decke,6) AS decke, round(umf,6) AS umfang, round(h_mw,6) AS h_mw, round(aw_brutto,6) AS aw_brutto, round(iw_brutto,6) AS iw_brutto, round(aw,6) AS aw_netto, round(iw,6) AS iw_netto FROM base""", "rooms openings building")
def material_base(t: Tables):
    b = M.base_geometry(*_inputs(t))
    cols = ["bodenplatte", "decke", "umfang", "h_mw", "aw_brutto", "iw_brutto", "aw_netto", "iw_netto"]
    return b.select("projekt_id", "stb", F.round("f_innen", 5).alias("f_innen"), *[F.round(c, 6).alias(c) for c in cols])


@query("material_masonry", "C15 C18 F24", BASE + """
 SELECT projekt_id, bauteil, material, round(menge, 9) AS menge FROM (
  SELECT projekt_id, 'Frostschürze' AS bauteil, 'Beton C25/30, XC1, F52, GK 22' AS material, tr*0.8*0.3 AS menge FROM base WHERE NOT stb UNION ALL SELECT projekt_id, 'Frostschürze', 'Noppenfolie 1m', tr FROM base WHERE NOT stb
  UNION ALL SELECT projekt_id, 'Bodenplatte', 'Beton C25/30, B2, GK 22, F52', bp*bp_cm/100 FROM base WHERE NOT stb UNION ALL SELECT projekt_id, 'Bodenplatte', 'PE-Folie', ceil(bp/50) FROM base WHERE NOT stb
  UNION ALL SELECT projekt_id, 'Mauerwerk EG', 'Mauermörtel', (aw+iw)/100*0.6 FROM base WHERE NOT stb UNION ALL SELECT projekt_id, 'Mauerwerk EG', 'EKV-5 (Außenwand)', aw*0.95 FROM base WHERE NOT stb
  UNION ALL SELECT projekt_id, 'Decke über EG', 'Schaltafel 200/50', decke FROM base WHERE NOT stb UNION ALL SELECT projekt_id, 'Decke über EG', 'ISO-Korb 8/25', umf*0.8 FROM base WHERE NOT stb
  UNION ALL SELECT projekt_id, 'Decke über EG', 'Randabschlusskorb 16cm', CASE WHEN bp > 0 THEN umf*sqrt(decke/bp) ELSE umf END FROM base WHERE NOT stb)""", "rooms openings building")
def material_masonry(t: Tables):
    names = ["Frostschürze|Beton C25/30, XC1, F52, GK 22", "Frostschürze|Noppenfolie 1m", "Bodenplatte|Beton C25/30, B2, GK 22, F52", "Bodenplatte|PE-Folie", "Mauerwerk EG|Mauermörtel",
             "Mauerwerk EG|EKV-5 (Außenwand)", "Decke über EG|Schaltafel 200/50", "Decke über EG|ISO-Korb 8/25", "Decke über EG|Randabschlusskorb 16cm"]
    l = M.masonry_lines(M.base_geometry(*_inputs(t)))
    return l.filter(F.concat_ws("|", "bauteil", "material").isin(*names)).select("projekt_id", "bauteil", "material", F.round("menge", 9).alias("menge"))


@query("material_concrete", "C21", BASE + """
, g AS (SELECT *, f_alle*1.05 AS gf, coalesce(CASE WHEN au > 0 THEN au END, sqrt(f_alle)*4*1.15) AS u2 FROM base WHERE stb)
 SELECT projekt_id, round(gf*bp_cm/100, 6) AS bodenplatte, round(u2*h*2, 6) AS schalung, round(gf*d_cm/100*0.09, 7) AS bewehrung FROM g""", "rooms openings building")
def material_concrete(t: Tables):
    l = M.concrete_lines(M.base_geometry(*_inputs(t)))
    pick = lambda b, m: F.max(F.when((F.col("bauteil") == b) & (F.col("material") == m), F.col("menge")))
    return l.groupBy("projekt_id").agg(F.round(pick("Bodenplatte", "Beton C25/30"), 6).alias("bodenplatte"), F.round(pick("Wände (STB)", "Schalung vertikal (2-seitig)"), 6).alias("schalung"),
                                       F.round(pick("Decke", "Bewehrung (Kennwert)"), 7).alias("bewehrung"))


@query("material_bricks", "C16", BASE + """
, ds AS (SELECT projekt_id, 'aussen' AS seite, unnest([50,25]) AS d, unnest([70.0,30.0]) AS pct FROM base WHERE projekt_id % 4 = 0 UNION ALL SELECT projekt_id, 'innen', unnest([25,12]), unnest([40.0,60.0]) FROM base WHERE projekt_id % 4 = 0
   UNION ALL SELECT projekt_id, 'aussen', unnest([50,38,25]), unnest([85.0,10.0,5.0]) FROM base WHERE projekt_id % 4 <> 0 UNION ALL SELECT projekt_id, 'innen', unnest([25,20,12]), unnest([25.0,30.0,45.0]) FROM base WHERE projekt_id % 4 <> 0)
, m AS (SELECT projekt_id, d, sum(CASE WHEN seite='aussen' THEN aw ELSE iw END*pct/100.0) AS m2 FROM base JOIN ds USING (projekt_id) WHERE NOT stb GROUP BY 1, 2)
, q AS (SELECT projekt_id, d, ceil(round(m2*1.05/(CASE d WHEN 50 THEN 3.0 WHEN 38 THEN 4.5 WHEN 25 THEN 6.5 WHEN 20 THEN 8.0 ELSE 12.0 END)::DOUBLE, 9)) AS pal FROM m)
 SELECT projekt_id, 'HLZ ' || d || 'cm Plan' AS material, pal AS menge, CAST(pal*(CASE d WHEN 50 THEN 40 WHEN 38 THEN 45 WHEN 25 THEN 55 WHEN 20 THEN 60 ELSE 70 END) AS DOUBLE) AS stueck FROM q""", "rooms openings building")
def material_bricks(t: Tables):
    b = M.base_geometry(*_inputs(t))
    rows = F.array(*[F.struct(F.lit(s).alias("seite"), F.lit(d).alias("dicke_cm"), F.lit(p).alias("pct")) for s, d, p in
                     [("aussen", 50, 70.0), ("aussen", 25, 30.0), ("innen", 25, 40.0), ("innen", 12, 60.0)]])
    dist = b.filter("projekt_id % 4 = 0").select("projekt_id", F.inline(rows))
    return M.brick_lines(b, dist).select("projekt_id", "material", "menge", "stueck")


@query("material_openings", "C17 A6 A7", """
, h AS (SELECT projekt_id, bool_or(art<>'tuer') AS wt, bool_or(art='tuer') AS dt FROM openings WHERE quelle='text' AND breite_m > 0 GROUP BY 1)
, o AS (SELECT o.*, CASE WHEN breite_m > 0 AND (CASE WHEN art<>'tuer' THEN NOT coalesce(wt,false) OR quelle='text' ELSE NOT coalesce(dt,false) OR quelle='text' END) THEN breite_m END AS b FROM openings o LEFT JOIN h USING (projekt_id))
, l AS (SELECT *, CASE WHEN round(b*100+30,6) <= 125 THEN 125 WHEN round(b*100+30,6) <= 150 THEN 150 WHEN round(b*100+30,6) <= 200 THEN 200 WHEN round(b*100+30,6) <= 250 THEN 250 ELSE 300 END AS lc FROM o)
, i AS (SELECT projekt_id, 'Rolladenkasten ' || CASE WHEN b BETWEEN 1.0 AND 1.4 THEN 124 WHEN b > 1.4 AND b <= 2.0 THEN 184 WHEN b > 2.0 AND b <= 2.4 THEN 214 ELSE 244 END || 'cm' AS material FROM l WHERE art<>'tuer' AND b >= 1.0
  UNION ALL SELECT projekt_id, 'Ziegelüberlage ' || CASE WHEN b IS NULL THEN 125 ELSE lc END || 'cm' FROM l WHERE art='tuer'
  UNION ALL SELECT projekt_id, 'Ziegelüberlage ' || CASE WHEN round(breite_m*100+30,6) <= 125 THEN 125 ELSE 150 END || 'cm (Fenster)' FROM l WHERE art<>'tuer' AND breite_m > 0 AND breite_m < 1.0)
 SELECT projekt_id, material, count(*)::DOUBLE AS menge FROM i GROUP BY 1, 2""", "openings")
def material_openings(t: Tables):
    return M.opening_hardware(t.openings).select("projekt_id", "material", "menge")


@query("material_floors", "C19 A4", f"""
, r AS (SELECT * FROM rooms WHERE {KAT} = 'Innenraum_warm')
, p AS (SELECT projekt_id, bodenbelag, sum(coalesce(flaeche_m2,0)) AS f, sum(coalesce(umfang_m,0)) AS u FROM r GROUP BY 1, 2)
, t AS (SELECT projekt_id, sum(f) AS f, sum(u) AS u, CASE WHEN projekt_id % 3 <> 0 THEN 6.0 END AS e, CASE WHEN projekt_id % 5 <> 0 THEN 8.0 END AS s FROM p GROUP BY 1)
, k AS (SELECT * FROM t WHERE f > 0 AND coalesce(e, s) IS NOT NULL)
 SELECT projekt_id, 'Estrich (Volumen)' AS material, round(f*e/100, 4) AS menge FROM k WHERE e IS NOT NULL UNION ALL SELECT projekt_id, 'Estrich-Fläche', round(f, 4) FROM k
 UNION ALL SELECT projekt_id, 'Schüttung (Volumen)', round(f*s/100, 4) FROM k WHERE s IS NOT NULL UNION ALL SELECT projekt_id, 'Randdämmstreifen', round(u, 4) FROM k
 UNION ALL SELECT projekt_id, 'Bodenbelag ' || bodenbelag, round(p.f, 4) FROM p JOIN k USING (projekt_id) WHERE bodenbelag IS NOT NULL""", "rooms")
def material_floors(t: Tables):
    layers = t.rooms.select("projekt_id").distinct().selectExpr(
        "projekt_id", "CASE WHEN projekt_id % 3 <> 0 THEN CAST(6.0 AS DOUBLE) END estrich_cm", "CASE WHEN projekt_id % 5 <> 0 THEN CAST(8.0 AS DOUBLE) END schuettung_cm",
        "CAST(NULL AS DOUBLE) belag_cm", "CAST(NULL AS DOUBLE) trittschall_cm")
    return M.floor_lines(t.rooms, layers).select("projekt_id", "material", F.round("menge", 4).alias("menge"))


@query("material_gable", "C18 F14", BASE + """
, g AS (SELECT projekt_id, umf, bp, 5.0 + projekt_id % 5 - (h + d_cm/100) AS ue, umf*umf/16-bp AS disc, CASE WHEN projekt_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM base)
, a AS (SELECT projekt_id, (umf/4 - sqrt(greatest(disc,0)))*ue/2*n AS m FROM g WHERE umf > 0 AND bp > 0 AND ue BETWEEN 0.5 AND 6 AND disc > 0)
 SELECT projekt_id, round(m, 6) AS menge FROM a WHERE m >= 2""", "rooms openings building")
def material_gable(t: Tables):
    b = M.base_geometry(*_inputs(t))
    roof = b.selectExpr("projekt_id", "CASE WHEN projekt_id % 3 = 0 THEN 'Pultdach' ELSE 'Satteldach' END dach_typ", "CAST(5.0 + projekt_id % 5 AS DOUBLE) gebaeudehoehe_m")
    return M.gable_lines(b, roof).select("projekt_id", F.round("menge", 6).alias("menge"))


@query("material_confidence", "C20 C22", BASE + """
, k AS (SELECT projekt_id, round(least(0.96, konfidenz), 2) AS kg FROM bd0)
 SELECT projekt_id, 'Noppenfolie 1m' AS material, kg AS konfidenz, 'konturen' AS ebene FROM base JOIN k USING (projekt_id) WHERE NOT stb UNION ALL SELECT projekt_id, 'PE-Folie', round(least(kg, 0.72), 2), NULL FROM base JOIN k USING (projekt_id) WHERE NOT stb
 UNION ALL SELECT projekt_id, 'XPS-SF G30 120mm', kg, NULL FROM base JOIN k USING (projekt_id) WHERE NOT stb""", "rooms openings building")
def material_confidence(t: Tables):
    rooms, openings, bd, measured, params = _inputs(t)
    l = M.material_list(rooms, openings, bd, measured, params)
    return l.filter(F.col("material").isin("Noppenfolie 1m", "PE-Folie", "XPS-SF G30 120mm")).select("projekt_id", "material", "konfidenz", "ebene")


@query("material_totals", "C22 A42")
def material_totals(t: Tables):
    rooms, openings, bd, measured, params = _inputs(t)
    l = M.material_list(rooms, openings, bd, measured, params)
    return l.groupBy("bauteil", "material", "einheit").agg(F.round(F.sum("menge"), 2).alias("menge"), F.count(F.lit(1)).alias("n"))


@query("quantity_corrections", "J29", """
, l AS (SELECT list_id, bauteil, material, sum(ist_menge) AS menge, min(0.5 + (length(material) % 5) * 0.1) AS konfidenz FROM quantities GROUP BY ALL)
, c AS (SELECT DISTINCT list_id, CASE list_id % 5 WHEN 0 THEN 'Mauerwerk EG' WHEN 1 THEN 'Bodenplatte' WHEN 2 THEN 'Decke über EG' WHEN 3 THEN 'Frostschürze' ELSE 'Dach' END AS bauteil, CASE WHEN list_id % 7 = 0 THEN '' ELSE 'Schnitt A-A' END AS beleg FROM quantities)
, j AS (SELECT c.*, l.menge AS alt, l.konfidenz, l.material, l.menge*(1+(c.list_id % 6)*0.08) AS soll FROM c LEFT JOIN l USING (list_id, bauteil))
 SELECT list_id, CASE WHEN material IS NULL THEN 'abgelehnt: Bauteil nicht in Liste' WHEN beleg = '' THEN 'abgelehnt: kein Beleg' WHEN NOT konfidenz < 0.8 THEN 'abgelehnt: keine eindeutige Zielposition'
  WHEN abs(soll-alt)/alt > 0.25 THEN 'geflaggt' ELSE 'angewandt' END AS status FROM j""", "quantities")
def quantity_corrections(t: Tables):
    q = t.quantities
    l = q.groupBy("list_id", "bauteil", "material").agg(F.sum("ist_menge").alias("menge")).withColumn("konfidenz", 0.5 + (F.length("material") % 5) * 0.1)
    c = q.select("list_id").distinct().selectExpr(
        "list_id", "CASE list_id % 5 WHEN 0 THEN 'Mauerwerk EG' WHEN 1 THEN 'Bodenplatte' WHEN 2 THEN 'Decke über EG' WHEN 3 THEN 'Frostschürze' ELSE 'Dach' END bauteil",
        "CASE WHEN list_id % 7 = 0 THEN '' ELSE 'Schnitt A-A' END beleg")
    want = c.join(l.select("list_id", "bauteil", "menge"), ["list_id", "bauteil"], "left")
    want = want.select(F.col("list_id").alias("korrektur_id"), "list_id", "bauteil", F.lit(None).cast("string").alias("k_material"),
                       (F.coalesce("menge", F.lit(1.0)) * (1 + (F.col("list_id") % 6) * 0.08)).alias("soll_menge"), "beleg")
    return M.apply_corrections(l, want, "list_id").select("list_id", "status")


@query("inventory_coverage", "J30", """
, inv AS (SELECT plan_id, projekt_id, CASE plan_id % 5 WHEN 0 THEN 'Stütze STB' WHEN 1 THEN 'Kamin' WHEN 2 THEN 'Treppe' WHEN 3 THEN 'Aufzug' ELSE 'Pflanze' END AS t, konfidenz FROM plans WHERE konfidenz >= 0.55 AND plan_id % 11 <> 0)
, y AS (SELECT *, CASE plan_id % 5 WHEN 0 THEN 'saeule' WHEN 1 THEN 'kamin' WHEN 2 THEN 'treppe' WHEN 3 THEN 'schacht' END AS typ FROM inv WHERE plan_id % 5 <> 4)
, c AS (SELECT DISTINCT projekt_id, CASE WHEN name = 'Stiegenhaus' THEN 'treppe' ELSE 'balkon' END AS typ FROM rooms WHERE name IN ('Stiegenhaus','Loggia'))
 SELECT plan_id, y.typ, c.typ IS NOT NULL AS gedeckt FROM y LEFT JOIN c ON c.projekt_id = y.projekt_id AND c.typ = y.typ""", "plans rooms")
def inventory_coverage(t: Tables):
    inv = t.plans.selectExpr("plan_id", "projekt_id", "CASE plan_id % 5 WHEN 0 THEN 'Stütze STB' WHEN 1 THEN 'Kamin' WHEN 2 THEN 'Treppe' WHEN 3 THEN 'Aufzug' ELSE 'Pflanze' END typ_text",
                             "konfidenz", "CASE WHEN plan_id % 11 = 0 THEN '' ELSE 'S. 2' END beleg")
    return M.inventory_coverage(inv, t.rooms.selectExpr("projekt_id", "name text")).select("plan_id", "typ", "gedeckt")


ROOF_TEXT = """'Dach' || chr(10) || 'Dachfläche Nord: 5,50 x ' || CAST(l_linenumber + 3 AS STRING) || ' = ' || replace(CAST(CAST(5.5 * (l_linenumber + 3) AS DECIMAL(10,2)) AS STRING), '.', ',') || ' m²' || chr(10) ||
 'Dachfläche Süd: ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' m²' || chr(10) || (CASE WHEN l_partkey % 2 = 0 THEN 'Dachfläche gesamt: ' || replace(CAST(CAST(5.5 * (l_linenumber + 3) + l_quantity AS DECIMAL(10,2)) AS STRING), '.', ',') || ' m²' ELSE 'ohne' END) || chr(10) ||
 CAST(l_linenumber + 4 AS STRING) || 'x Sparren B/H: 8/' || CAST(16 + l_linenumber AS STRING) || ' cm' || chr(10) || 'Mineralwolle ' || CAST(18 + l_linenumber AS STRING) || ' cm'"""


def _roof(t: Tables):
    return t.lineitem.selectExpr(f"{L_ID} AS page", "l_linenumber AS ord", f"{ROOF_TEXT} AS text")


@query("roof_totals", "C23 U4", f"""
WITH x AS (SELECT {L_ID} AS page, 5.5*(l_linenumber+3) AS n, CAST(l_quantity AS BIGINT)::DOUBLE AS s, l_partkey % 2 = 0 AS g FROM lineitem)
 SELECT page, CAST(round(n+s, 2) AS DOUBLE) AS gesamt_m2, CASE WHEN g THEN true END AS bestaetigt FROM x""")
def roof_totals(t: Tables):
    areas, _, _ = M.roof_readings(_roof(t), "page")
    return M.roof_totals(areas, "page")


@query("roof_materials", "C24", f"""
WITH x AS (SELECT {L_ID} AS page, 5.5*(l_linenumber+3) + CAST(l_quantity AS BIGINT)::DOUBLE AS a, l_linenumber FROM lineitem)
 SELECT material, round(sum(menge), 3) AS menge, count(*) AS n FROM (SELECT 'Dacheindeckung' AS material, a*1.05 AS menge FROM x UNION ALL SELECT 'Dachlatten', a*3.3 FROM x UNION ALL SELECT 'Konterlatten', a*2.6 FROM x UNION ALL SELECT 'Unterspannbahn', a*1.15 FROM x
  UNION ALL SELECT 'Mineralwolle ' || (18+l_linenumber) || '.0cm', a*(18+l_linenumber)/100.0 FROM x) GROUP BY 1""")
def roof_materials(t: Tables):
    areas, _, layers = M.roof_readings(_roof(t), "page")
    m = M.roof_materials(M.roof_totals(areas, "page"), layers, "page")
    return m.groupBy("material").agg(F.round(F.sum("menge"), 3).alias("menge"), F.count(F.lit(1)).alias("n"))


@query("roof_timbers", "C23", """
 SELECT 'Sparren' AS bauteil, (l_linenumber+4)::BIGINT AS anzahl, 8::BIGINT AS b_cm, (16+l_linenumber)::BIGINT AS h_cm, count(*) AS n FROM lineitem GROUP BY ALL""")
def roof_timbers(t: Tables):
    _, h, _ = M.roof_readings(_roof(t), "page")
    return h.groupBy("bauteil", F.col("anzahl").cast("bigint").alias("anzahl"), F.col("b_cm").cast("bigint").alias("b_cm"), F.col("h_cm").cast("bigint").alias("h_cm")).agg(F.count(F.lit(1)).alias("n"))
