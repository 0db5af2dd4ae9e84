"""Queries of quality rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import with_category
from ..functions.text import name_key, storey_label
from ..operators.ordering import order_stats
from ..plans import quality as Q
from . import Tables, query
from .trades_q import KAT, NK

RK = f", rk AS (SELECT *, {KAT} AS kategorie, {NK.format(c='name')} AS nk FROM rooms)"


@query("height_findings", "Q2 O4", """
, r AS (SELECT * FROM rooms WHERE hoehe_m > 0)
, g AS (SELECT projekt_id, count(*) AS n, stddev_samp(hoehe_m) AS s, arg_min(name, (hoehe_m, room_id)) AS lo, arg_max(name, (hoehe_m, room_id)) AS hi FROM r GROUP BY 1)
 SELECT projekt_id, 'hoehen' AS "check", CASE WHEN hoehe_m < 1.8 OR hoehe_m > 5 THEN 'fehler' ELSE 'warnung' END AS schwere, name AS objekt FROM r WHERE hoehe_m < 2.2 OR hoehe_m > 4
 UNION ALL SELECT projekt_id, 'hoehen_streuung', 'info', lo || ' / ' || hi FROM g WHERE n >= 3 AND s > 0.3""", "rooms")
def height_findings(t: Tables):
    return Q.height_findings(t.rooms)


@query("area_balance", "Q1 Q5", RK + """
, g AS (SELECT plan_id, count(CASE WHEN kategorie='Innenraum_warm' AND q > 0 THEN 1 END) AS n, sum(CASE WHEN kategorie='Innenraum_warm' THEN q END) AS i, sum(CASE WHEN kategorie='Loggia' THEN q END) AS l FROM (SELECT *, CAST(round_even(coalesce(flaeche_m2, 0) * 10000, 0) AS BIGINT) AS q FROM rk) GROUP BY 1)
 SELECT plan_id, 'raum_summen' AS "check", 'warnung' AS schwere, NULL::VARCHAR AS objekt FROM g WHERE n > 0 AND i > n * 350000 UNION ALL SELECT plan_id, 'aussenkontur', 'info', NULL FROM g WHERE i > 0 AND 2 * l > 3 * i""", "rooms")
def area_balance(t: Tables):
    return Q.area_balance(with_category(t.rooms), "plan_id")


@query("rooms_without_window", "Q3", RK + f"""
, w AS (SELECT DISTINCT projekt_id, {NK.format(c='raum')} AS wk FROM openings WHERE art <> 'tuer' AND raum IS NOT NULL)
 SELECT room_id FROM rk r WHERE kategorie = 'Innenraum_warm' AND NOT regexp_matches(nk, '^(flur|vorraum|gang|garderobe|abstellraum|speis|speisekammer|ar)')
  AND NOT EXISTS (SELECT 1 FROM w WHERE w.projekt_id = r.projekt_id AND (contains(r.nk, wk) OR contains(wk, r.nk)))""", "rooms openings")
def rooms_without_window(t: Tables):
    return Q.rooms_without_window(with_category(t.rooms), t.openings.filter("art <> 'tuer'")).select("room_id")


@query("wet_room_dry_floor", "Q4", "SELECT room_id, name, bodenbelag FROM rooms WHERE regexp_matches(lower(name), '^(bad|wc|dusche|sauna|waschk|wasch)') AND lower(bodenbelag) IN ('parkett','laminat')", "rooms")
def wet_room_dry_floor(t: Tables):
    return Q.wet_room_dry_floor(t.rooms).select("room_id", "name", "bodenbelag")


@query("cross_plan_conflicts", "Q6", RK + """ SELECT projekt_id, wohnung, nk, count(DISTINCT plan_id) AS n_plaene, min(flaeche_m2) AS f_min, max(flaeche_m2) AS f_max FROM rk WHERE flaeche_m2 > 0
 GROUP BY 1,2,3 HAVING count(DISTINCT plan_id) >= 2 AND (max(flaeche_m2)-min(flaeche_m2))/max(flaeche_m2) > 0.05""", "rooms")
def cross_plan_conflicts(t: Tables):
    return Q.cross_plan_conflicts(t.rooms)


def _range_case(i: int) -> str:
    return "(CASE " + " ".join(f"WHEN contains(lower(name), '{r[0]}') THEN {r[i]}" for r in Q.ROOM_AREA_RANGES) + " END)"


PLAUS = f"""
, x AS (SELECT projekt_id, room_id, coalesce(flaeche_m2,0) AS f, coalesce(umfang_m,0) AS u, {_range_case(1)} AS lo, {_range_case(2)} AS hi FROM rooms)
, fd AS (SELECT projekt_id, 'flaeche_null' AS "check", 'KRITISCH' AS schwere, room_id AS objekt FROM x WHERE f <= 0 UNION ALL SELECT projekt_id, 'flaeche_klein', 'WARNUNG', room_id FROM x WHERE f > 0 AND f < 1
 UNION ALL SELECT projekt_id, 'flaeche_gross', 'WARNUNG', room_id FROM x WHERE f > 100 UNION ALL SELECT projekt_id, 'unter_bereich', 'WARNUNG', room_id FROM x WHERE f > 0 AND f < lo*0.5
 UNION ALL SELECT projekt_id, 'ueber_bereich', 'WARNUNG', room_id FROM x WHERE f > 0 AND f > hi*1.5 UNION ALL SELECT projekt_id, 'umfang_unmoeglich', 'KRITISCH', room_id FROM x WHERE f > 0 AND u > 0 AND u < 4*sqrt(f)*0.85
 UNION ALL SELECT projekt_id, 'umfang_gross', 'WARNUNG', room_id FROM x WHERE f > 0 AND u > 4*sqrt(f)*3.0)
"""


@query("room_plausibility", "Q7", PLAUS + "SELECT * FROM fd", "rooms")
def room_plausibility(t: Tables):
    return Q.room_plausibility(t.rooms)


@query("severity_summary", "A47 R2", PLAUS + """
, g AS (SELECT projekt_id, count(*) FILTER (WHERE schwere='KRITISCH') AS kritisch, count(*) FILTER (WHERE schwere='WARNUNG') AS warnung, count(*) FILTER (WHERE schwere='HINWEIS') AS hinweis FROM fd GROUP BY 1)
, s AS (SELECT *, CASE WHEN kritisch > 0 THEN 'kritisch' WHEN warnung > 0 THEN 'warnung' ELSE 'hinweis' END AS schwere_max, greatest(0, least(100, 100-15*kritisch-5*warnung-hinweis)) AS qualitaet FROM g)
 SELECT *, CASE WHEN qualitaet >= 80 THEN 'fertig' WHEN qualitaet >= 60 THEN 'pruefen' ELSE 'unvollstaendig' END AS status FROM s""", "rooms")
def severity_summary(t: Tables):
    return Q.severity_summary(Q.room_plausibility(t.rooms)).withColumn("status", Q.quality_status(F.col("qualitaet")))


@query("opening_plausibility", "Q8 Q9", """
, x AS (SELECT projekt_id, opening_id AS o, art, CASE WHEN breite_m > 0 AND breite_m < 10 THEN breite_m*1000 ELSE coalesce(breite_m,0) END AS w, CASE WHEN hoehe_m > 0 AND hoehe_m < 10 THEN hoehe_m*1000 ELSE coalesce(hoehe_m,0) END AS h, fph_m*1000 AS s FROM openings)
 SELECT projekt_id, 'fenster_breit' AS "check", 'WARNUNG' AS schwere, o AS objekt FROM x WHERE art<>'tuer' AND w > 4000 UNION ALL SELECT projekt_id, 'fenster_hoch', 'WARNUNG', o FROM x WHERE art<>'tuer' AND h > 3000
 UNION ALL SELECT projekt_id, 'fenster_schmal', 'WARNUNG', o FROM x WHERE art<>'tuer' AND w > 0 AND w < 200 UNION ALL SELECT projekt_id, 'fenster_gross', 'WARNUNG', o FROM x WHERE art<>'tuer' AND w/1000.0*(h/1000.0) > 6
 UNION ALL SELECT projekt_id, 'parapet_hoch', 'HINWEIS', o FROM x WHERE art<>'tuer' AND s > 1200 UNION ALL SELECT projekt_id, 'tuer_breit', 'WARNUNG', o FROM x WHERE art='tuer' AND w > 2500
 UNION ALL SELECT projekt_id, 'tuer_schmal', 'WARNUNG', o FROM x WHERE art='tuer' AND w > 0 AND w < 500 UNION ALL SELECT projekt_id, 'tuer_niedrig', 'WARNUNG', o FROM x WHERE art='tuer' AND h > 0 AND h < 1800""", "openings")
def opening_plausibility(t: Tables):
    return Q.opening_plausibility(t.openings)


POSX = """, pos AS (SELECT projekt_id, room_id, CASE plan_id % 6 WHEN 0 THEN 'mauerwerk' WHEN 1 THEN 'putz_innen' WHEN 2 THEN 'maler' WHEN 3 THEN 'bodenbelag' WHEN 4 THEN 'estrich' ELSE 'fensterbank' END AS gewerk,
  CAST(plan_id % 6 AS STRING) AS posnr, round(coalesce(flaeche_m2, 1.0) - 5.0, 2) AS endsumme FROM rooms)"""


def _pos(t: Tables):
    return t.rooms.selectExpr(
        "projekt_id", "room_id", "CASE plan_id % 6 WHEN 0 THEN 'mauerwerk' WHEN 1 THEN 'putz_innen' WHEN 2 THEN 'maler' WHEN 3 THEN 'bodenbelag' WHEN 4 THEN 'estrich' ELSE 'fensterbank' END gewerk",
        "CAST(plan_id % 6 AS STRING) posnr", "round(coalesce(flaeche_m2, CAST(1.0 AS DOUBLE)) - 5.0, 2) endsumme")


@query("calculation_consistency", "Q10", POSX + """
, a AS (SELECT projekt_id, sum(CASE WHEN flaeche_m2 > 0 THEN flaeche_m2 END) AS f FROM rooms GROUP BY 1)
, s AS (SELECT projekt_id, sum(CASE WHEN gewerk='bodenbelag' THEN endsumme END) AS belag, sum(CASE WHEN gewerk='estrich' THEN endsumme END) AS estrich, bool_or(gewerk='fensterbank') AS bank FROM pos GROUP BY 1)
, d AS (SELECT * FROM a LEFT JOIN s USING (projekt_id))
 SELECT projekt_id, 'negativ' AS "check", 'KRITISCH' AS schwere, posnr AS objekt FROM pos WHERE endsumme < 0 UNION ALL SELECT projekt_id, 'belag_summe', 'WARNUNG', NULL FROM d WHERE f > 0 AND belag > 0 AND abs(belag-f)/f > 0.1
 UNION ALL SELECT projekt_id, 'estrich_summe', 'WARNUNG', NULL FROM d WHERE f > 0 AND estrich > 0 AND abs(estrich-f)/f > 0.1 UNION ALL SELECT projekt_id, 'fensterbank_fehlt', 'WARNUNG', NULL FROM d WHERE NOT coalesce(bank,false)""", "rooms")
def calculation_consistency(t: Tables):
    return Q.calculation_consistency(_pos(t), t.rooms)


@query("completeness", "Q11 U2", """
, p AS (SELECT room_id, ['mauerwerk','putz_innen','maler','bodenbelag','estrich','fensterbank'][CAST(plan_id % 6 AS INT)+1] AS g FROM rooms WHERE quelle = 'text')
, j AS (SELECT r.projekt_id, r.room_id, p.g FROM rooms r LEFT JOIN p USING (room_id))
 SELECT projekt_id, room_id, CASE WHEN g IS NULL THEN 'KRITISCH' ELSE 'WARNUNG' END AS schwere, CASE WHEN g IS NULL THEN 'keine Positionen'
  ELSE array_to_string(list_filter(['bodenbelag','estrich','maler','mauerwerk','putz_innen'], lambda x: x <> g), ', ') END AS fehlt FROM j""", "rooms")
def completeness(t: Tables):
    return Q.completeness(t.rooms, _pos(t).join(t.rooms.filter("quelle = 'text'").select("room_id"), "room_id", "left_semi"))


@query("provenance_tiers", "P20 P21", """
 SELECT room_id, CASE WHEN konfidenz < 0.65 THEN 'manual' WHEN quelle='text' AND ok_f THEN 'text' WHEN ok_f THEN 'matched' ELSE 'inferred' END AS stufe,
  CASE WHEN konfidenz >= 0.8 THEN 'gruen' WHEN konfidenz >= 0.6 THEN 'gelb' ELSE 'rot' END AS ampel FROM rooms""", "rooms")
def provenance_tiers(t: Tables):
    k = F.col("konfidenz")
    return t.rooms.select("room_id", Q.tier(F.col("quelle"), F.col("ok_f"), k < 0.65).alias("stufe"),
                          F.when(k >= 0.8, F.lit("gruen")).when(k >= 0.6, F.lit("gelb")).otherwise(F.lit("rot")).alias("ampel"))


@query("missing_size_hint", "P19", """
 SELECT projekt_id, count(*) AS n, count(*) FILTER (WHERE breite_m IS NULL OR hoehe_m IS NULL) AS ohne_mass, count(*) FILTER (WHERE (breite_m IS NULL) AND coalesce(hoehe_m, 2.0) > 0 AND 4.0/coalesce(hoehe_m, 2.0) <= 2.0) AS kritisch FROM openings GROUP BY 1""", "openings")
def missing_size_hint(t: Tables):
    no = F.col("breite_m").isNull() | F.col("hoehe_m").isNull()
    h = F.coalesce("hoehe_m", F.lit(2.0))
    return t.openings.groupBy("projekt_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(no).alias("ohne_mass"),
        F.count_if(F.col("breite_m").isNull() & (h > 0) & (4.0 / F.when(h > 0, h) <= 2.0)).alias("kritisch"))


@query("overall_confidence", "A48 A49", """
, v AS (SELECT plan_id, ((CASE WHEN ok_f THEN 1 ELSE 0 END)+(CASE WHEN ok_u THEN 1 ELSE 0 END)+(CASE WHEN ok_h THEN 1 ELSE 0 END))/3.0 AS v, konfidenz FROM rooms)
 SELECT plan_id, round(greatest(55, least(98, 60+38*avg(v))), 5) AS konfidenz_pct, round(median(konfidenz), 5) AS median_konfidenz FROM v GROUP BY 1""", "rooms")
def overall_confidence(t: Tables):
    share = sum(F.col(c).cast("int") for c in ("ok_f", "ok_u", "ok_h")) / 3.0
    a = t.rooms.groupBy("plan_id").agg(F.round(F.greatest(F.lit(55.0), F.least(F.lit(98.0), 60 + 38 * F.avg(share))), 5).alias("konfidenz_pct"))
    m = order_stats(t.rooms, ["plan_id"], "konfidenz", {"m": "median"})
    return a.join(m, "plan_id").select("plan_id", "konfidenz_pct", F.round("m", 5).alias("median_konfidenz"))


@query("dashboard_kpis", "A43 A57", """
 SELECT firma_id, count(DISTINCT projekt_id) AS projekte, count(*) AS plaene, count(*) FILTER (WHERE status='fertig') AS analysiert, round(avg(konfidenz), 9) AS konfidenz FROM plans GROUP BY 1""", "plans")
def dashboard_kpis(t: Tables):
    per = t.plans.groupBy("firma_id", "projekt_id").agg(
        F.count(F.lit(1)).alias("p"), F.count_if(F.col("status") == "fertig").alias("a"), F.sum("konfidenz").alias("k"))
    return per.groupBy("firma_id").agg(
        F.count(F.lit(1)).alias("projekte"), F.sum("p").alias("plaene"), F.sum("a").alias("analysiert"),
        F.round(F.sum("k") / F.sum("p"), 9).alias("konfidenz"))


@query("recent_activity", "O3", "SELECT plan_id, erstellt_am FROM plans ORDER BY erstellt_am DESC, plan_id DESC LIMIT 8", "plans")
def recent_activity(t: Tables):
    return t.plans.select("plan_id", "erstellt_am").orderBy(F.desc("erstellt_am"), F.desc("plan_id")).limit(8)


@query("room_list_by_storey", "A44 F12", """
 SELECT projekt_id, CASE geschoss WHEN 'EG' THEN 'Erdgeschoss' WHEN 'KG' THEN 'Kellergeschoss' WHEN 'OG1' THEN '1. Obergeschoss' ELSE '2. Obergeschoss' END AS geschoss, count(*) AS n,
  round(sum(flaeche_m2), 4) AS f, round(sum(umfang_m), 4) AS u, arg_max(name, (coalesce(flaeche_m2,0), room_id)) AS groesster FROM rooms GROUP BY 1, 2""", "rooms")
def room_list_by_storey(t: Tables):
    return t.rooms.groupBy("projekt_id", storey_label(F.col("geschoss")).alias("geschoss")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("flaeche_m2"), 4).alias("f"), F.round(F.sum("umfang_m"), 4).alias("u"),
        F.max_by("name", F.struct(F.coalesce("flaeche_m2", F.lit(0.0)), F.col("room_id"))).alias("groesster"))


@query("flat_plaster_summary", "A46 A4", """
, b AS (SELECT plan_id, wohnung, bodenbelag, sum(flaeche_m2) AS f FROM rooms WHERE bodenbelag IS NOT NULL AND flaeche_m2 IS NOT NULL GROUP BY ALL)
, m AS (SELECT plan_id, wohnung, string_agg(bodenbelag || '=' || format('{:.1f}', f), ';' ORDER BY bodenbelag) AS belaege FROM b GROUP BY 1, 2)
, s AS (SELECT plan_id, wohnung, round(sum(umfang_m*hoehe_m), 4) AS wand, round(sum(flaeche_m2), 4) AS f FROM rooms GROUP BY 1, 2)
 SELECT plan_id, wohnung, wand, f, belaege FROM s LEFT JOIN m USING (plan_id, wohnung)""", "rooms")
def flat_plaster_summary(t: Tables):
    k = ["plan_id", "wohnung"]
    b = t.rooms.filter("bodenbelag is not null and flaeche_m2 is not null").groupBy(*k, "bodenbelag").agg(F.sum("flaeche_m2").alias("f"))
    item = F.struct("bodenbelag", F.format_string("%.1f", "f").alias("v"))
    m = b.groupBy(*k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["bodenbelag"], F.lit("="), x["v"])), ";").alias("belaege"))
    s = t.rooms.groupBy(*k).agg(F.round(F.sum(F.col("umfang_m") * F.col("hoehe_m")), 4).alias("wand"), F.round(F.sum("flaeche_m2"), 4).alias("f"))
    return s.join(m, k, "left")


@query("geometry_risk", "A51", """
, x AS (SELECT firma_id, umfang_quelle, flaeche_m2, hoehe_m, umfang_m, CASE WHEN umfang_m IS NOT NULL AND flaeche_m2 IS NOT NULL THEN abs(umfang_m - 2*(sqrt(flaeche_m2*1.35)+sqrt(flaeche_m2/1.35)))/umfang_m END AS err FROM rooms WHERE umfang_quelle = 'geometrie')
 SELECT coalesce(CAST(firma_id AS VARCHAR), 'gesamt') AS firma, count(*) AS n, count(err) AS pruefbar, count(*) FILTER (WHERE err > 0.05) AS daneben, round(sum(CASE WHEN err IS NULL THEN umfang_m*coalesce(hoehe_m,0) END), 4) AS ungeprueft_m2 FROM x GROUP BY ROLLUP (firma_id)""", "rooms")
def geometry_risk(t: Tables):
    f, u = F.col("flaeche_m2"), F.col("umfang_m")
    err = F.abs(u - 2 * (F.sqrt(f * 1.35) + F.sqrt(f / 1.35))) / u
    x = t.rooms.filter("umfang_quelle = 'geometrie'").select("firma_id", "hoehe_m", "umfang_m", err.alias("err"))
    return x.rollup("firma_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("err").alias("pruefbar"), F.count_if(F.col("err") > 0.05).alias("daneben"),
        F.round(F.sum(F.when(F.col("err").isNull(), F.col("umfang_m") * F.coalesce("hoehe_m", F.lit(0.0)))), 4).alias("ungeprueft_m2"),
    ).select(F.coalesce(F.col("firma_id").cast("string"), F.lit("gesamt")).alias("firma"), "n", "pruefbar", "daneben", "ungeprueft_m2")


@query("corpus_fidelity", "A52", """
, x AS (SELECT plan_id, flaeche_m2, CASE WHEN flaeche_m2 > 0 THEN abs(flaeche_m2*(1+(room_nr % 7)*0.01) - flaeche_m2)/flaeche_m2 END AS err FROM (SELECT *, CAST(cx AS BIGINT) AS room_nr FROM rooms))
 SELECT plan_id, count(*) AS n, round(count(err)*1.0/count(*), 6) AS deckung, round(median(err), 6) AS median_fehler FROM x GROUP BY 1""", "rooms")
def corpus_fidelity(t: Tables):
    f = F.col("flaeche_m2")
    m = f * (1 + (F.col("cx").cast("bigint") % 7) * 0.01)
    x = t.rooms.select("plan_id", F.when(f > 0, F.abs(m - f) / f).alias("err"))
    g = x.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.count("err").alias("k"))
    med = order_stats(x, ["plan_id"], "err", {"m": "median"})
    return g.join(med, "plan_id", "left").select("plan_id", "n", F.round(F.col("k") / F.col("n"), 6).alias("deckung"), F.round("m", 6).alias("median_fehler"))


@query("review_list", "O2", """
, a AS (SELECT projekt_id, 'hoch' AS prio, 'Höhe unmöglich' AS thema, room_id AS objekt FROM rooms WHERE hoehe_m > 5
 UNION ALL SELECT projekt_id, 'mittel', 'Öffnung ohne Maß', opening_id FROM openings WHERE breite_m IS NULL
 UNION ALL SELECT projekt_id, 'niedrig', 'Umfang geschätzt', room_id FROM rooms WHERE umfang_quelle = 'geschaetzt')
 SELECT projekt_id, prio, thema, count(*) AS n, min(objekt) AS beispiel FROM a GROUP BY 1, 2, 3""", "rooms openings")
def review_list(t: Tables):
    def rule(df, prio, thema, obj):
        return df.select("projekt_id", F.lit(prio).alias("prio"), F.lit(thema).alias("thema"), F.col(obj).alias("objekt"))
    a = rule(t.rooms.filter("hoehe_m > 5"), "hoch", "Höhe unmöglich", "room_id").unionByName(
        rule(t.openings.filter("breite_m is null"), "mittel", "Öffnung ohne Maß", "opening_id")).unionByName(
        rule(t.rooms.filter("umfang_quelle = 'geschaetzt'"), "niedrig", "Umfang geschätzt", "room_id"))
    return a.groupBy("projekt_id", "prio", "thema").agg(F.count(F.lit(1)).alias("n"), F.min("objekt").alias("beispiel"))


@query("text_sufficiency", "P16", RK + """
 SELECT plan_id, (count(*) FILTER (WHERE kategorie IS NOT NULL) >= 3 AND count(*) FILTER (WHERE flaeche_m2 > 0) >= 3) AS text_genug FROM rk GROUP BY 1""", "rooms")
def text_sufficiency(t: Tables):
    r = with_category(t.rooms)
    return r.groupBy("plan_id").agg(
        ((F.count_if(F.col("kategorie").isNotNull()) >= 3) & (F.count_if(F.col("flaeche_m2") > 0) >= 3)).alias("text_genug"))
