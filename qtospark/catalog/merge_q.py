"""Queries merging rooms and openings across plans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import with_category
from ..functions.text import name_key
from ..operators.spatial import proximity_edges  # noqa: F401
from ..plans import merge as G
from . import Tables, query
from .trades_q import KAT, NK


@query("room_consensus", "A8", f"""
, r AS (SELECT *, {NK.format(c='name')} AS nk, coalesce(floor(flaeche_m2*5+0.5)/5.0, 0) AS fb FROM rooms)
, n AS (SELECT projekt_id, nk, wohnung, geschoss, fb, count(*) AS n, array_to_string(list_sort(list(DISTINCT quelle)), ',') AS quellen,
   list_sort(list(flaeche_m2) FILTER (WHERE flaeche_m2 IS NOT NULL)) AS f, list_sort(list(umfang_m) FILTER (WHERE umfang_m IS NOT NULL)) AS u, list_sort(list(hoehe_m) FILTER (WHERE hoehe_m IS NOT NULL)) AS h FROM r GROUP BY ALL)
, b AS (SELECT projekt_id, nk, wohnung, geschoss, fb, bodenbelag FROM r WHERE bodenbelag IS NOT NULL GROUP BY projekt_id, nk, wohnung, geschoss, fb, bodenbelag QUALIFY row_number() OVER (PARTITION BY projekt_id, nk, wohnung, geschoss, fb ORDER BY count(*) DESC, min(room_id), bodenbelag) = 1)
 SELECT projekt_id, nk, wohnung, geschoss, fb, n, quellen, round(least(0.95, 0.6+0.08*least(n,4)), 2)::DOUBLE AS konfidenz, bodenbelag, f[(len(f)-1)//2+1] AS flaeche_m2, u[(len(u)-1)//2+1] AS umfang_m, h[(len(h)-1)//2+1] AS hoehe_m
 FROM n LEFT JOIN b USING (projekt_id, nk, wohnung, geschoss, fb)""", "rooms")
def room_consensus(t: Tables):
    return G.consensus_rooms(t.rooms).drop("name").withColumn("quellen", F.array_join("quellen", ","))


@query("room_priority_merge", "A14 J32", f"""
, r AS (SELECT *, {NK.format(c='name')} AS nk FROM rooms)
 SELECT projekt_id, nk, wohnung, geschoss, arg_min(name, (plan_id, room_id)) AS name, arg_min(flaeche_m2, (NOT ok_f, plan_id, room_id)) FILTER (WHERE flaeche_m2 <> 0) AS flaeche_m2,
  arg_min(umfang_m, (NOT ok_u, plan_id, room_id)) FILTER (WHERE umfang_m <> 0) AS umfang_m, arg_min(hoehe_m, (NOT ok_h, plan_id, room_id)) FILTER (WHERE hoehe_m <> 0) AS hoehe_m,
  arg_min(bodenbelag, (plan_id, room_id)) FILTER (WHERE bodenbelag <> '') AS bodenbelag, bool_or(ok_f AND flaeche_m2 IS NOT NULL) AS verifiziert_f, count(DISTINCT plan_id) AS n_plaene FROM r GROUP BY 1,2,3,4""", "rooms")
def room_priority_merge(t: Tables):
    return G.priority_merge(t.rooms.withColumn("nk", name_key(F.col("name"))), ["projekt_id", "nk", "wohnung", "geschoss"])


@query("opening_combination", "J14")
def opening_combination(t: Tables):
    o = t.openings.select("opening_id", "projekt_id", "art", "breite_m", "hoehe_m", "cx", "cy")
    return G.combine_openings(o.filter("art <> 'tuer'"), o.filter("art = 'tuer'")).select("opening_id", "projekt_id", "art", "breite_m", "hoehe_m", "n_quellen")


@query("opening_clusters", "A15 X3")
def opening_clusters(t: Tables):
    return G.cluster_openings(t.openings)


@query("window_code_groups", "A19", """
, o AS (SELECT *, (-konfidenz, coalesce(breite_m,0), coalesce(hoehe_m,0), opening_id) AS ord FROM openings WHERE code IS NOT NULL)
 SELECT projekt_id, lower(code) AS code, arg_min(opening_id, ord) AS basis, arg_min(breite_m, ord) FILTER (WHERE breite_m <> 0) AS breite_m, arg_min(hoehe_m, ord) FILTER (WHERE hoehe_m <> 0) AS hoehe_m,
  arg_min(raum, ord) FILTER (WHERE raum <> '') AS raum, count(*) AS n FROM o GROUP BY 1, 2""", "openings")
def window_code_groups(t: Tables):
    o = t.openings.filter("code is not null")
    ord_ = F.struct(-F.col("konfidenz"), F.coalesce("breite_m", F.lit(0.0)), F.coalesce("hoehe_m", F.lit(0.0)), F.col("opening_id"))
    pick = lambda c, ok: F.min_by(c, F.when(ok, ord_)).alias(c)
    return o.groupBy("projekt_id", F.lower("code").alias("code")).agg(
        F.min_by("opening_id", ord_).alias("basis"), pick("breite_m", F.col("breite_m") != 0), pick("hoehe_m", F.col("hoehe_m") != 0),
        pick("raum", F.col("raum") != ""), F.count(F.lit(1)).alias("n"))


@query("cousin_rooms", "A13 J16")
def cousin_rooms(t: Tables):
    return G.cousin_rooms(t.rooms)


@query("prefix_duplicates", "A18", """
, r AS (SELECT projekt_id, geschoss, regexp_replace(lower(name), '[^a-zäöüß0-9]', '', 'g') AS nm, CAST(round_even(flaeche_m2*100, 0) AS BIGINT) AS ct, min(room_id) AS rid FROM rooms WHERE flaeche_m2 > 0 GROUP BY ALL)
 SELECT DISTINCT a.rid AS src, b.rid AS dst FROM r a JOIN r b ON a.projekt_id = b.projekt_id AND a.geschoss = b.geschoss AND abs(a.ct - b.ct) <= 1 AND starts_with(b.nm, a.nm) AND a.nm <> b.nm WHERE length(a.nm) >= 3 AND length(b.nm) >= 3""", "rooms")
def prefix_duplicates(t: Tables):
    return G.prefix_duplicates(t.rooms)


@query("fuzzy_room_names", "J15 U3", """
, n AS (SELECT DISTINCT projekt_id, geschoss, name, list_filter(string_split_regex(replace(replace(replace(replace(lower(name),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss'), '[^a-z0-9]+'), lambda w: w <> '') AS tk, nullif(regexp_extract(trim(name), '(\\d+)\\s*$', 1), '') AS ti FROM rooms)
 SELECT a.projekt_id, a.geschoss, a.name, arg_min(b.name, (-len(b.tk), b.name)) AS kanonisch FROM n a JOIN n b ON a.projekt_id = b.projekt_id AND a.geschoss = b.geschoss AND a.tk[-1] = b.tk[-1] AND a.ti IS NOT DISTINCT FROM b.ti AND list_has_all(b.tk, a.tk) GROUP BY 1,2,3""", "rooms")
def fuzzy_room_names(t: Tables):
    from ..functions.text import tokens, trailing_int

    # distinct names of a storey only: the block is spelling variants of one head noun
    n = t.rooms.select("projekt_id", "geschoss", "name").distinct().withColumn("tk", tokens(F.col("name"))).withColumn("ti", F.coalesce(trailing_int(F.col("name")), F.lit(-1)))
    n = n.withColumn("kopf", F.element_at("tk", -1))
    m = n.select("projekt_id", "geschoss", "kopf", "ti", F.col("tk").alias("tk2"), F.col("name").alias("name2"))
    j = n.join(m, ["projekt_id", "geschoss", "kopf", "ti"]).filter(F.size(F.array_except("tk", "tk2")) == 0)
    return j.groupBy("projekt_id", "geschoss", "name").agg(F.min_by("name2", F.struct(-F.size("tk2"), F.col("name2"))).alias("kanonisch"))


@query("grid_dedup", "A17", """
, r AS (SELECT *, round_even(cx/5.0, 0) AS gx, round_even(cy/5.0, 0) AS gy, (CASE WHEN flaeche_m2 <> 0 THEN 1 ELSE 0 END)+(CASE WHEN umfang_m <> 0 THEN 1 ELSE 0 END)+(CASE WHEN hoehe_m <> 0 THEN 1 ELSE 0 END)+(CASE WHEN bodenbelag <> '' THEN 1 ELSE 0 END) AS c FROM rooms)
 SELECT room_id, c::BIGINT AS vollstaendig FROM r QUALIFY row_number() OVER (PARTITION BY projekt_id, seite, gx, gy ORDER BY c DESC, room_id) = 1""", "rooms")
def grid_dedup(t: Tables):
    c = sum(F.when(F.col(k) != 0, 1).otherwise(0) for k in ("flaeche_m2", "umfang_m", "hoehe_m")) + F.when(F.col("bodenbelag") != "", 1).otherwise(0)
    r = t.rooms.withColumn("gx", F.rint(F.col("cx") / 5.0)).withColumn("gy", F.rint(F.col("cy") / 5.0)).withColumn("c", c)
    g = r.groupBy("projekt_id", "seite", "gx", "gy").agg(F.min(F.struct((-F.col("c")).alias("m"), "room_id")).alias("b"))
    return g.select("b.room_id", (-F.col("b.m")).cast("bigint").alias("vollstaendig"))


@query("text_vision_pairs", "J19", f"""
, k AS (SELECT projekt_id, room_id, quelle, {NK.format(c='name')} AS nk, coalesce(floor(flaeche_m2*10+0.5), 0) AS fk FROM rooms)
, a AS (SELECT *, row_number() OVER (PARTITION BY projekt_id, nk, fk ORDER BY md5(room_id), room_id) AS i FROM k WHERE quelle = 'text')
, b AS (SELECT *, row_number() OVER (PARTITION BY projekt_id, nk, fk ORDER BY md5(room_id), room_id) AS i FROM k WHERE quelle <> 'text')
 SELECT a.room_id AS text_id, b.room_id AS vision_id FROM a JOIN b USING (projekt_id, nk, fk, i)""", "rooms")
def text_vision_pairs(t: Tables):
    return G.pair_text_vision(t.rooms.filter("quelle = 'text'"), t.rooms.filter("quelle <> 'text'"))


@query("unmatched_vision", "J20", f"""SELECT room_id FROM rooms r WHERE quelle <> 'text' AND flaeche_m2 <> 0 AND NOT EXISTS (SELECT 1 FROM rooms x WHERE x.projekt_id = r.projekt_id AND x.quelle = 'text' AND x.name = r.name)""", "rooms")
def unmatched_vision(t: Tables):
    txt = t.rooms.filter("quelle = 'text'").select("projekt_id", name_key(F.col("name")).alias("nk")).distinct()
    return t.rooms.filter("quelle <> 'text' and flaeche_m2 <> 0").withColumn("nk", name_key(F.col("name"))).join(txt, ["projekt_id", "nk"], "left_anti").select("room_id")


@query("plan_enrichment", "J21", f"""
, r AS (SELECT *, {NK.format(c='name')} AS nk FROM rooms)
, s AS (SELECT projekt_id, nk, arg_min(flaeche_m2, (plan_id, room_id)) FILTER (WHERE flaeche_m2 <> 0) AS f, arg_min(umfang_m, (plan_id, room_id)) FILTER (WHERE umfang_m <> 0) AS u,
   arg_min(hoehe_m, (plan_id, room_id)) FILTER (WHERE hoehe_m <> 0) AS h, arg_min(bodenbelag, (plan_id, room_id)) FILTER (WHERE bodenbelag <> '') AS b FROM r GROUP BY 1, 2)
 SELECT room_id, coalesce(flaeche_m2, f) AS flaeche_m2, coalesce(umfang_m, u) AS umfang_m, coalesce(hoehe_m, h) AS hoehe_m, coalesce(bodenbelag, b) AS bodenbelag FROM r JOIN s USING (projekt_id, nk)""", "rooms")
def plan_enrichment(t: Tables):
    return G.fill_from_other_plans(t.rooms)


@query("inferred_heights", "C32", f"""
, r AS (SELECT *, coalesce({KAT} = 'Loggia', false) AS aussen FROM rooms)
, m AS (SELECT projekt_id, list_sort(list(hoehe_m)) AS s FROM r WHERE hoehe_m > 0 AND NOT aussen GROUP BY 1)
 SELECT room_id, CASE WHEN hoehe_m > 0 THEN hoehe_m WHEN NOT aussen THEN s[len(s)//2+1] END AS hoehe_m, (hoehe_m IS NULL AND NOT aussen AND s IS NOT NULL) AS abgeleitet, (hoehe_m IS NULL AND aussen) AS nicht_anwendbar FROM r LEFT JOIN m USING (projekt_id)""", "rooms")
def inferred_heights(t: Tables):
    return G.infer_heights(with_category(t.rooms))


@query("foreign_units", "C33", """
, g AS (SELECT projekt_id, lower(replace(wohnung,' ','')) AS einheit, count(*)+count(DISTINCT plan_id) AS score, count(DISTINCT plan_id) AS plaene, list_sort(list(hoehe_m) FILTER (WHERE hoehe_m > 0)) AS hs FROM rooms GROUP BY 1, 2)
, h AS (SELECT *, hs[len(hs)//2+1] AS mh, count(*) OVER (PARTITION BY projekt_id) AS k FROM g)
, d AS (SELECT projekt_id, einheit AS de, mh AS dh FROM h QUALIFY row_number() OVER (PARTITION BY projekt_id ORDER BY score DESC, einheit DESC) = 1)
 SELECT projekt_id, einheit, score, regexp_matches(einheit, 'w\\d|top\\d|og|kg|ug|dg') AS code, plaene <= 1 AS ein_plan, coalesce(abs(mh-dh) > 0.15, false) AS hoehe,
  (CASE WHEN regexp_matches(einheit, 'w\\d|top\\d|og|kg|ug|dg') THEN 1 ELSE 0 END + CASE WHEN plaene <= 1 THEN 1 ELSE 0 END + CASE WHEN coalesce(abs(mh-dh) > 0.15, false) THEN 1 ELSE 0 END) >= 2 AS ausgeschlossen
 FROM h JOIN d USING (projekt_id) WHERE k > 1 AND einheit <> de""", "rooms")
def foreign_units(t: Tables):
    return G.foreign_units(t.rooms)


@query("hallucination_filter", "C34 W9", """
, r AS (SELECT *, lower(trim(name)) AS sn, nullif(regexp_extract(lower(trim(name)), '^([a-zäöüß]+)\\s*(\\d+)$', 1), '') AS st, TRY_CAST(nullif(regexp_extract(lower(trim(name)), '^([a-zäöüß]+)\\s*(\\d+)$', 2), '') AS INTEGER) AS nr FROM rooms)
, tx AS (SELECT DISTINCT projekt_id, sn FROM r WHERE quelle = 'text'), sg AS (SELECT projekt_id, count(*) >= 5 AS stark FROM tx GROUP BY 1)
, nm AS (SELECT projekt_id, sn, st, nr, count(DISTINCT plan_id) AS q FROM r GROUP BY ALL)
, tp AS (SELECT a.projekt_id, a.sn, max(b.nr) AS mx FROM nm a JOIN nm b ON a.projekt_id = b.projekt_id AND a.st = b.st AND b.q >= a.q+1 WHERE a.nr IS NOT NULL AND b.nr IS NOT NULL GROUP BY 1, 2)
, ko AS (SELECT projekt_id, sn, max((coalesce(flaeche_m2,0) <> 0)::INT + (coalesce(umfang_m,0) <> 0)::INT + (coalesce(hoehe_m,0) <> 0)::INT) AS w FROM r GROUP BY ALL)
, sb AS (SELECT a.projekt_id, a.sn, max(b.w) AS teil FROM ko a JOIN ko b ON a.projekt_id = b.projekt_id AND a.sn <> b.sn AND contains(' ' || b.sn || ' ', ' ' || a.sn || ' ') GROUP BY ALL)
 SELECT room_id, CASE WHEN quelle <> 'text' AND coalesce(stark,false) AND tx.sn IS NULL THEN 'ohne Textbeleg' WHEN quelle <> 'text' AND coalesce(stark,false) AND bodenbelag IS NULL THEN 'ohne Bodenbelag'
  WHEN nr IS NOT NULL AND NOT coalesce(flaeche_m2 > 0 AND umfang_m > 0 AND hoehe_m > 0, false) AND nr > mx THEN 'höhere Nummer' WHEN teil >= (coalesce(flaeche_m2,0) <> 0)::INT + (coalesce(umfang_m,0) <> 0)::INT + (coalesce(hoehe_m,0) <> 0)::INT THEN 'Teilname' END AS grund
 FROM r LEFT JOIN tx USING (projekt_id, sn) LEFT JOIN sg USING (projekt_id) LEFT JOIN tp USING (projekt_id, sn) LEFT JOIN sb USING (projekt_id, sn)""", "rooms")
def hallucination_filter(t: Tables):
    return G.hallucination_filter(t.rooms)


@query("perimeter_lookup", "J17", f"""
, r AS (SELECT *, {NK.format(c='name')} AS nk FROM rooms WHERE flaeche_m2 > 0)
 SELECT a.room_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(b.umfang_m) END AS umfang_m FROM r a JOIN r b ON a.projekt_id = b.projekt_id AND a.nk = b.nk AND b.umfang_m > 0 AND b.umfang_quelle = 'geometrie'
  AND abs(b.flaeche_m2 - a.flaeche_m2) <= greatest(0.05, 0.01*a.flaeche_m2) GROUP BY 1""", "rooms")
def perimeter_lookup(t: Tables):
    return G.perimeter_lookup(t.rooms, t.rooms.filter("umfang_quelle = 'geometrie'"))


@query("area_overrides", "J18 F1", """
, c AS (SELECT projekt_id, 'wc' AS k, CASE WHEN projekt_id % 2 = 0 THEN 'EG' END AS g, 2.5 AS f FROM (SELECT DISTINCT projekt_id FROM rooms) UNION ALL SELECT projekt_id, 'wc', NULL, 1.75 FROM (SELECT DISTINCT projekt_id FROM rooms) UNION ALL SELECT projekt_id, 'kueche', NULL, 12.25 FROM (SELECT DISTINCT projekt_id FROM rooms))
 SELECT room_id, CAST(coalesce(c.f, r.flaeche_m2) AS DOUBLE) AS flaeche_m2, c.f IS NOT NULL AS editiert FROM rooms r LEFT JOIN c ON c.projekt_id = r.projekt_id AND c.k = regexp_replace(replace(replace(lower(name),'ü','ue'),'ö','oe'), '[^a-z0-9]', '', 'g') AND (c.g IS NULL OR c.g = r.geschoss) QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY c.g NULLS LAST) = 1""", "rooms")
def area_overrides(t: Tables):
    p = t.rooms.select("projekt_id").distinct()
    c = p.selectExpr("projekt_id", "inline(array(named_struct('k', 'wc', 'g', CASE WHEN projekt_id % 2 = 0 THEN 'EG' END, 'nf', CAST(2.5 AS DOUBLE)), named_struct('k', 'wc', 'g', CAST(NULL AS STRING), 'nf', CAST(1.75 AS DOUBLE)), named_struct('k', 'kueche', 'g', CAST(NULL AS STRING), 'nf', CAST(12.25 AS DOUBLE))))")
    return G.area_overrides(t.rooms, c)



@query("rank_matched_readings", "J44", f"""
, r AS (SELECT *, {NK.format(c='name')} AS nk FROM rooms WHERE flaeche_m2 > 0)
, a AS (SELECT *, row_number() OVER (PARTITION BY projekt_id, geschoss, nk ORDER BY flaeche_m2, room_id) AS i FROM r WHERE quelle = 'text')
, b AS (SELECT *, row_number() OVER (PARTITION BY projekt_id, geschoss, nk ORDER BY flaeche_m2, room_id) AS i FROM r WHERE quelle <> 'text')
 SELECT a.room_id, b.room_id AS lesung_id, round(coalesce(a.umfang_m, b.umfang_m, 2*(sqrt(a.flaeche_m2*1.35)+sqrt(a.flaeche_m2/1.35))), 6) AS umfang_m FROM a LEFT JOIN b USING (projekt_id, geschoss, nk, i)""", "rooms")
def rank_matched_readings(t: Tables):
    from ..functions.geometry import iso_perimeter
    from ..operators.ordering import running_number

    r = t.rooms.filter("flaeche_m2 > 0").withColumn("nk", name_key(F.col("name")))
    key = ["projekt_id", "geschoss", "nk"]
    num = lambda d: running_number(d, key, F.floor("flaeche_m2"), ["flaeche_m2", "room_id"], "i")
    a = num(r.filter("quelle = 'text'"))
    b = num(r.filter("quelle <> 'text'")).select(*key, "i", F.col("room_id").alias("lesung_id"), F.col("umfang_m").alias("lu"))
    return a.join(b, [*key, "i"], "left").select("room_id", "lesung_id", F.round(F.coalesce("umfang_m", "lu", iso_perimeter(F.col("flaeche_m2"))), 6).alias("umfang_m"))


@query("best_chains", "O6", """
, c AS (SELECT projekt_id, achse_id, sum(w) AS s, max(g) AS g FROM (SELECT projekt_id, CAST(x AS BIGINT) % 4 AS seite, CAST(x AS BIGINT) % 4 * 1000 + CAST(y AS BIGINT) AS achse_id, w, 300.0 + CAST(y AS BIGINT) % 7 * 40 AS g FROM measurements) GROUP BY 1, 2)
, v AS (SELECT projekt_id, achse_id // 1000 AS seite, achse_id, abs(s-g) <= greatest(3.0, 0.015*g) AS ok, CASE WHEN abs(s-g) <= greatest(3.0, 0.015*g) THEN g ELSE s END AS l FROM c)
 SELECT projekt_id, seite, achse_id, ok AS validiert, round(l, 4)::DOUBLE AS laenge FROM v QUALIFY row_number() OVER (PARTITION BY projekt_id, seite ORDER BY ok DESC, l DESC, achse_id) = 1""", "measurements")
def best_chains(t: Tables):
    m = t.measurements.selectExpr("projekt_id", "CAST(x AS BIGINT) % 4 * 1000 + CAST(y AS BIGINT) achse_id", "w", "CAST(300.0 + CAST(y AS BIGINT) % 7 * 40 AS DOUBLE) g")
    c = m.groupBy("projekt_id", "achse_id").agg(F.sum("w").alias("s"), F.max("g").alias("g"))
    ok = F.abs(F.col("s") - F.col("g")) <= F.greatest(F.lit(3.0), 0.015 * F.col("g"))
    v = c.withColumn("seite", F.floor(F.col("achse_id") / 1000)).withColumn("validiert", ok).withColumn("laenge", F.when(F.col("validiert"), F.col("g")).otherwise(F.col("s")))
    best = F.min_by(F.struct("achse_id", "validiert", "laenge"), F.struct(~F.col("validiert"), -F.col("laenge"), F.col("achse_id")))
    return v.groupBy("projekt_id", "seite").agg(best.alias("b")).select("projekt_id", "seite", "b.achse_id", "b.validiert", F.round("b.laenge", 4).alias("laenge"))


@query("demo_copy", "S16", """
, p AS (SELECT DISTINCT projekt_id FROM plans WHERE firma_id = 8)
 SELECT 'plans' AS tabelle, CAST(plan_id AS VARCHAR) AS alt_id, CAST(plan_id + 1000000007 AS VARCHAR) AS neu_id, projekt_id + 1000000007 AS projekt_id, plan_id + 1000000007 AS plan_id FROM plans JOIN p USING (projekt_id)
 UNION ALL SELECT 'rooms', room_id, room_id || '~demo', r.projekt_id + 1000000007, CASE WHEN plan_id IN (SELECT plan_id FROM plans JOIN p USING (projekt_id)) THEN plan_id + 1000000007 END FROM rooms r JOIN p USING (projekt_id)
 UNION ALL SELECT 'openings', opening_id, opening_id || '~demo', o.projekt_id + 1000000007, CASE WHEN plan_id IN (SELECT plan_id FROM plans JOIN p USING (projekt_id)) THEN plan_id + 1000000007 END FROM openings o JOIN p USING (projekt_id)
 UNION ALL SELECT 'measurements', messung_id, messung_id || '~demo', m.projekt_id + 1000000007, NULL FROM measurements m JOIN p USING (projekt_id)""", "plans rooms openings measurements")
def demo_copy(t: Tables):
    """Plans, rooms, openings and measurements of one company's projects under new ids."""
    roots = t.plans.filter("firma_id = 8").select(F.col("projekt_id").alias("id")).distinct()
    up = {"projekt_id": "projects"}
    both = {**up, "plan_id": "plans"}
    made = G.copy_subtree([
        ("plans", t.plans, "plan_id", up), ("rooms", t.rooms, "room_id", both), ("openings", t.openings, "opening_id", both),
        ("measurements", t.measurements.withColumn("plan_id", F.lit(None).cast("bigint")), "messung_id", up)], roots, "projects", "demo", 1000000007)
    ids = {"plans": "plan_id", "rooms": "room_id", "openings": "opening_id", "measurements": "messung_id"}
    parts = [d.select(
        F.lit(n).alias("tabelle"), F.col("alt_id").cast("string").alias("alt_id"), F.col(ids[n]).cast("string").alias("neu_id"), "projekt_id", "plan_id") for n, d in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
