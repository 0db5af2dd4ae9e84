"""Queries reconciling several sources of one quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..operators.ordering import order_stats
from ..plans import truth as R
from . import Tables, query

CONF = "round(greatest(0.3, least(0.97, 0.4 + 0.5*{a} + least(0.06, 0.02*greatest(0, {n}-1)))), 2)"


@query("reconcile_counts", "A9 A12", f"""
, c AS (SELECT entity_id, CAST(lesung AS BIGINT) AS v, count(*) AS c FROM readings WHERE lesung IS NOT NULL GROUP BY ALL)
, anc AS (SELECT entity_id, min(lesung) AS tw FROM readings WHERE quelle = 'text' AND konfidenz >= 0.95 AND lesung IS NOT NULL GROUP BY 1)
, g AS (SELECT entity_id, sum(c)::BIGINT AS n, max(c) AS top, count(*) AS dist, arg_min(v, -c * 1000000 + v) AS mode, list_sort(list(v)) AS alle FROM c GROUP BY 1)
, j AS (SELECT g.*, anc.tw, coalesce((SELECT c.c FROM c WHERE c.entity_id = g.entity_id AND c.v = anc.tw), 0) AS sup FROM g LEFT JOIN anc USING (entity_id))
 SELECT entity_id, coalesce(CAST(tw AS BIGINT), mode) AS wert, n, CASE WHEN tw IS NOT NULL THEN 'text-anker' ELSE 'ensemble' END AS quelle,
  CASE WHEN tw IS NOT NULL OR dist = 1 THEN 'bestaetigt' WHEN top >= n//2+1 THEN 'mehrheit' ELSE 'unklar' END AS status,
  round(CASE WHEN tw IS NOT NULL THEN sup*1.0/n ELSE top*1.0/n END, 6) AS agreement,
  CASE WHEN tw IS NOT NULL THEN 0.97::DOUBLE ELSE {CONF.format(a='(top*1.0/n)', n='n')}::DOUBLE END AS konfidenz,
  array_to_string(list_filter(alle, lambda x: x <> coalesce(CAST(tw AS BIGINT), mode)), ',') AS alternativen FROM j""", "readings")
def reconcile_counts(t: Tables):
    r = t.readings
    anchors = r.filter("quelle = 'text' and konfidenz >= 0.95 and lesung is not null").groupBy("entity_id").agg(F.min("lesung").alias("text_wert"))
    return R.reconcile_counts(r, "entity_id", "lesung", anchors).withColumn("agreement", F.round("agreement", 6)).withColumn(
        "alternativen", F.array_join(F.transform("alternativen", lambda x: x.cast("string")), ","))


SNAP = "round(round_even(median({v})/0.05, 0)*0.05, 4)"


@query("reconcile_measures", "A10 A12", f"""
, m AS (SELECT entity_id, {SNAP.format(v='mass_m')} AS wert FROM readings GROUP BY 1)
, g AS (SELECT entity_id, m.wert AS wert, count(*) AS n, sum(CASE WHEN abs(mass_m - m.wert) <= 0.05/2+1e-9 THEN 1 ELSE 0 END)*1.0/count(*) AS a FROM readings JOIN m USING (entity_id) GROUP BY 1, 2)
 SELECT entity_id, wert, n, round(a, 6) AS agreement, CASE WHEN a >= 0.99 THEN 'bestaetigt' WHEN a >= 0.5 THEN 'mehrheit' ELSE 'unklar' END AS status,
  {CONF.format(a='a', n='n')}::DOUBLE AS konfidenz FROM g""", "readings")
def reconcile_measures(t: Tables):
    return R.reconcile_measures(t.readings, "entity_id", "mass_m").withColumn("agreement", F.round("agreement", 6))


@query("reconcile_judgements", "A11", f"""
, med AS (SELECT entity_id, list_sort(list(konfidenz))[len(list(konfidenz))//2+1] AS mk FROM readings GROUP BY 1)
, rep AS (SELECT entity_id, reading_id AS basis FROM readings JOIN med USING (entity_id) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY abs(konfidenz-mk), ord, reading_id) = 1)
, n AS (SELECT entity_id, count(*) AS n, {SNAP.format(v='wert')} AS rohbau_m FROM readings GROUP BY 1)
, s AS (SELECT entity_id, CAST(lesung AS BIGINT) AS saeulen_anzahl FROM readings WHERE lesung IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, CAST(lesung AS BIGINT)) = 1)
, d AS (SELECT entity_id, kategorie AS dach_typ FROM readings GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, min(ord), kategorie) = 1)
 SELECT entity_id, basis, n, saeulen_anzahl, dach_typ, rohbau_m FROM rep JOIN n USING (entity_id) LEFT JOIN s USING (entity_id) LEFT JOIN d USING (entity_id)""", "readings")
def reconcile_judgements(t: Tables):
    return R.reconcile_judgements(t.readings, "entity_id")


@query("order_statistics", "A34", """
, l AS (SELECT entity_id, list_sort(list(wert)) AS s FROM readings GROUP BY 1)
 SELECT entity_id, len(s) AS n, s[len(s)//2+1] AS oben, s[(len(s)-1)//2+1] AS unten, round((s[len(s)//2+1]+s[(len(s)-1)//2+1])/2, 6) AS mitte,
  s[len(s)//4+1] AS q1, s[(3*len(s))//4+1] AS q3 FROM l""", "readings")
def order_statistics(t: Tables):
    o = order_stats(t.readings, ["entity_id"], "wert", {"n": "n", "oben": "upper", "unten": "lower", "mitte": "median", "q1": "q1", "q3": "q3"})
    return o.withColumn("mitte", F.round("mitte", 6))


@query("double_check_numeric", "Q12 U1", """
, r AS (SELECT entity_id, round(wert, 2) AS v, quelle_typ AS t FROM readings WHERE wert > 0)
, g AS (SELECT entity_id, list_sort(list(v)) AS s, count(*) AS n, count(DISTINCT t) AS typen_n, list_sort(list(v) FILTER (WHERE t='text')) AS ts FROM r GROUP BY 1 HAVING count(*) >= 2)
, h AS (SELECT *, s[n//2+1] AS med, ts[len(ts)//2+1] AS tmed, (abs(s[1]-s[n//2+1]) <= 0.05 AND abs(s[n]-s[n//2+1]) <= 0.05) AS agree FROM g)
 SELECT entity_id, CASE WHEN NOT agree AND len(ts) > 0 AND len(ts) < n THEN tmed ELSE med END AS wert, n, typen_n,
  CASE WHEN NOT agree THEN 'widerspruch' WHEN typen_n >= 2 THEN 'bestätigt' ELSE 'verstaerkt' END AS status,
  coalesce(NOT agree AND len(ts) > 0 AND len(ts) < n, false) AS text_bevorzugt FROM h""", "readings")
def double_check_numeric(t: Tables):
    return R.double_check_numeric(t.readings, "entity_id", "wert", "quelle_typ", 0.05)


@query("double_check_category", "Q13", """
 SELECT entity_id, arg_min(lower(kategorie), ord * 1000 + lauf) AS wert, count(*) AS n, count(DISTINCT quelle_typ) AS typen_n,
  CASE WHEN count(DISTINCT lower(kategorie)) > 1 THEN 'widerspruch' WHEN count(DISTINCT quelle_typ) >= 2 THEN 'bestätigt' ELSE 'verstaerkt' END AS status
 FROM readings GROUP BY 1 HAVING count(*) >= 2""", "readings")
def double_check_category(t: Tables):
    return R.double_check_category(t.readings.withColumn("_o", F.col("ord") * 1000 + F.col("lauf")), "entity_id", "kategorie", "quelle_typ", "_o")


@query("multiset_consensus", "A53", """
, b AS (SELECT *, floor(coalesce(breite_m,0)*100/15.0 + 0.5) AS bb, floor(coalesce(hoehe_m,0)*100/15.0 + 0.5) AS bh, coalesce(raum,'') AS rr, plan_id % 3 AS lauf FROM openings)
, runs AS (SELECT geschoss, count(DISTINCT lauf) AS k FROM b GROUP BY 1)
, c AS (SELECT geschoss, rr, bb, bh, lauf, count(*) AS c FROM b GROUP BY ALL)
, g AS (SELECT geschoss, rr, bb, bh, list_sort(list(c)) AS s, count(*) AS present FROM c GROUP BY ALL)
, f AS (SELECT g.*, CASE WHEN k//2 < k - present THEN 0 ELSE s[k//2 - (k - present) + 1] END AS n FROM g JOIN runs USING (geschoss))
, src AS (SELECT f.geschoss, f.rr, f.bb, f.bh, f.n, min(c.lauf) AS lauf FROM f JOIN c USING (geschoss, rr, bb, bh) WHERE f.n > 0 AND c.c >= f.n GROUP BY ALL)
 SELECT opening_id FROM b JOIN src USING (geschoss, rr, bb, bh, lauf) QUALIFY row_number() OVER (PARTITION BY geschoss, rr, bb, bh, lauf ORDER BY md5(opening_id), opening_id) <= any_value(n) OVER (PARTITION BY geschoss, rr, bb, bh, lauf)""", "openings")
def multiset_consensus(t: Tables):
    o = t.openings.select(
        "opening_id", "geschoss", (F.col("plan_id") % 3).alias("lauf"), F.coalesce("raum", F.lit("")).alias("rr"),
        F.floor(F.coalesce("breite_m", F.lit(0.0)) * 100 / 15.0 + 0.5).alias("bb"), F.floor(F.coalesce("hoehe_m", F.lit(0.0)) * 100 / 15.0 + 0.5).alias("bh"))
    return R.multiset_consensus(o, "geschoss", "lauf", ["rr", "bb", "bh"], "opening_id", o.select("geschoss", "lauf")).select("opening_id")


@query("symbol_count_consensus", "A54 A50", """
, r AS (SELECT entity_id, reading_id, lesung, ord FROM readings)
, m AS (SELECT entity_id, list_sort(list(lesung) FILTER (WHERE lesung IS NOT NULL)) AS s FROM r GROUP BY 1)
, k AS (SELECT entity_id, s[(len(s)-1)//2+1] AS med FROM m WHERE len(s) > 0)
 SELECT entity_id, med, reading_id AS vertreter FROM r JOIN k USING (entity_id) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY abs(coalesce(lesung,0)-med), ord, reading_id) = 1""", "readings")
def symbol_count_consensus(t: Tables):
    r = t.readings
    med = order_stats(r, ["entity_id"], "lesung", {"med": "lower"})
    d = F.abs(F.coalesce("lesung", F.lit(0.0)) - F.col("med"))
    return r.join(med, "entity_id").groupBy("entity_id", "med").agg(F.min_by("reading_id", F.struct(d, F.col("ord"), F.col("reading_id"))).alias("vertreter"))


@query("box_consensus", "A50", """
, n AS (SELECT projekt_id, name, count(DISTINCT plan_id) AS laeufe, list_sort(list(cx)) AS sx, list_sort(list(cy)) AS sy FROM rooms GROUP BY ALL)
, p AS (SELECT projekt_id, count(DISTINCT plan_id) AS k FROM rooms GROUP BY 1)
 SELECT projekt_id, name, len(sx) AS n, sx[len(sx)//2+1] AS mx, sy[len(sy)//2+1] AS my FROM n JOIN p USING (projekt_id) WHERE len(sx) >= greatest(2, (k+1)//2)""", "rooms")
def box_consensus(t: Tables):
    r = t.rooms
    k = r.groupBy("projekt_id").agg(F.count_distinct("plan_id").alias("k"))
    key = ["projekt_id", "name"]
    x = order_stats(r, key, "cx", {"mx": "upper", "n": "n"})
    y = order_stats(r, key, "cy", {"my": "upper"})
    return x.join(y, key).join(k, "projekt_id").filter("n >= greatest(2, floor((k + 1) / 2))").drop("k")


@query("symbol_cap", "A20 O1", """
, v AS (SELECT projekt_id, geschoss, plan_id % 9 AS n FROM plans WHERE konfidenz > 0.4)
, s AS (SELECT projekt_id, geschoss, max(n) AS m FROM v GROUP BY ALL)
, cap AS (SELECT projekt_id, CASE WHEN count(*) >= 2 THEN sum(m) ELSE max(m) END AS k FROM s GROUP BY 1)
, r AS (SELECT o.opening_id, o.projekt_id, c.k, row_number() OVER (PARTITION BY o.projekt_id ORDER BY CASE WHEN breite_m IS NOT NULL AND hoehe_m IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN quelle='text' THEN 0 ELSE 1 END, o.konfidenz DESC, opening_id) AS rn FROM openings o LEFT JOIN cap c USING (projekt_id))
 SELECT opening_id FROM r WHERE k IS NULL OR k <= 0 OR rn <= k""", "plans openings")
def symbol_cap(t: Tables):
    from ..plans.merge import cap_openings, symbol_maximum

    counts = t.plans.filter("konfidenz > 0.4").select("projekt_id", "geschoss", (F.col("plan_id") % 9).alias("n"))
    return cap_openings(t.openings, symbol_maximum(counts)).select("opening_id")


@query("hull_sanity", "A56 A23", """
, s AS (SELECT plan_id, sum(wert) AS summe FROM (SELECT o_orderkey AS plan_id, unnest([10.0+o_custkey%7, 8.0+o_custkey%5, 10.0+o_custkey%6, 8.0+o_custkey%4]) AS wert FROM orders) GROUP BY 1)
, h AS (SELECT b.plan_id, s.summe, b.aussenumfang_m AS u, b.bodenplatte_m2 AS a, 30.0 + b.plan_id % 50 AS fu, 90.0 + b.plan_id % 150 AS ff FROM building b JOIN s USING (plan_id))
, k AS (SELECT *, CASE WHEN u IS NULL OR abs(summe-u) > 2.0 THEN round(summe,2) ELSE u END AS umf FROM h)
 SELECT plan_id, umf AS umfang_m, round(least(greatest(fu, umf), umf*1.3), 4) AS fundament_umfang_m, round(CASE WHEN a IS NOT NULL THEN least(greatest(ff, a), a*1.6) END, 4) AS fundament_flaeche_m2 FROM k""", "building")
def hull_sanity(t: Tables):
    sides = t.orders.selectExpr(
        "o_orderkey plan_id",
        "stack(4, 'N', CAST(10.0+o_custkey%7 AS DOUBLE), 'O', CAST(8.0+o_custkey%5 AS DOUBLE), 'S', CAST(10.0+o_custkey%6 AS DOUBLE), 'W', CAST(8.0+o_custkey%4 AS DOUBLE)) AS (seite, wert)")
    s = sides.groupBy("plan_id").agg(F.sum("wert").alias("summe"))
    h = t.building.join(s, "plan_id").selectExpr("plan_id", "summe", "aussenumfang_m u", "bodenplatte_m2 a", "CAST(30.0 + plan_id % 50 AS DOUBLE) fu", "CAST(90.0 + plan_id % 150 AS DOUBLE) ff")
    u = F.col("u")
    h = h.withColumn("umfang_m", F.when(u.isNull() | (F.abs(F.col("summe") - u) > 2.0), F.round("summe", 2)).otherwise(u))
    umf, a = F.col("umfang_m"), F.col("a")
    return h.select("plan_id", "umfang_m", F.round(F.least(F.greatest("fu", umf), umf * 1.3), 4).alias("fundament_umfang_m"),
                    F.round(F.when(a.isNotNull(), F.least(F.greatest("ff", a), a * 1.6)), 4).alias("fundament_flaeche_m2"))


@query("side_box", "A23", """
, s AS (SELECT o_orderkey AS plan_id, 10.0+o_custkey%7 AS n, 8.0+o_custkey%5 AS o, 10.0+o_custkey%6 AS s, 2.0+o_custkey%4 AS w FROM orders)
 SELECT plan_id, CAST(greatest(n, s) AS DOUBLE) AS breite_m, CAST(greatest(o, w) AS DOUBLE) AS tiefe_m, CAST(2*(greatest(n,s)+greatest(o,w)) AS DOUBLE) AS umfang_m FROM s
 WHERE greatest(n,s) BETWEEN 4 AND 60 AND greatest(o,w) BETWEEN 4 AND 60""", "building")
def side_box(t: Tables):
    sides = t.orders.selectExpr(
        "o_orderkey plan_id",
        "stack(4, 'N', CAST(10.0+o_custkey%7 AS DOUBLE), 'O', CAST(8.0+o_custkey%5 AS DOUBLE), 'S', CAST(10.0+o_custkey%6 AS DOUBLE), 'W', CAST(2.0+o_custkey%4 AS DOUBLE)) AS (seite, wert)")
    p = sides.groupBy("plan_id").agg(*[F.sum(F.when(F.col("seite") == k, F.col("wert"))).alias(k) for k in "NOSW"])
    b, d = F.greatest("N", "S"), F.greatest("O", "W")
    return p.filter(b.between(4, 60) & d.between(4, 60)).select("plan_id", b.alias("breite_m"), d.alias("tiefe_m"), (2 * (b + d)).alias("umfang_m"))


@query("candidate_hull", "A22", """
, c AS (SELECT entity_id, 30.0 + ord % 60 AS u, quelle FROM readings)
, s AS (SELECT entity_id, list_sort(list(u)) AS xs, len(list(u)) AS n FROM c GROUP BY 1)
, m AS (SELECT entity_id, xs, n, xs[n//2+1] AS med FROM s)
, d AS (SELECT *, coalesce(nullif(list_sort(list_transform(xs, lambda x: abs(x-med)))[n//2+1], 0), 1e-9) AS mad FROM m)
, k AS (SELECT entity_id, xs, CASE WHEN n < 3 THEN xs ELSE list_filter(xs, lambda x: NOT (abs(x-med) > 1.5*mad AND x < 45.0)) END AS keep FROM d)
, q AS (SELECT entity_id, CASE WHEN len(keep) = 0 THEN xs ELSE keep END AS keep FROM k)
 SELECT entity_id, len(keep) AS n, CAST(keep[(len(keep)-1)//2+1] AS DOUBLE) AS umfang FROM q""", "readings")
def candidate_hull(t: Tables):
    c = t.readings.select("entity_id", (F.lit(30.0) + F.col("ord") % 60).cast("double").alias("u"))
    return robust_hull(c, "entity_id", "u", 45.0)


def robust_hull(c, key, value, floor_value):
    """MAD filter against under-read candidates, then the lower median of what is left."""
    med = order_stats(c, [key], value, {"_m": "upper", "_n": "n"})
    d = c.join(med, key).withColumn("_a", F.abs(F.col(value) - F.col("_m")))
    mad = order_stats(d, [key], "_a", {"_mad": "upper"}).withColumn("_mad", F.when(F.col("_mad") == 0, F.lit(1e-9)).otherwise(F.col("_mad")))
    d = d.join(mad, key)
    drop = (F.col("_n") >= 3) & (F.col("_a") > 1.5 * F.col("_mad")) & (F.col(value) < floor_value)
    d = d.withColumn("_k", ~drop)
    kept = order_stats(d.filter("_k"), [key], value, {"_u": "lower", "_c": "n"})
    every = order_stats(d, [key], value, {"_u2": "lower", "_c2": "n"})
    return every.join(kept, key, "left").select(key, F.coalesce("_c", "_c2").alias("n"), F.coalesce("_u", "_u2").alias("umfang"))


@query("judgement_gates", "P5 P6 P7", """
, b AS (SELECT plan_id, projekt_id, coalesce(aussenumfang_m, 40.0) AS u, konfidenz AS k, CASE plan_id % 4 WHEN 0 THEN 'Carport' WHEN 1 THEN 'Garage' WHEN 2 THEN 'Überdachte Terrasse' ELSE 'Lager' END AS name,
   CASE WHEN plan_id % 3 = 0 THEN 'offen' ELSE 'gemauert' END AS gt, 5.0 + plan_id % 40 AS mz, (plan_id % 2 = 0) AS slab, geschosshoehe_m AS h FROM building)
, z AS (SELECT projekt_id, sum(CASE WHEN NOT regexp_matches(lower(name), 'carport|terrasse|überdach') AND gt='gemauert' AND k >= 0.75 AND mz <= u*0.6 THEN mz ELSE 0 END) AS mauer,
   sum(CASE WHEN slab AND k >= 0.6 AND mz <= u*0.6 THEN mz ELSE 0 END) AS platte, max(CASE WHEN k >= 0.6 AND h BETWEEN 2.2 AND 4.5 THEN h END) AS hoehe FROM b GROUP BY 1)
 SELECT projekt_id, CAST(mauer AS DOUBLE) AS mauerwerk_zusatz, CAST(platte AS DOUBLE) AS platten_zusatz, hoehe FROM z""", "building")
def judgement_gates(t: Tables):
    from ..plans.merge import covered_additions

    areas = t.building.selectExpr(
        "plan_id", "projekt_id", "coalesce(aussenumfang_m, CAST(40.0 AS DOUBLE)) umfang_m", "konfidenz",
        "CASE plan_id % 4 WHEN 0 THEN 'Carport' WHEN 1 THEN 'Garage' WHEN 2 THEN 'Überdachte Terrasse' ELSE 'Lager' END name",
        "CASE WHEN plan_id % 3 = 0 THEN 'offen' ELSE 'gemauert' END geschlossen_typ", "CAST(5.0 + plan_id % 40 AS DOUBLE) zusatz_m", "plan_id % 2 = 0 auf_slab", "geschosshoehe_m")
    add = covered_additions(areas)
    h = F.max(F.when((F.col("konfidenz") >= 0.6) & F.col("geschosshoehe_m").between(2.2, 4.5), F.col("geschosshoehe_m"))).alias("hoehe")
    return add.join(areas.groupBy("projekt_id").agg(h), "projekt_id")


@query("provenance_list", "Q14", """
 SELECT projekt_id, groesse, wert, quelle FROM (
  SELECT plan_id, projekt_id, 'aussenwand_cm' AS groesse, aussenwand_cm AS wert, CASE WHEN aussenwand_cm IS NULL THEN 'default' ELSE quelle_h END AS quelle, konfidenz, rang FROM building
  UNION ALL SELECT plan_id, projekt_id, 'decke_cm', decke_cm, CASE WHEN decke_cm IS NULL THEN 'default' ELSE quelle_h END, konfidenz, rang FROM building
  UNION ALL SELECT plan_id, projekt_id, 'geschosshoehe_m', geschosshoehe_m, CASE WHEN geschosshoehe_m IS NULL THEN 'default' ELSE quelle_h END, konfidenz, rang FROM building)
 QUALIFY row_number() OVER (PARTITION BY projekt_id, groesse ORDER BY konfidenz DESC, rang DESC, plan_id DESC) = 1""", "building")
def provenance_list(t: Tables):
    from ..plans.trades import best_building

    b = best_building(t.building)
    long = b.selectExpr("projekt_id", "quelle_h", "stack(3, 'aussenwand_cm', aussenwand_cm, 'decke_cm', decke_cm, 'geschosshoehe_m', geschosshoehe_m) AS (groesse, wert)")
    return long.select("projekt_id", "groesse", "wert", F.when(F.col("wert").isNull(), F.lit("default")).otherwise(F.col("quelle_h")).alias("quelle"))


@query("building_precedence", "C35 Q14", """
, s AS (SELECT projekt_id, max(hoehe_m) AS h_raum FROM rooms WHERE hoehe_m BETWEEN 2.2 AND 4.5 GROUP BY 1)
, x AS (SELECT b.projekt_id, max(CASE WHEN quelle_h='schnitt' THEN geschosshoehe_m END) AS h_schnitt, max(CASE WHEN quelle_h='vision' AND konfidenz >= 0.6 THEN geschosshoehe_m END) AS h_urteil,
   max(CASE WHEN quelle_h='legende' THEN aussenwand_cm END) AS aw_leg, max(CASE WHEN quelle_h='vision' THEN aussenwand_cm END) AS aw_vis FROM building b GROUP BY 1)
, y AS (SELECT x.*, h_raum, CASE WHEN h_schnitt IS NOT NULL AND (h_raum IS NULL OR h_schnitt >= h_raum - 0.05) THEN h_schnitt ELSE h_raum END AS h1,
   (h_schnitt IS NOT NULL AND (h_raum IS NULL OR h_schnitt >= h_raum - 0.05)) AS von_schnitt FROM x LEFT JOIN s USING (projekt_id))
 SELECT projekt_id, CASE WHEN h_urteil IS NOT NULL AND NOT von_schnitt AND (h1 IS NULL OR h_urteil >= h1 - 0.05) THEN h_urteil ELSE h1 END AS geschosshoehe_m,
  CASE WHEN h_urteil IS NOT NULL AND NOT von_schnitt AND (h1 IS NULL OR h_urteil >= h1 - 0.05) THEN 'urteil' WHEN von_schnitt THEN 'schnitt' WHEN h1 IS NOT NULL THEN 'raumhoehen' ELSE 'default' END AS quelle,
  coalesce(aw_leg, aw_vis, 38.0) AS aussenwand_cm FROM y""", "building rooms")
def building_precedence(t: Tables):
    from ..plans.merge import storey_height_precedence

    b = t.building.groupBy("projekt_id").agg(
        F.max(F.when(F.col("quelle_h") == "schnitt", F.col("geschosshoehe_m"))).alias("h_schnitt"),
        F.max(F.when((F.col("quelle_h") == "vision") & (F.col("konfidenz") >= 0.6), F.col("geschosshoehe_m"))).alias("h_urteil"),
        F.max(F.when(F.col("quelle_h") == "legende", F.col("aussenwand_cm"))).alias("aw_leg"),
        F.max(F.when(F.col("quelle_h") == "vision", F.col("aussenwand_cm"))).alias("aw_vis"))
    r = t.rooms.filter(F.col("hoehe_m").between(2.2, 4.5)).groupBy("projekt_id").agg(F.max("hoehe_m").alias("h_raum"))
    return storey_height_precedence(b.join(r, "projekt_id", "left")).select(
        "projekt_id", "geschosshoehe_m", "quelle", F.coalesce("aw_leg", "aw_vis", F.lit(38.0)).alias("aussenwand_cm"))


@query("foundation_edge", "C31", """
, x AS (SELECT projekt_id, max(aussenumfang_m) AS u, max(30.0 + plan_id % 70) AS k1, max(bodenplatte_m2) AS a FROM building GROUP BY 1)
 SELECT projekt_id, round(least(greatest(u, CAST(k1 AS DOUBLE), coalesce(4*sqrt(a),0)), u*1.3), 4) AS fundament_umfang_m,
  CASE WHEN greatest(CAST(k1 AS DOUBLE), coalesce(4*sqrt(a),0)) <= u THEN 'huelle' WHEN k1 >= coalesce(4*sqrt(a),0) THEN 'kontur' ELSE 'flaeche' END AS quelle FROM x WHERE u IS NOT NULL""", "building")
def foundation_edge(t: Tables):
    x = t.building.groupBy("projekt_id").agg(
        F.max("aussenumfang_m").alias("u"), F.max((F.lit(30.0) + F.col("plan_id") % 70).cast("double")).alias("k1"), F.max("bodenplatte_m2").alias("a")).filter("u is not null")
    sq = F.coalesce(4 * F.sqrt("a"), F.lit(0.0))
    best = F.greatest("k1", sq)
    return x.select(
        "projekt_id", F.round(F.least(F.greatest(F.col("u"), best), F.col("u") * 1.3), 4).alias("fundament_umfang_m"),
        F.when(best <= F.col("u"), F.lit("huelle")).when(F.col("k1") >= sq, F.lit("kontur")).otherwise(F.lit("flaeche")).alias("quelle"))


@query("footprint_storey", "C30 O5", """
, g AS (SELECT projekt_id, geschoss, sum(coalesce(flaeche_m2,0)) AS f, count(*) AS n FROM rooms GROUP BY ALL)
, r AS (SELECT *, CASE WHEN contains(lower(geschoss),'eg') THEN 0 WHEN contains(lower(geschoss),'kg') THEN 1 ELSE 2 END AS rang FROM g)
 SELECT projekt_id, geschoss, round(f, 4) AS flaeche, n FROM r QUALIFY row_number() OVER (PARTITION BY projekt_id ORDER BY rang, -round(f,4), geschoss) = 1""", "rooms")
def footprint_storey(t: Tables):
    from ..plans.merge import footprint

    return footprint(t.rooms)


@query("external_totals_check", "J31", """
, l AS (SELECT plan_id, name, round(sum(coalesce(flaeche_m2,0)), 4) AS lokal FROM rooms GROUP BY plan_id, name)
, e AS (SELECT plan_id, name, round(sum(coalesce(flaeche_m2,0)) * (1 + (plan_id % 12) * 0.01), 4) AS extern FROM rooms GROUP BY plan_id, name)
 SELECT plan_id, name, CASE WHEN lokal > 0 AND abs(extern-lokal)/lokal > 0.05 THEN lokal ELSE extern END AS wert, coalesce(lokal > 0 AND abs(extern-lokal)/nullif(lokal,0) > 0.05, false) AS ersetzt FROM l JOIN e USING (plan_id, name)""", "rooms")
def external_totals_check(t: Tables):
    f = F.sum(F.coalesce("flaeche_m2", F.lit(0.0)))
    loc = t.rooms.groupBy("plan_id", "name").agg(F.round(f, 4).alias("lokal"))
    ext = t.rooms.groupBy("plan_id", "name").agg(F.round(f * (1 + (F.col("plan_id") % 12) * 0.01), 4).alias("extern"))
    bad = F.coalesce((F.col("lokal") > 0) & (F.abs(F.col("extern") - F.col("lokal")) / F.when(F.col("lokal") != 0, F.col("lokal")) > 0.05), F.lit(False))
    return loc.join(ext, ["plan_id", "name"]).select("plan_id", "name", F.when(bad, F.col("lokal")).otherwise(F.col("extern")).alias("wert"), bad.alias("ersetzt"))
