"""Queries over measurements and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans import measurements as M
from . import Tables, query

AREA = "abs((x*y - (x+w)*y) + ((x+w)*(y+h) - (x+w+schief)*y) + ((x+w+schief)*(y+h) - x*(y+h)) + (x*y - x*(y+h)))/2.0"
# edge lengths of the quadrilateral (x,y) (x+w,y) (x+w+s,y+h) (x,y+h)
E1, E2, E3, E4 = "w", "sqrt(schief*schief + h*h)", "(w+schief)", "h"
VAL = f"""
, g AS (SELECT *, {AREA}/(ptm*ptm) AS a, ({E1}+{E2}+{E3}+(CASE WHEN geschlossen THEN {E4} ELSE 0 END))/ptm AS l,
   greatest(w + greatest(schief,0), h)/ptm AS run, coalesce(hoehe_m, 2.75) AS rise FROM measurements)
, v AS (SELECT *, CASE typ WHEN 'stueck' THEN 4.0 WHEN 'laenge' THEN l
   WHEN 'wandflaeche' THEN CASE WHEN l > 0 AND hoehe_m > 0 THEN l*hoehe_m END
   WHEN 'dach' THEN CASE WHEN neigung_grad > 0 AND neigung_grad < 80 AND a > 0 THEN a/cos(radians(neigung_grad)) END
   WHEN 'treppe' THEN a*sqrt(1+(rise/run)*(rise/run)) WHEN 'volumen' THEN a*coalesce(hoehe_m,0) ELSE a END AS wert FROM g)
"""


def measured(t: Tables):
    m = t.measurements
    pt = lambda px, py: F.array(px, py)
    x, y, w, h, s = (F.col(c) for c in ("x", "y", "w", "h", "schief"))
    return m.withColumn("punkte", F.array(pt(x, y), pt(x + w, y), pt(x + w + s, y + h), pt(x, y + h)))


@query("measurement_values", "G1 G2 G3 G4", VAL + f"""
 SELECT messung_id, round(wert, 4) AS wert, CASE typ WHEN 'laenge' THEN 'm' WHEN 'stueck' THEN 'stk' WHEN 'volumen' THEN 'm3' ELSE 'm2' END AS einheit,
  CASE WHEN typ IN ('flaeche','abzug','bauteil') THEN CASE WHEN abs({E1}-{E3})/ptm <= 0.01 AND abs({E2}-{E4})/ptm <= 0.01
   THEN 'Rechteck' ELSE 'Polygon 4 Punkte' END END AS form FROM v""", "measurements")
def measurement_values(t: Tables):
    e = M.evaluate(measured(t))
    shape = F.when(F.col("formel").startswith("Polygon"), F.col("formel")).otherwise(F.lit("Rechteck"))
    return e.select("messung_id", F.round("wert", 4).alias("wert"), "einheit",
                    F.when(F.col("typ").isin("flaeche", "abzug", "bauteil"), shape).alias("form"))


@query("measurement_net_areas", "G4", VAL + """
, p AS (SELECT projekt_id, min(messung_id) AS parent_id FROM v WHERE typ = 'flaeche' GROUP BY 1)
, k AS (SELECT p.parent_id, sum(v.wert) AS s FROM v JOIN p USING (projekt_id) WHERE v.typ = 'abzug' GROUP BY 1)
 SELECT messung_id, round(v.a - coalesce(k.s, 0), 4) AS wert FROM v LEFT JOIN k ON v.messung_id = k.parent_id WHERE typ = 'flaeche'""", "measurements")
def measurement_net_areas(t: Tables):
    m = measured(t)
    parents = m.filter("typ = 'flaeche'").groupBy("projekt_id").agg(F.min("messung_id").alias("parent_id"))
    kids = M.evaluate(m.filter("typ = 'abzug'")).join(parents, "projekt_id").select("parent_id", "wert")
    return M.evaluate(m.filter("typ = 'flaeche'"), kids).select("messung_id", F.round("wert", 4).alias("wert"))


@query("measurement_protocol", "A2 R1", VAL + """
, pos AS (SELECT DISTINCT position_id, CAST(length(position_id) % 4 AS DOUBLE) * 2.5 AS verschnitt_pct FROM measurements WHERE position_id IS NOT NULL)
, s AS (SELECT position_id, sum(CASE WHEN typ = 'abzug' THEN -coalesce(wert,0) ELSE coalesce(wert,0) END) AS summe, count(*) AS n FROM v WHERE status <> 'verworfen' GROUP BY 1)
 SELECT position_id, round(coalesce(summe,0), 3) AS summe, verschnitt_pct, round(coalesce(summe,0)*(1+verschnitt_pct/100.0), 3) AS endsumme, coalesce(n,0) AS n_messungen
 FROM pos LEFT JOIN s USING (position_id)""", "measurements")
def measurement_protocol(t: Tables):
    e = M.evaluate(measured(t))
    pos = t.measurements.filter("position_id is not null").selectExpr(
        "position_id", "CAST(length(position_id) % 4 AS DOUBLE) * 2.5 AS verschnitt_pct").distinct()
    p, _ = M.protocol(e, pos)
    return p.select("position_id", F.round("summe", 3).alias("summe"), "verschnitt_pct", F.round("endsumme", 3).alias("endsumme"), "n_messungen")


@query("measurement_unassigned", "A2", "SELECT projekt_id, count(*) AS n FROM measurements WHERE position_id IS NULL AND status <> 'verworfen' GROUP BY 1", "measurements")
def measurement_unassigned(t: Tables):
    live = t.measurements.filter("status <> 'verworfen' and position_id is null")
    return live.groupBy("projekt_id").agg(F.count(F.lit(1)).alias("n"))


@query("measurement_numbers", "W7", """
 SELECT messung_id, projekt_id, row_number() OVER (PARTITION BY projekt_id ORDER BY erstellt_am, messung_id) AS nummer FROM measurements""", "measurements")
def measurement_numbers(t: Tables):
    return M.number_measurements(t.measurements).select("messung_id", "projekt_id", "nummer")


@query("measurement_proposals", "G5", VAL + """
 SELECT messung_id, projekt_id, round(coalesce(nullif(stempel_f,0), a), 4) AS wert, (nullif(stempel_f,0) IS NOT NULL) AS lt_stempel FROM v""", "measurements")
def measurement_proposals(t: Tables):
    return M.proposals(measured(t)).select("messung_id", "projekt_id", F.round("wert", 4).alias("wert"), F.col("formel").isNotNull().alias("lt_stempel"))


@query("proposal_replacement", "U6", """
, ex AS (SELECT messung_id, projekt_id || ':' || (CAST(w AS BIGINT) % 40) AS ref, quelle, status FROM measurements)
, kept AS (SELECT * FROM ex WHERE NOT (quelle = 'ki' AND status = 'vorschlag'))
, fresh AS (SELECT 'N' || messung_id AS messung_id, projekt_id || ':' || (CAST(h AS BIGINT) % 40) AS ref, 'ki' AS quelle, 'vorschlag' AS status FROM measurements)
 SELECT * FROM kept UNION ALL SELECT * FROM fresh WHERE ref NOT IN (SELECT ref FROM kept)""", "measurements")
def proposal_replacement(t: Tables):
    m = t.measurements
    ref = lambda c: F.concat(F.col("projekt_id").cast("string"), F.lit(":"), (F.col(c).cast("bigint") % 40).cast("string"))
    ex = m.select("messung_id", ref("w").alias("ref"), "quelle", "status")
    fresh = m.select(F.concat(F.lit("N"), "messung_id").alias("messung_id"), ref("h").alias("ref"), F.lit("ki").alias("quelle"), F.lit("vorschlag").alias("status"))
    return M.replace_proposals(ex, fresh)


def _poly(t: Tables):
    e = F.col("embedding")
    n = (F.size(e) / 2).cast("int")
    pts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get(e, 2 * i).cast("double"), F.get(e, 2 * i + 1).cast("double")))
    return t.embeddings.select("vec_id", pts.alias("punkte"))


PTS = """WITH p AS (SELECT vec_id, len(embedding)//2 AS n, unnest(range(0, len(embedding)//2)) AS i, embedding AS e FROM embeddings)
, q AS (SELECT vec_id, n, i, e[2*i+1]::DOUBLE AS x1, e[2*i+2]::DOUBLE AS y1, e[2*((i+1)%n)+1]::DOUBLE AS x2, e[2*((i+1)%n)+2]::DOUBLE AS y2 FROM p)
"""


@query("polygon_measures", "G1 G2", PTS + """SELECT vec_id, max(n) AS n, round(abs(sum(x1*y2 - x2*y1))/2, 9) AS flaeche,
 round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))), 9) AS umfang, round(sum(CASE WHEN i < n-1 THEN sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) ELSE 0 END), 9) AS laenge FROM q GROUP BY 1""")
def polygon_measures(t: Tables):
    p = F.col("punkte")
    return _poly(t).select("vec_id", F.size(p).cast("bigint").alias("n"), F.round(G.polygon_area(p), 9).alias("flaeche"),
                           F.round(G.polyline_length(p, True), 9).alias("umfang"), F.round(G.polyline_length(p), 9).alias("laenge"))


@query("polygon_contains", "G12", PTS + """SELECT vec_id, (sum(CASE WHEN (y1 > 0.01) <> (y2 > 0.01) AND 0.02 < (x2-x1)*(0.01-y1)/nullif(y2-y1,0) + x1 THEN 1 ELSE 0 END) % 2) = 1 AS innen,
 abs(sum(x1*y2 - x2*y1))/2 BETWEEN 0.8*0.05 AND 1.2*0.05 AS flaeche_ok FROM q GROUP BY 1""")
def polygon_contains(t: Tables):
    p = F.col("punkte")
    a = G.polygon_area(p)
    return _poly(t).select("vec_id", G.point_in_polygon(F.lit(0.02), F.lit(0.01), p).alias("innen"), a.between(0.8 * 0.05, 1.2 * 0.05).alias("flaeche_ok"))


@query("polygon_simplified", "G7 X2")
def polygon_simplified(t: Tables):
    s = _poly(t).withColumn("einfach", G.simplify("punkte", F.lit(0.2)))
    return s.select("vec_id", F.size("punkte").cast("bigint").alias("n_vorher"), F.size("einfach").cast("bigint").alias("n_nachher"))


@query("geometry_perimeter", "G6 F15", PTS + """, a AS (SELECT vec_id, abs(sum(x1*y2 - x2*y1))/2 AS f, sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) AS u, max(x1)-min(x1) AS bw, max(y1)-min(y1) AS bh FROM q GROUP BY 1)
 SELECT vec_id, round(CASE WHEN f/(bw*bh) < 0.72 THEN u*sqrt(0.5/f) ELSE sqrt(u*sqrt(0.5/f) * 2*(sqrt(0.5*bw/bh)+sqrt(0.5*bh/bw))) END, 6) AS umfang FROM a""")
def geometry_perimeter(t: Tables):
    """Outline perimeter scaled to a read area of 0.5, blended with the box's isoperimetric one."""
    p = F.col("punkte")
    d = _poly(t).withColumn("f", G.polygon_area(p)).withColumn("u", G.polyline_length(p, True))
    d = d.withColumn("bw", G.extent(p, 0)).withColumn("bh", G.extent(p, 1))
    f0 = F.lit(0.5)
    poly = F.col("u") * F.sqrt(f0 / F.col("f"))
    box = 2.0 * (F.sqrt(f0 * F.col("bw") / F.col("bh")) + F.sqrt(f0 * F.col("bh") / F.col("bw")))
    fill = F.col("f") / (F.col("bw") * F.col("bh"))
    return d.select("vec_id", F.round(F.when(fill < 0.72, poly).otherwise(F.sqrt(poly * box)), 6).alias("umfang"))


@query("room_verification", "G10", """
, x AS (SELECT room_id, flaeche_m2 AS f, umfang_m AS u, flaeche_m2*(1+(plan_id % 20 - 10)*0.01) AS fi, umfang_m*(1+(plan_id % 30 - 12)*0.01) AS ui FROM rooms)
 SELECT room_id, CASE WHEN f IS NULL OR f <= 0 OR fi IS NULL THEN 'offen' WHEN abs(fi-f)/f > 0.06 THEN 'f_daneben'
  WHEN u > 0 AND abs(ui-u)/u <= 0.10 THEN 'verifiziert' WHEN u > 0 THEN 'u_daneben'
  WHEN coalesce(ui,0) <= 1.8*4*sqrt(f) THEN 'verifiziert' ELSE 'u_daneben' END AS urteil FROM x""", "rooms")
def room_verification(t: Tables):
    r = t.rooms.selectExpr("room_id", "flaeche_m2 f", "umfang_m u", "flaeche_m2*(1+(plan_id % 20 - 10)*0.01) fi", "umfang_m*(1+(plan_id % 30 - 12)*0.01) ui")
    return verdict(r).select("room_id", "urteil")


def verdict(r):
    """Verdict on a measured outline: ``f, u`` read, ``fi, ui`` measured."""
    f, u, fi, ui = (F.col(c) for c in ("f", "u", "fi", "ui"))
    return r.withColumn(
        "urteil",
        F.when(f.isNull() | (f <= 0) | fi.isNull(), F.lit("offen"))
        .when(F.abs(fi - f) / f > 0.06, F.lit("f_daneben"))
        .when((u > 0) & (F.abs(ui - u) / F.when(u > 0, u) <= 0.10), F.lit("verifiziert"))
        .when(u > 0, F.lit("u_daneben"))
        .when(F.coalesce(ui, F.lit(0.0)) <= 1.8 * G.square_perimeter(f), F.lit("verifiziert"))
        .otherwise(F.lit("u_daneben")))


@query("rectangle_sides", "F14 F15 F16", """
, x AS (SELECT room_id, flaeche_m2 AS f, umfang_m AS u FROM rooms)
 SELECT room_id, round(CASE WHEN f > 0 AND u > 0 AND u*u/4-4*f >= 0 THEN (u/2 + sqrt((u/2)*(u/2) - 4.0*f))/2 END, 5) AS a,
  round(CASE WHEN f > 0 AND u > 0 AND u*u/4-4*f >= 0 THEN (u/2 - sqrt((u/2)*(u/2) - 4.0*f))/2 END, 5) AS b,
  round(2*(sqrt(f*1.35)+sqrt(f/1.35)), 5) AS iso, round(4*sqrt(f), 5) AS quadrat,
  CASE WHEN coalesce(u < 0.98*4*sqrt(f) OR u > 5*f+2, false) THEN NULL ELSE u END AS u_plausibel FROM x""", "rooms")
def rectangle_sides(t: Tables):
    f, u = F.col("flaeche_m2"), F.col("umfang_m")
    r = G.rectangle_from_area(f, u)
    return t.rooms.select("room_id", F.round(r["a"], 5).alias("a"), F.round(r["b"], 5).alias("b"), F.round(G.iso_perimeter(f), 5).alias("iso"),
                          F.round(G.square_perimeter(f), 5).alias("quadrat"), G.plausible_perimeter(f, u).alias("u_plausibel"))
