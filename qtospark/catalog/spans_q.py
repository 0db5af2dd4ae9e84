"""Queries over spans and segments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators.matching import greedy_nearest
from ..operators.ordering import order_stats
from ..plans import spans as S
from ..sources import adapters
from . import Tables, query
from .trades_q import KAT

KATT = KAT.replace("name IN", "text IN").replace("WHEN name", "WHEN text")
G = "TRY_CAST(replace({0}, ',', '.') AS DOUBLE)"
CLS = f"""
, c0 AS (SELECT *, x0 AS cx, y0 AS cy, trim(text) AS t FROM spans)
, cls AS (SELECT *, CASE WHEN regexp_matches(t, '^F\\s*[:=]?\\s*\\d+[.,]\\d+\\s*m?[²2]?\\s*$') THEN 'flaeche' WHEN regexp_matches(t, '^U\\s*[:=]?\\s*\\d+[.,]\\d+\\s*(m|cm)?\\s*$') THEN 'umfang'
   WHEN regexp_matches(t, '^R?H\\s*[:=]?\\s*\\d+[.,]?\\d*\\s*m?\\s*$') THEN 'hoehe' WHEN starts_with(t, 'FPH') THEN 'parapet' WHEN starts_with(t, 'STUK') THEN 'sturz' WHEN regexp_matches(t, '^AW\\d?$') THEN 'wand' WHEN starts_with(t, 'TOP') THEN 'wohnung'
   WHEN regexp_matches(t, '^[+-]\\d') THEN 'kote' WHEN regexp_matches(t, '^\\d{{1,4}}$') AND CAST(t AS DOUBLE) BETWEEN 5 AND 1500 OR regexp_matches(t, '^\\d,\\d\\d$') AND {G.format('t')} BETWEEN 0.3 AND 15 THEN 'mass'
   WHEN {KATT} IS NOT NULL AND t <> 'Terasse' THEN 'raum' ELSE 'sonst' END AS klasse FROM c0)
, cv AS MATERIALIZED (SELECT *, CASE WHEN klasse IN ('hoehe','parapet','sturz') AND regexp_matches(t, '^[A-Z]+ *[:=]? *\\d\\d+ *m?$') THEN CAST(regexp_extract(t, '(\\d+)', 1) AS DOUBLE) / 100 WHEN klasse IN ('flaeche','umfang','hoehe','parapet','sturz') THEN {G.format("regexp_extract(t, '(\\d+[.,]?\\d*)', 1)")} WHEN klasse = 'kote' THEN {G.format('t')}
   WHEN klasse = 'mass' THEN CASE WHEN contains(t, ',') THEN {G.format('t')} WHEN length(t) IN (2,3) THEN CAST(t AS DOUBLE)/100 END END AS wert FROM cls)
"""


def cls(t: Tables):
    return S.classify(S.ingest(t.spans))


def picked(t: Tables, *kinds: str, more: tuple[str, ...] = ()):
    """Spans of these classes, classified once and written narrow: queries read them several times."""
    return S.cut(cls(t).filter(F.col("klasse").isin(*kinds)).select("span_id", *S.PAGE, "cx", "cy", "klasse", "wert", *more))


@query("span_classes", "P8 S4 P9", CLS + "SELECT span_id, klasse, wert FROM cv", "spans")
def span_classes(t: Tables):
    return cls(t).select("span_id", "klasse", "wert")


@query("extractor_merge", "S5", """
, a AS (SELECT * FROM spans WHERE art IN ('name','mass')), b AS (SELECT span_id || 'x' AS span_id, plan_id, seite, art, regexp_replace(text, '\\s*[:=]\\s*', ' ', 'g') AS text, x0 + (ord % 9) AS x0, y0, size, ord FROM spans WHERE art IN ('name','umfang'))
 SELECT span_id, text FROM a UNION ALL SELECT span_id, text FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.plan_id = b.plan_id AND a.seite = b.seite AND contains(a.text, b.text) AND abs(a.x0 - b.x0) < 5)""", "spans")
def extractor_merge(t: Tables):
    s = t.spans
    b = s.filter("art in ('name','umfang')").withColumn("span_id", F.concat("span_id", F.lit("x"))).withColumn("text", F.regexp_replace("text", r"\s*[:=]\s*", " ")).withColumn("x0", F.col("x0") + F.col("ord") % 9)
    return S.merge_extractors(s.filter("art in ('name','mass')"), b).select("span_id", "text")


@query("room_labels", "P9 W12", CLS + """
, n AS (SELECT * FROM c0 WHERE """ + KATT + """ IS NOT NULL AND text <> 'Terasse')
, m AS (SELECT plan_id, seite, round(size,1) AS s FROM n GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY plan_id, seite ORDER BY count(*) DESC, min(ord), round(size,1)) = 1)
 SELECT span_id, text FROM n JOIN m USING (plan_id, seite) WHERE size >= greatest(4.0, s*0.75)""", "spans")
def room_labels(t: Tables):
    return S.room_labels(S.ingest(t.spans)).select("span_id", "text")


LAB = CLS + ", lab AS (SELECT * FROM cv WHERE klasse = 'raum')"


@query("label_values", "J7", LAB + """
, j AS (SELECT l.span_id, v.klasse, v.wert, v.cy-l.cy AS dy, v.cx-l.cx AS dx FROM lab l JOIN cv v USING (plan_id, seite) WHERE v.klasse IN ('flaeche','umfang','hoehe') AND abs(v.cx-l.cx) <= 60 AND v.cy-l.cy BETWEEN -5 AND 60)
 SELECT span_id, arg_min(wert, (dy, dx, wert)) FILTER (WHERE klasse='flaeche') AS flaeche, arg_min(wert, (dy, dx, wert)) FILTER (WHERE klasse='umfang') AS umfang, arg_min(wert, (dy, dx, wert)) FILTER (WHERE klasse='hoehe') AS hoehe FROM j GROUP BY 1""", "spans")
def label_values(t: Tables):
    c = S.cut(cls(t).select("span_id", *S.PAGE, "cx", "cy", "klasse", "wert"))
    return S.label_values(c.filter("klasse = 'raum'"), c)


@query("value_beside", "J8", LAB + """
 SELECT l.span_id, arg_min(v.span_id, (v.cx-l.cx, v.span_id)) AS wert_id FROM lab l JOIN cv v USING (plan_id, seite) WHERE v.klasse='mass' AND abs(v.cy-l.cy) <= 6 AND v.cx-l.cx > 0 AND v.cx-l.cx <= 90 GROUP BY 1""", "spans")
def value_beside(t: Tables):
    c = picked(t, "raum", "mass")
    return S.value_beside(c.filter("klasse = 'raum'"), c.filter("klasse = 'mass'"))


@query("value_above", "J8", LAB + """
 SELECT l.span_id, arg_min(v.span_id, (l.cy-v.cy, v.span_id)) AS wert_id FROM lab l JOIN cv v USING (plan_id, seite) WHERE v.klasse='mass' AND abs(v.cx-l.cx) <= 6 AND l.cy-v.cy > 0 AND l.cy-v.cy <= 60 GROUP BY 1""", "spans")
def value_above(t: Tables):
    c = picked(t, "raum", "mass")
    return S.value_above(c.filter("klasse = 'raum'"), c.filter("klasse = 'mass'"))


@query("flat_assignment", "J6", LAB + """
, tops AS (SELECT * FROM cv WHERE klasse = 'wohnung'), k AS (SELECT plan_id, seite, count(*) AS k FROM tops GROUP BY 1, 2)
, n AS (SELECT l.span_id, t.text, sqrt((l.cx-t.cx)*(l.cx-t.cx)+(l.cy-t.cy)*(l.cy-t.cy)) AS d FROM lab l JOIN tops t USING (plan_id, seite) QUALIFY row_number() OVER (PARTITION BY l.span_id ORDER BY d, t.span_id) = 1)
 SELECT l.span_id, CASE WHEN k IS NULL THEN 'Haus' WHEN k <= 1 OR d < 500 THEN n.text END AS wohnung FROM lab l LEFT JOIN k USING (plan_id, seite) LEFT JOIN n USING (span_id)""", "spans")
def flat_assignment(t: Tables):
    c = picked(t, "raum", "wohnung", more=("text",))
    return S.assign_flats(c.filter("klasse = 'raum'"), c.filter("klasse = 'wohnung'"))


@query("greedy_claim_fill", "J9")
def greedy_claim_fill(t: Tables):
    c = picked(t, "raum", "mass")
    rooms = c.filter("klasse = 'raum'")
    claims = c.filter("klasse = 'mass'").withColumnRenamed("span_id", "claim_id")
    return greedy_nearest(rooms, claims, S.PAGE, "span_id", "claim_id", 150.0)


OPN = CLS + """
, pr AS (SELECT * FROM cv WHERE klasse='parapet'), st AS (SELECT * FROM cv WHERE klasse='sturz')
, a AS (SELECT p.span_id, p.plan_id, p.seite, p.cx, p.cy, p.wert AS fph_m, s.wert AS stuk_m, sqrt((p.cx-s.cx)*(p.cx-s.cx)+(p.cy-s.cy)*(p.cy-s.cy)) AS d, s.span_id AS sid FROM pr p JOIN st s USING (plan_id, seite) WHERE sqrt((p.cx-s.cx)*(p.cx-s.cx)+(p.cy-s.cy)*(p.cy-s.cy)) < 52.5
   QUALIFY row_number() OVER (PARTITION BY p.span_id ORDER BY d, sid) = 1)
, o AS (SELECT *, stuk_m - fph_m AS h FROM a WHERE stuk_m - fph_m > 0 AND stuk_m - fph_m <= 3.5)
, w AS (SELECT o.span_id, m.wert AS bw, sqrt((o.cx-m.cx)*(o.cx-m.cx)+(o.cy-m.cy)*(o.cy-m.cy)) AS d, o.h, o.fph_m, m.span_id AS wid FROM o JOIN cv m USING (plan_id, seite) WHERE m.klasse='mass' AND m.wert BETWEEN 0.5 AND 3.5)
, sc AS (SELECT *, 100.0 - d - CASE WHEN d > 35 THEN 30 ELSE 0 END - CASE WHEN bw/h < 0.25 OR bw/h > 4 THEN 60 ELSE 0 END
   + CASE WHEN fph_m < 0.15 THEN CASE WHEN abs(round(bw*100)-60) <= 2 OR abs(round(bw*100)-70) <= 2 OR abs(round(bw*100)-80) <= 2 OR abs(round(bw*100)-90) <= 2 OR abs(round(bw*100)-100) <= 2 THEN 35 WHEN bw BETWEEN 0.6 AND 1.5 THEN 5 WHEN bw > 1.5 THEN -10 ELSE 0 END ELSE 0 END
   + CASE WHEN h BETWEEN 0.4 AND 0.8 THEN CASE WHEN abs(bw-h) < 0.3 THEN 25 WHEN bw > 2*h THEN -20 ELSE 0 END ELSE 0 END AS score FROM w WHERE d < 70)
, b AS (SELECT span_id, arg_min(bw, (-round(score,6), d, wid)) AS breite_m FROM sc GROUP BY 1)
, wt AS (SELECT o.span_id, upper(substr(x.text,1,2)) AS wand_typ FROM o JOIN cv x USING (plan_id, seite) WHERE x.klasse='wand' AND sqrt((o.cx-x.cx)*(o.cx-x.cx)+(o.cy-x.cy)*(o.cy-x.cy)) < 35 QUALIFY row_number() OVER (PARTITION BY o.span_id ORDER BY sqrt((o.cx-x.cx)*(o.cx-x.cx)+(o.cy-x.cy)*(o.cy-x.cy)), x.span_id) = 1)
"""


@query("opening_assembly", "J11 P4", OPN + "SELECT o.span_id, CASE WHEN fph_m < 0.15 THEN 'tuer' ELSE 'fenster' END AS typ, breite_m, round(h, 4) AS hoehe_m, fph_m, stuk_m, wand_typ FROM o LEFT JOIN b USING (span_id) LEFT JOIN wt USING (span_id)", "spans")
def opening_assembly(t: Tables):
    return S.assemble_openings(cls(t)).select("span_id", "typ", "breite_m", "hoehe_m", "fph_m", "stuk_m", "wand_typ")


@query("lintel_only_doors", "J12", CLS + """SELECT span_id, wert FROM cv s WHERE klasse='sturz' AND wert BETWEEN 1.7 AND 3.2 AND NOT EXISTS (SELECT 1 FROM cv p WHERE p.klasse='parapet' AND p.plan_id = s.plan_id AND p.seite = s.seite
  AND sqrt((s.cx-p.cx)*(s.cx-p.cx)+(s.cy-p.cy)*(s.cy-p.cy)) < 52.5)""", "spans")
def lintel_only_doors(t: Tables):
    return S.lintel_only(picked(t, "sturz", "parapet")).select("span_id", "wert")


@query("object_counts", "A40")
def object_counts(t: Tables):
    return S.count_objects(S.ingest(t.spans), "terrasse|loggia", 120.0)


@query("text_evidence", "P17", """
, r AS (SELECT room_id, projekt_id, lower(trim(name)) AS n, flaeche_m2 AS f FROM rooms)
, k AS (SELECT room_id, projekt_id, n AS k FROM r WHERE length(n) >= 4 UNION SELECT room_id, projekt_id, w FROM (SELECT room_id, projekt_id, unnest(string_split_regex(n, '[\\s/+\\-]+')) AS w FROM r) WHERE length(w) >= 5
  UNION SELECT room_id, projekt_id, replace(format('{:.2f}', f), '.', ',') FROM r WHERE f > 0.5 AND round(f - trunc(f), 2) <> 0)
, s AS (SELECT DISTINCT plan_id, lower(trim(text)) AS k FROM spans UNION SELECT DISTINCT plan_id, unnest(string_split_regex(lower(text), '[\\s/+\\-]+')) FROM spans)
 SELECT DISTINCT room_id FROM k JOIN s ON s.plan_id = k.projekt_id AND s.k = k.k""", "rooms spans")
def text_evidence(t: Tables):
    return S.text_evidence(t.rooms.withColumn("plan_key", F.col("projekt_id")), t.spans)


@query("verified_near_label", "J23", LAB + """
, v AS (SELECT * FROM cv WHERE klasse = 'flaeche')
, x AS (SELECT l.span_id, l.plan_id, l.seite, l.cx, l.cy, 5.0 + l.ord % 30 AS f FROM lab l)
 SELECT span_id FROM x WHERE EXISTS (SELECT 1 FROM v WHERE v.plan_id = x.plan_id AND v.seite = x.seite AND abs(v.cx-x.cx) <= 300 AND abs(v.cy-x.cy) <= 300 AND abs(v.wert-f) <= 0.02*f)""", "spans")
def verified_near_label(t: Tables):
    from ..operators.spatial import box_join

    c = picked(t, "raum", "flaeche", more=("ord",))
    lab = c.filter("klasse = 'raum'").withColumn("f", F.lit(5.0) + F.col("ord") % 30)
    v = c.filter("klasse = 'flaeche'").select(*S.PAGE, "cx", "cy", "wert").distinct()
    return box_join(lab, v, S.PAGE, 300.0, how="left_semi", condition=F.abs(F.col("r_wert") - F.col("f")) <= 0.02 * F.col("f")).select("span_id")


DIM = """
, dall AS (SELECT span_id, plan_id, seite, x0 AS x, y0 AS y, trim(text) AS t FROM spans WHERE regexp_full_match(trim(text), '\\d{1,4}(,\\d)?|\\d{1,2}[.,]\\d{1,2}'))
, dnum AS (SELECT *, CAST(replace(t, ',', '.') AS DOUBLE) AS v, regexp_full_match(t, '\\d{1,4}(,\\d)?') AS c, regexp_full_match(t, '\\d{1,2}[.,]\\d{1,2}') AS m FROM dall)
, dcm AS (SELECT span_id, plan_id, seite, x, y, v AS cm FROM dnum WHERE c AND v BETWEEN 5 AND 1500)
, dch AS (SELECT plan_id FROM (SELECT plan_id, seite, 'h' AS achse, round_even(y/6.0,0) AS lage, cm FROM dcm UNION ALL SELECT plan_id, seite, 'v', round_even(x/6.0,0), cm FROM dcm) GROUP BY plan_id, seite, achse, lage HAVING count(*) >= 2 AND sum(cm) BETWEEN 300 AND 6000)
, dim AS (SELECT * FROM dcm UNION ALL SELECT span_id, plan_id, seite, x, y, v*100.0::DOUBLE FROM dnum WHERE m AND v BETWEEN 0.3 AND 15 AND plan_id NOT IN (SELECT plan_id FROM dch))
"""


def dims(t: Tables):
    return S.dimensions(t.spans)


CHAIN = DIM + """
, ch AS (SELECT plan_id, seite, achse, lage, count(*) AS n, sum(cm) AS summe FROM (SELECT plan_id, seite, 'h' AS achse, round_even(y/6.0,0)*6.0 AS lage, cm FROM dim UNION ALL SELECT plan_id, seite, 'v', round_even(x/6.0,0)*6.0, cm FROM dim) GROUP BY ALL HAVING count(*) >= 2 AND sum(cm) BETWEEN 300 AND 6000)
"""


@query("chain_sums", "A24 F23 U1", CHAIN + "SELECT plan_id, seite, achse, lage, n, round(summe, 4) AS summe FROM ch", "spans")
def chain_sums(t: Tables):
    return S.chain_sums(dims(t)).withColumn("summe", F.round("summe", 4))


@query("hull_from_chains", "A25", CHAIN + """
, tt AS (SELECT plan_id, achse, round(summe,1) AS t, count(*) AS rep FROM ch GROUP BY 1,2,3)
, j AS (SELECT h.plan_id, h.t AS h, v.t AS v, h.rep AS hn, v.rep AS vn, 20.0 + h.plan_id % 100 AS f FROM tt h JOIN tt v ON h.plan_id = v.plan_id AND h.achse='h' AND v.achse='v')
, s AS (SELECT *, round(abs(h*v - f*1.07*10000)/(f*1.07*10000) - 0.15*(hn+vn), 9) AS score FROM j WHERE h*v BETWEEN f*0.95*10000 AND f*1.7*10000)
, b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY score, h, v, hn, vn) = 1)
 SELECT plan_id, h/100 AS breite_m, v/100 AS tiefe_m, 2*(h+v)/100 AS umfang_m, hn AS h_rep, vn AS v_rep FROM b WHERE h BETWEEN 400 AND 6000 AND v BETWEEN 400 AND 6000""", "spans")
def hull_from_chains(t: Tables):
    d = dims(t)
    fp = d.select("plan_id").distinct().select("plan_id", (F.lit(20.0) + F.col("plan_id") % 100).cast("double").alias("footprint_m2"))
    return S.hull_from_chains(S.chain_sums(d), fp)


SCALE = DIM + """
, d AS (SELECT *, round_even(y/6.0,0)*6.0 AS lage FROM dim), c AS (SELECT *, sum(cm) OVER (PARTITION BY plan_id, seite, lage ORDER BY x, span_id ROWS UNBOUNDED PRECEDING) - cm/2 AS mid FROM d)
, g AS (SELECT plan_id, seite, lage, count(*) AS n, regr_slope(x, mid) AS steigung, regr_r2(x, mid) AS r2 FROM c GROUP BY 1,2,3 HAVING count(*) >= 3)
"""


@query("chain_scales", "A26 W1", SCALE + "SELECT plan_id, seite, lage, n, round(steigung, 6) AS steigung, round(r2, 5) AS r2 FROM g", "spans")
def chain_scales(t: Tables):
    return S.chain_scales(dims(t)).withColumn("steigung", F.round("steigung", 6)).withColumn("r2", F.round("r2", 5))


LN = math.log(1.05)


@query("dominant_scale", "A27", SCALE + f"""
, s AS (SELECT plan_id, steigung, ln(steigung) AS l FROM g WHERE steigung > 0)
, k AS (SELECT a.plan_id, a.l, count(*) AS k FROM s a JOIN s b ON a.plan_id = b.plan_id AND abs(a.l-b.l) <= {LN!r} GROUP BY a.plan_id, a.l, a.steigung)
, t AS (SELECT plan_id, l AS tl FROM k QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY k DESC, l) = 1)
, m AS (SELECT plan_id, list_sort(list(round(steigung, 6))) AS x FROM s JOIN t USING (plan_id) WHERE abs(l-tl) <= {LN!r} GROUP BY 1)
 SELECT plan_id, x[(len(x)-1)//2+1] AS ptcm, len(x) AS n FROM m""", "spans")
def dominant_scale(t: Tables):
    return S.dominant_scale(S.chain_scales(dims(t))).select("plan_id", F.round("ptcm", 6).alias("ptcm"), "n")


@query("split_chains", "W2", DIM + """
, d AS (SELECT *, round_even(y/6.0,0)*6.0 AS lage FROM dim), l AS (SELECT *, (lag(cm) OVER w + cm)/2*0.2835 AS e, x - lag(x) OVER w AS gap FROM d WINDOW w AS (PARTITION BY plan_id, seite, lage ORDER BY x, span_id))
, b AS (SELECT *, sum(CASE WHEN gap IS NULL OR abs(gap-e) > 0.3*e + 20*0.2835 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, seite, lage ORDER BY x, span_id) AS teil FROM l)
 SELECT plan_id, seite, lage, teil::BIGINT AS teil, count(*) AS n, round(sum(cm), 4) AS summe, min(x) AS x0 FROM b GROUP BY 1,2,3,4 HAVING count(*) >= 2""", "spans")
def split_chains(t: Tables):
    return S.split_chains(dims(t), 28.35).withColumn("summe", F.round("summe", 4))


FACES = """
, sg AS (SELECT plan_id, seite, achse, pos, lo, max(hi) AS hi FROM segments GROUP BY ALL)
, nw AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY plan_id, seite, achse, pos ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5 THEN 0 ELSE 1 END AS n FROM sg)
, il AS (SELECT *, sum(n) OVER (PARTITION BY plan_id, seite, achse, pos ORDER BY lo) AS i FROM nw)
, fc AS (SELECT plan_id, seite, achse, pos, min(lo) AS lo, max(hi) AS hi FROM il GROUP BY plan_id, seite, achse, pos, i)
"""


@query("wall_faces", "W3", FACES + "SELECT * FROM fc", "segments")
def wall_faces(t: Tables):
    return S.wall_faces(t.segments)


PAIRS = FACES + """
, wp AS (SELECT a.plan_id, a.seite, a.achse, a.pos, b.pos AS pos2, greatest(a.lo,b.lo) AS lo, least(a.hi,b.hi) AS hi, b.pos-a.pos AS dicke, least(a.hi,b.hi)-greatest(a.lo,b.lo) AS laenge FROM fc a JOIN fc b ON a.plan_id=b.plan_id AND a.seite=b.seite AND a.achse=b.achse AND b.pos-a.pos BETWEEN 4 AND 16
   AND least(a.hi,b.hi)-greatest(a.lo,b.lo) >= 0.7*least(a.hi-a.lo, b.hi-b.lo))
"""


@query("wall_pairs", "J35", PAIRS + "SELECT * FROM wp", "segments")
def wall_pairs(t: Tables):
    return S.wall_pairs(S.wall_faces(t.segments), 4.0, 16.0)


@query("layer_profile", "A31", """SELECT plan_id, grau, breite, count(*) AS n, round(avg(CASE WHEN achse='h' THEN 1.0 ELSE 0 END), 6) AS anteil_h, max(hi-lo) AS max_len, round(sum(hi-lo), 4) AS sum_len FROM segments GROUP BY 1,2,3""", "segments")
def layer_profile(t: Tables):
    return S.layer_profile(t.segments).withColumn("anteil_h", F.round("anteil_h", 6)).withColumn("sum_len", F.round("sum_len", 4))


NW = FACES + """
, w AS (SELECT *, plan_id || ':' || achse || ':' || pos || ':' || lo AS wand_id FROM fc)
, op AS (SELECT opening_id, projekt_id AS plan_id, cx*0.3 AS cx, cy*0.3 AS cy, coalesce(breite_m,0)*coalesce(hoehe_m,0) AS flaeche FROM openings WHERE cx IS NOT NULL)
, j AS (SELECT o.opening_id, w.wand_id, flaeche, greatest(lo, least(hi, CASE WHEN achse='h' THEN cx ELSE cy END)) AS fuss, CASE WHEN achse='h' THEN cx ELSE cy END AS al, CASE WHEN achse='h' THEN cy ELSE cx END AS ac, pos FROM op o JOIN w USING (plan_id))
, d AS (SELECT *, sqrt((al-fuss)*(al-fuss)+(ac-pos)*(ac-pos)) AS dist FROM j), nb AS (SELECT * FROM d WHERE dist <= 25 QUALIFY row_number() OVER (PARTITION BY opening_id ORDER BY dist, wand_id) = 1)
"""


def _walls(t: Tables):
    # dealt out by plan at once: the steps of wall_faces and a join by page shuffle no more
    f = S.wall_faces(t.segments.select(*S.SEG, "lo", "hi").repartition("plan_id"))
    return f.withColumn("wand_id", F.concat_ws(":", F.col("plan_id").cast("string"), "achse", F.col("pos").cast("string"), F.col("lo").cast("string")))


def _wall_openings(t: Tables):
    return t.openings.filter("cx is not null").select(
        "opening_id", F.col("projekt_id").alias("plan_id"), (F.col("cx") * 0.3).alias("cx"), (F.col("cy") * 0.3).alias("cy"),
        (F.coalesce("breite_m", F.lit(0.0)) * F.coalesce("hoehe_m", F.lit(0.0))).alias("flaeche"))


@query("opening_walls", "J25 J42", NW + "SELECT opening_id, wand_id, round(dist, 6) AS dist, round(fuss, 6) AS fuss FROM nb", "segments openings")
def opening_walls(t: Tables):
    n = S.nearest_wall(_wall_openings(t), S.cut(_walls(t)), 25.0)
    return n.withColumn("dist", F.round("dist", 6)).withColumn("fuss", F.round("fuss", 6))


@query("wall_net_areas", "G11", NW + """, b AS (SELECT wand_id, sum(flaeche) AS o FROM nb WHERE flaeche > 4 GROUP BY 1)
 SELECT wand_id, round((hi-lo)*0.05*2.7, 6) AS brutto, round((hi-lo)*0.05*2.7 - least((hi-lo)*0.05*2.7, coalesce(o,0)), 6) AS netto FROM w LEFT JOIN b USING (wand_id)""", "segments openings")
def wall_net_areas(t: Tables):
    w = S.cut(_walls(t))
    m = S.nearest_wall(_wall_openings(t), w, 25.0, ("flaeche",))
    return S.wall_net(w.withColumn("laenge_m", (F.col("hi") - F.col("lo")) * 0.05), m, 2.7).select("wand_id", F.round("brutto", 6).alias("brutto"), F.round("netto", 6).alias("netto"))


@query("trimmed_box", "A55", """
, s AS (SELECT plan_id, list_sort(list(lo)) AS x, list_sort(list(pos)) AS y FROM segments GROUP BY 1)
 SELECT plan_id, x[CAST(floor(0.02*(len(x)-1)) AS INT)+1] AS x0, x[CAST(floor(0.98*(len(x)-1)) AS INT)+1] AS x1, y[CAST(floor(0.02*(len(y)-1)) AS INT)+1] AS y0, y[CAST(floor(0.98*(len(y)-1)) AS INT)+1] AS y1 FROM s""", "segments")
def trimmed_box(t: Tables):
    x = order_stats(t.segments, ["plan_id"], "lo", {"x0": "p2", "x1": "p98"})
    return x.join(order_stats(t.segments, ["plan_id"], "pos", {"y0": "p2", "y1": "p98"}), "plan_id")


@query("level_heights", "A29 W6", CLS + """
, k AS (SELECT plan_id, round(wert,2) AS v, count(*) AS n FROM cv WHERE klasse='kote' GROUP BY 1, 2 HAVING count(*) >= 2), l AS (SELECT *, round(lead(v) OVER (PARTITION BY plan_id ORDER BY v) - v, 2) AS g FROM k)
 SELECT plan_id, v, n, CASE WHEN g BETWEEN 2.2 AND 4.5 THEN g END AS gh FROM l""", "spans")
def level_heights(t: Tables):
    return S.levels(cls(t))


@query("level_check", "A30", CLS + """
, k AS (SELECT plan_id, round(wert,2) AS v FROM cv WHERE klasse='kote' GROUP BY 1, 2 HAVING count(*) >= 2), l AS (SELECT *, round(lead(v) OVER (PARTITION BY plan_id ORDER BY v) - v, 2) AS gh FROM k)
, m AS (SELECT projekt_id AS plan_id, round(hoehe_m,2) AS licht FROM rooms WHERE hoehe_m BETWEEN 2 AND 5 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY projekt_id ORDER BY count(*) DESC, round(hoehe_m,2)) = 1)
, a AS (SELECT plan_id, round(gh-licht,2) AS aufbau, gh, licht FROM l JOIN m USING (plan_id) WHERE gh BETWEEN 2.2 AND 4.5)
 SELECT plan_id, aufbau, gh, licht FROM a WHERE aufbau BETWEEN 0.15 AND 0.8 QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY aufbau, gh, licht) = 1""", "spans rooms")
def level_check(t: Tables):
    return S.check_levels(S.levels(cls(t)), t.rooms.select(F.col("projekt_id").alias("plan_id"), "hoehe_m"))


@query("elevation_spread", "P15", CLS + """
, k AS (SELECT DISTINCT plan_id, seite, cx FROM cv WHERE klasse='kote'), n AS (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY plan_id, seite ORDER BY cx) > 12 THEN 1 ELSE 0 END AS b FROM k)
 SELECT plan_id, seite, (max(cx)-min(cx) >= 200 AND sum(b)+1 >= 4) AS verteilt, (sum(b)+1)::BIGINT AS spalten FROM n GROUP BY 1, 2""", "spans")
def elevation_spread(t: Tables):
    return S.elevation_spread(cls(t), 800.0)


@query("arc_circles", "A33", """WITH p AS (SELECT vec_id, unnest(range(0, len(embedding)//2)) AS i, embedding AS e FROM embeddings), q AS (SELECT vec_id, e[2*i+1]::DOUBLE AS x, e[2*i+2]::DOUBLE AS y FROM p)
, m AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, avg(x*x) AS xx, avg(y*y) AS yy, avg(x*y) AS xy, avg(x*x*x) AS xxx, avg(y*y*y) AS yyy, avg(x*x*y) AS xxy, avg(x*y*y) AS xyy FROM q GROUP BY 1)
, z AS (SELECT *, xx-mx*mx AS a, xy-mx*my AS b, yy-my*my AS d, xxx+xyy-mx*(xx+yy) AS zx, xxy+yyy-my*(xx+yy) AS zy FROM m)
, u AS (SELECT *, (zx*d-zy*b)/(2*(a*d-b*b)) AS ux, (zy*a-zx*b)/(2*(a*d-b*b)) AS uy FROM z)
 SELECT vec_id, round(ux, 7) AS mx, round(uy, 7) AS my, round(sqrt(xx+yy-2*ux*mx-2*uy*my+ux*ux+uy*uy), 7) AS radius FROM u""")
def arc_circles(t: Tables):
    e = F.col("embedding")
    pts = t.embeddings.select("vec_id", F.inline(F.transform(F.sequence(F.lit(0), (F.size(e) / 2).cast("int") - 1), lambda i: F.struct(F.get(e, 2 * i).cast("double").alias("x"), F.get(e, 2 * i + 1).cast("double").alias("y")))))
    return S.circle_fit(pts, "vec_id").select("vec_id", F.round("mx", 7).alias("mx"), F.round("my", 7).alias("my"), F.round("radius", 7).alias("radius"))


@query("wall_code_counts", "A41 A38", CLS + """
, c AS (SELECT plan_id, text AS code, count(*) AS n FROM cv WHERE klasse='wand' GROUP BY 1, 2)
, l AS (SELECT 'AW' || i AS code, 12.0 + i*6 AS dicke, CASE WHEN i < 5 THEN 'aussen' ELSE 'innen' END AS seite FROM range(0, 7) r(i))
 SELECT plan_id, c.code, n, seite, CASE WHEN seite IS NULL THEN NULL ELSE round(n*100.0/sum(n) OVER (PARTITION BY plan_id, seite), 6) END AS pct FROM c LEFT JOIN l USING (code)""", "spans")
def wall_code_counts(t: Tables):
    c = cls(t).filter("klasse = 'wand'").groupBy("plan_id", F.col("text").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    i = F.regexp_extract("code", r"(?i)^(?:AW|IW)\s*(\d+)$", 1).try_cast("int")
    side = F.when(i < 5, F.lit("aussen")).when(i < 7, F.lit("innen"))
    c = c.withColumn("seite", side)
    tot = c.filter("seite is not null").groupBy("plan_id", "seite").agg(F.sum("n").alias("_t"))
    return c.join(tot, ["plan_id", "seite"], "left").select("plan_id", "code", "n", "seite", F.round(F.col("n") * 100.0 / F.col("_t"), 6).alias("pct"))


@query("house_split", "W5 C28", """
, d AS (SELECT DISTINCT projekt_id, cx FROM rooms), g AS (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY projekt_id ORDER BY cx) > 100 THEN 1 ELSE 0 END AS b FROM d)
, h AS (SELECT projekt_id, cx, CAST(1 + sum(b) OVER (PARTITION BY projekt_id ORDER BY cx) AS BIGINT) AS haus FROM g)
 SELECT projekt_id, haus, count(*) AS n, round(sum(flaeche_m2), 4) AS flaeche FROM rooms JOIN h USING (projekt_id, cx) GROUP BY 1, 2""", "rooms")
def house_split(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("projekt_id").orderBy("cx")
    d = t.rooms.select("projekt_id", "cx").distinct()
    d = d.withColumn("_b", F.when(F.col("cx") - F.lag("cx").over(w) > 100, 1).otherwise(0)).withColumn("haus", F.lit(1) + F.sum("_b").over(w))
    return t.rooms.join(d.drop("_b"), ["projekt_id", "cx"]).groupBy("projekt_id", "haus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flaeche_m2"), 4).alias("flaeche"))


@query("thickness_clusters", "W4", """
, d AS (SELECT plan_id, breite AS d, sum(hi-lo) AS l FROM segments GROUP BY 1, 2), g AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY plan_id ORDER BY d) > 0.13 THEN 1 ELSE 0 END AS b FROM d)
, k AS (SELECT *, sum(b) OVER (PARTITION BY plan_id ORDER BY d) AS c FROM g)
 SELECT plan_id, c::BIGINT AS cluster, round(sum(d*l)/sum(l), 6) AS dicke, round(sum(l), 4) AS laenge FROM k GROUP BY 1, 2""", "segments")
def thickness_clusters(t: Tables):
    from pyspark.sql import Window

    d = t.segments.groupBy("plan_id", F.col("breite").alias("d")).agg(F.sum(F.col("hi") - F.col("lo")).alias("l"))
    w = Window.partitionBy("plan_id").orderBy("d")
    d = d.withColumn("_b", F.when(F.col("d") - F.lag("d").over(w) > 0.13, 1).otherwise(0)).withColumn("cluster", F.sum("_b").over(w))
    return d.groupBy("plan_id", "cluster").agg(F.round(F.sum(F.col("d") * F.col("l")) / F.sum("l"), 6).alias("dicke"), F.round(F.sum("l"), 4).alias("laenge"))


@query("existing_building_flags", "Q15", """
, c AS (SELECT plan_id, sum(CASE WHEN grau >= 0.6 THEN hi-lo ELSE 0 END)/sum(hi-lo) AS anteil FROM segments GROUP BY 1)
, w AS (SELECT plan_id, max(n) AS worte FROM (SELECT plan_id, seite, count(*) FILTER (WHERE text IN ('Keller','Garage')) AS n FROM spans GROUP BY 1, 2) GROUP BY 1)
 SELECT plan_id, round(anteil, 6) AS anteil, worte, (worte >= 2 OR anteil >= 0.5) AS bestand FROM c JOIN w USING (plan_id)""", "segments spans")
def existing_building_flags(t: Tables):
    ln = F.col("hi") - F.col("lo")
    c = t.segments.groupBy("plan_id").agg((F.sum(F.when(F.col("grau") >= 0.6, ln).otherwise(0.0)) / F.sum(ln)).alias("anteil"))
    w = t.spans.groupBy("plan_id", "seite").agg(F.count_if(F.col("text").isin("Keller", "Garage")).alias("n")).groupBy("plan_id").agg(F.max("n").alias("worte"))
    return c.join(w, "plan_id").select("plan_id", F.round("anteil", 6).alias("anteil"), "worte", ((F.col("worte") >= 2) | (F.col("anteil") >= 0.5)).alias("bestand"))


@query("indoor_first_assignment", "J5", """
, o AS (SELECT opening_id, projekt_id, cx, cy FROM openings WHERE cx IS NOT NULL), r AS (SELECT room_id, projekt_id, cx, cy, lower(split_part(trim(name), ' ', 1)) IN ('terrasse','loggia','balkon','parkplatz','carport') AS aussen FROM rooms)
, j AS (SELECT opening_id, room_id, aussen, sqrt((o.cx-r.cx)*(o.cx-r.cx)+(o.cy-r.cy)*(o.cy-r.cy)) AS d FROM o JOIN r USING (projekt_id))
 SELECT opening_id, room_id, round(d, 6) AS dist FROM j WHERE d < 200 QUALIFY row_number() OVER (PARTITION BY opening_id ORDER BY aussen, d, room_id) = 1""", "openings rooms")
def indoor_first_assignment(t: Tables):
    r = t.rooms.select("room_id", "projekt_id", "name", "cx", "cy")
    return S.assign_indoor_first(t.openings.select("opening_id", "projekt_id", "cx", "cy"), r, ["projekt_id"]).withColumn("dist", F.round("dist", 6))


@query("marks_to_levels", "J34", CLS + """
 SELECT m.span_id, arg_min(k.wert, (abs(k.cy-m.cy), k.wert)) AS niveau FROM cv m JOIN cv k USING (plan_id, seite) WHERE m.klasse='wohnung' AND k.klasse='kote' AND abs(k.cy-m.cy) <= 120 GROUP BY 1""", "spans")
def marks_to_levels(t: Tables):
    c = picked(t, "wohnung", "kote")
    return S.marks_to_levels(c.filter("klasse = 'wohnung'"), c.filter("klasse = 'kote'"))


@query("hatch_density", "J36", PAIRS + """
, pt AS (SELECT projekt_id AS plan_id, cx*0.3 AS cx, cy*0.3 AS cy FROM openings WHERE cx IS NOT NULL)
 SELECT w.plan_id, achse, pos, pos2, lo, hi, count(*) AS n, round(count(*)/(hi-lo), 6) AS dichte FROM wp w JOIN pt p ON p.plan_id = w.plan_id AND (CASE WHEN achse='h' THEN cx ELSE cy END) BETWEEN lo AND hi AND (CASE WHEN achse='h' THEN cy ELSE cx END) BETWEEN pos AND pos2 GROUP BY 1,2,3,4,5,6""", "segments openings")
def hatch_density(t: Tables):
    p = S.wall_pairs(S.wall_faces(t.segments), 4.0, 16.0)
    return S.band_density(p, _wall_openings(t)).withColumn("dichte", F.round("dichte", 6))


@query("side_confirmation", "J24", DIM + """
, r AS (SELECT room_id, projekt_id AS plan_id, seite, cx, cy, (umfang_m/2 + sqrt((umfang_m/2)*(umfang_m/2) - 4.0*flaeche_m2))/2 AS a, (umfang_m/2 - sqrt((umfang_m/2)*(umfang_m/2) - 4.0*flaeche_m2))/2 AS b FROM rooms WHERE flaeche_m2 > 0 AND umfang_m > 0 AND (umfang_m/2)*(umfang_m/2) - 4.0*flaeche_m2 >= 0)
, g AS (SELECT room_id, bool_or(abs(a*100-cm) <= 5) AS x, bool_or(abs(b*100-cm) <= 5) AS y FROM r JOIN dim d ON d.plan_id = r.plan_id AND d.seite = r.seite AND abs(d.x-r.cx) <= 150 AND abs(d.y-r.cy) <= 150 GROUP BY 1)
 SELECT room_id, CASE WHEN x AND y THEN 'hoch' WHEN x OR y THEN 'mittel' ELSE 'niedrig' END AS stufe FROM r LEFT JOIN g USING (room_id)""", "spans rooms")
def side_confirmation(t: Tables):
    from ..functions.geometry import rectangle_from_area

    r = t.rooms.select("room_id", F.col("projekt_id").alias("plan_id"), "seite", "cx", "cy", rectangle_from_area(F.col("flaeche_m2"), F.col("umfang_m")).alias("q")).filter("q is not null")
    return S.confirm_sides(r.select("room_id", *S.PAGE, "cx", "cy", "q.a", "q.b"), dims(t))


@query("wall_dimension_snap", "J40", FACES + DIM.replace(", dim AS", ", dim AS") + """
, w AS (SELECT plan_id || ':' || achse || ':' || pos || ':' || lo AS wand_id, plan_id, seite, CASE WHEN achse='h' THEN (lo+hi)/2 ELSE pos END AS cx, CASE WHEN achse='h' THEN pos ELSE (lo+hi)/2 END AS cy, (hi-lo)*3.0 AS m FROM fc)
, b AS (SELECT wand_id, arg_min(cm, (abs(cm-m), cm)) AS d FROM w JOIN dim d ON d.plan_id = w.plan_id AND d.seite = w.seite AND abs(d.x-w.cx) <= 60 AND abs(d.y-w.cy) <= 60 AND abs(cm-m) <= greatest(8.0, 0.04*m) GROUP BY 1)
 SELECT wand_id, coalesce(d, m) AS cm, d IS NOT NULL AS gedruckt FROM w LEFT JOIN b USING (wand_id)""", "spans segments")
def wall_dimension_snap(t: Tables):
    hor = F.col("achse") == "h"
    mid = (F.col("lo") + F.col("hi")) / 2
    w = _walls(t).select("wand_id", *S.PAGE, F.when(hor, mid).otherwise(F.col("pos")).alias("cx"), F.when(hor, F.col("pos")).otherwise(mid).alias("cy"), ((F.col("hi") - F.col("lo")) * 3.0).alias("cm_gemessen"))
    return S.snap_to_dimension(w, dims(t))
