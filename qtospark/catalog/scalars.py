"""Queries of scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from . import Tables, query

GNUM = """TRY_CAST(CASE WHEN contains(z, ',') AND contains(z, '.') THEN replace(replace(z, '.', ''), ',', '.') WHEN contains(z, ',') THEN replace(z, ',', '.')
 WHEN regexp_full_match(z, '-?\\d{1,3}(\\.\\d{3})+') THEN replace(z, '.', '') ELSE nullif(z, '') END AS DOUBLE)"""


@query("german_numbers", "F3", f""", x AS (SELECT span_id, regexp_replace(trim(text), '[^0-9.,\\-]', '', 'g') AS z FROM spans) SELECT span_id, {GNUM} AS zahl FROM x""", "spans")
def german_numbers(t: Tables):
    return t.spans.select("span_id", N.german_number(F.col("text")).alias("zahl"))


@query("unit_inference", "F4", """
, x AS (SELECT line_id, ist_menge * 17.0 AS v FROM quantities)
 SELECT line_id, CASE WHEN v < 4 THEN v WHEN v < 350 THEN v/100 ELSE v/1000 END AS laenge, CASE WHEN v < 30 THEN v WHEN v < 300 THEN v/100 ELSE v/1000 END AS fenster, CASE WHEN v > 10 THEN v/1000 ELSE v END AS mm FROM x""", "quantities")
def unit_inference(t: Tables):
    v = F.col("ist_menge") * 17.0
    return t.quantities.select("line_id", N.length_to_m(v).alias("laenge"), N.window_dim_to_m(v).alias("fenster"), N.mm_if_large(v).alias("mm"))


@query("printed_lengths", "F4", f""", x AS (SELECT span_id, text, regexp_replace(trim(text), '[^0-9.,\\-]', '', 'g') AS z FROM spans), y AS (SELECT span_id, text, {GNUM} AS v FROM x)
 SELECT span_id, CASE WHEN regexp_matches(text, '[.,]\\d') THEN v WHEN v > 5 THEN v/100 ELSE v END AS meter FROM y""", "spans")
def printed_lengths(t: Tables):
    return t.spans.select("span_id", N.text_length_to_m(F.col("text")).alias("meter"))


@query("name_tokens", "F1 F2 U3", """
, x AS (SELECT room_id, name, replace(replace(replace(replace(lower(name),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss') AS z FROM rooms)
 SELECT room_id, lower(regexp_replace(name, '[\\s\\-_/]+', '', 'g')) AS nk, regexp_replace(z, '[^a-z0-9]+', '', 'g') AS alnum, TRY_CAST(nullif(regexp_extract(trim(name), '(\\d+)\\s*$', 1), '') AS BIGINT) AS nummer,
  trim(regexp_replace(lower(trim(name)), '\\s*\\d+\\s*$', '')) AS stamm, list_filter(string_split_regex(z, '[^a-z0-9]+'), lambda w: w <> '' AND NOT regexp_full_match(w, '\\d+'))[-1] AS kopf FROM x""", "rooms")
def name_tokens(t: Tables):
    n = F.col("name")
    return t.rooms.select("room_id", X.name_key(n).alias("nk"), X.alnum_key(n).alias("alnum"), X.trailing_int(n).alias("nummer"), X.name_stem(n).alias("stamm"), X.head_noun(n).alias("kopf"))


@query("room_keys", "F7 F22", """
 SELECT room_id, name || '|' || wohnung || '|' || geschoss || '|' || coalesce(format('{:.2f}', flaeche_m2), '') AS rkey,
  CASE umfang_quelle WHEN 'geschaetzt' THEN 'U≈' || umfang_m || ' (geschätzt)' WHEN 'geometrie' THEN 'U≈' || umfang_m || ' (aus Umriss)' ELSE 'U=' || umfang_m END AS u_text FROM rooms""", "rooms")
def room_keys(t: Tables):
    return t.rooms.select("room_id", X.room_key(F.col("name"), F.col("wohnung"), F.col("geschoss"), F.col("flaeche_m2")).alias("rkey"),
                          X.perimeter_label(F.col("umfang_m"), F.col("umfang_quelle")).alias("u_text"))


@query("scale_labels", "F13", """
 SELECT l_partkey, CASE WHEN l_partkey * 3 BETWEEN 10 AND 5000 THEN round(2835.0/(l_partkey*3), 8) END AS ptm, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def scale_labels(t: Tables):
    lbl = F.concat(F.lit("M 1 : "), (F.col("l_partkey") * 3).cast("string"))
    return t.lineitem.select("l_partkey", F.round(N.scale_points_per_m(lbl), 8).alias("ptm")).groupBy("l_partkey", "ptm").agg(F.count(F.lit(1)).alias("n"))


@query("chain_values", "F23", """
 SELECT span_id, CASE WHEN regexp_full_match(trim(text), '\\d{1,4}(,\\d)?') AND TRY_CAST(replace(trim(text), ',', '.') AS DOUBLE) BETWEEN 5 AND 1500 THEN TRY_CAST(replace(trim(text), ',', '.') AS DOUBLE) END AS cm,
  CASE WHEN regexp_full_match(trim(text), '\\d{1,2}[.,]\\d{1,2}') AND TRY_CAST(replace(trim(text), ',', '.') AS DOUBLE) BETWEEN 0.3 AND 15 THEN TRY_CAST(replace(trim(text), ',', '.') AS DOUBLE)*100 END AS aus_m FROM spans""", "spans")
def chain_values(t: Tables):
    return t.spans.select("span_id", N.chain_value_cm(F.col("text")).alias("cm"), N.chain_value_m(F.col("text")).alias("aus_m"))


@query("finite_quantities", "F24 F11", """
, x AS (SELECT messung_id, x - y AS q, coalesce(bezeichnung, '') AS b FROM (SELECT *, typ || CASE WHEN geschlossen THEN '; "zu"' ELSE '' END AS bezeichnung FROM measurements))
 SELECT messung_id, CASE WHEN q < 0 THEN 0 ELSE q END AS menge, replace(format('{:.2f}', q), '.', ',') AS text, CASE WHEN contains(b, ';') OR contains(b, '"') THEN '"' || replace(b, '"', '""') || '"' ELSE b END AS feld FROM x""", "measurements")
def finite_quantities(t: Tables):
    q = F.col("x") - F.col("y")
    b = F.concat(F.col("typ"), F.when(F.col("geschlossen"), F.lit('; "zu"')).otherwise(F.lit("")))
    return t.measurements.select("messung_id", N.finite_quantity(q).alias("menge"), N.german_format(q).alias("text"), N.csv_field(b).alias("feld"))


# rule texts in the documented shape: norm, place, wording, formula after the last dot
RULE_TEXTS = [
    "in Anlehnung an ÖNORM B 2204 §5.5.1.3 · Σ(U×H) − Öffnungen>4.0m²", "ÖNORM B 2230-1 (Malerarbeiten) · Abzugsschwelle 2.5 m² NICHT normbelegt · Σ(U×H)",
    "Putz nach DIN 18363 · Σ Fläche", "12 Stk × 0.50 m³/Stk", "Bodenplatten-Fläche × 0,15 m (Annahme)", "ÖNORM B 2232 · Σ Raumumfang",
]


@query("rule_citations", "F8", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 6 AS k FROM lineitem)
 SELECT k, CASE k WHEN 0 THEN 'norm' WHEN 1 THEN 'norm_offen' WHEN 2 THEN 'fremdnorm' WHEN 3 THEN 'stueckzahl' WHEN 4 THEN 'praxis' ELSE 'norm' END AS art,
  CASE k WHEN 0 THEN 'ÖNORM B 2204' WHEN 1 THEN 'ÖNORM B 2230-1' WHEN 2 THEN 'DIN 18363' WHEN 5 THEN 'ÖNORM B 2232' END AS norm, CASE k WHEN 0 THEN '§5.5.1.3' END AS stelle, k = 0 AS angelehnt,
  CASE k WHEN 0 THEN 'Σ(U×H) − Öffnungen>4.0m²' WHEN 1 THEN 'Σ(U×H)' WHEN 2 THEN 'Σ Fläche' WHEN 3 THEN '12 Stk × 0.50 m³/Stk' WHEN 4 THEN 'Bodenplatten-Fläche × 0,15 m (Annahme)' ELSE 'Σ Raumumfang' END AS formel, count(*) AS n FROM x GROUP BY ALL""")
def rule_citations(t: Tables):
    from ..functions.rules import citation

    k = F.col("l_partkey") % 6
    text = F.element_at(F.array(*[F.lit(r) for r in RULE_TEXTS]), (k + 1).cast("int"))
    return t.lineitem.select(k.alias("k"), citation(text).alias("r")).select("k", "r.*").groupBy("k", "art", "norm", "stelle", "angelehnt", "formel").agg(F.count(F.lit(1)).alias("n"))


@query("graduated_deductions", "F20", """
, x AS (SELECT opening_id, coalesce(breite_m,0)*coalesce(hoehe_m,0) AS a FROM openings)
 SELECT opening_id, CASE WHEN a <= 2.5 THEN 0.0 WHEN a <= 10 THEN 0.5 ELSE 1.0 END::DOUBLE AS putz_innen, CASE WHEN a < 0.1 THEN 0.0 ELSE 1.0 END::DOUBLE AS fliesen, 0.0::DOUBLE AS estrich FROM x""", "openings")
def graduated_deductions(t: Tables):
    from ..functions.rules import graduated_factor

    a = F.coalesce("breite_m", F.lit(0.0)) * F.coalesce("hoehe_m", F.lit(0.0))
    return t.openings.select("opening_id", *[graduated_factor(a, g).alias(g) for g in ("putz_innen", "fliesen", "estrich")])


@query("event_json", "F27 F28 S8", """
 SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events""")
def event_json(t: Tables):
    from ..sources.files import last_json_block

    raw = F.concat(F.lit('Antwort: ```json {"k":-1} ``` Korrektur: ```json '), F.col("props"), F.lit(" ``` Ende {kein JSON}"))
    js = last_json_block(raw)
    return t.events.select("event_id", F.from_json(js, "k BIGINT")["k"].alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("room_predicates", "P5 P10 P12", """
, x AS (SELECT span_id, lower(text) AS t FROM spans)
 SELECT span_id, regexp_matches(t, 'carport|terrasse|loggia|balkon') AS offen, length(trim(text)) >= 2 AND regexp_matches(trim(t), '^[a-zäöüß]') AND NOT regexp_matches(trim(t), '^(aw|iw|stuk|rh|bf|ok)([^a-zäöüß]|$)|^fe_|^[fu] ?[:=]|^(parkett|fliesen|laminat|teppich|estrich|beton|betonplatten|kies|wiese|rasen|pflaster|asphalt|holz|vlies|epoxy|keramik|stein|feinstein)([^a-zäöüß]|$)') AND rtrim(trim(t), '.:') NOT IN ('m', 'm2', 'm²', 'cm', 'mm', 'st', 'stk', 'lfm', 'pa', 'kg') AS raumname FROM (SELECT span_id, text, t FROM (SELECT span_id, text, lower(text) AS t FROM spans)) x""", "spans")
def room_predicates(t: Tables):
    from ..functions.rules import is_room_text
    from ..plans.merge import is_open_roof

    return t.spans.select("span_id", is_open_roof(F.col("text")).alias("offen"), is_room_text(F.col("text")).alias("raumname"))


@query("material_classes", "P12", """
, x AS (SELECT line_id, lower(soll_bez || ' ' || CASE list_id % 4 WHEN 0 THEN 'Stahlbeton' WHEN 1 THEN 'Holzriegel' WHEN 2 THEN 'Gipskarton' ELSE '' END) AS t FROM quantities)
 SELECT line_id, CASE WHEN contains(t,'holzriegel') THEN 'holz' WHEN contains(t,'stahlbeton') THEN 'beton' WHEN contains(t,'hlz') THEN 'mauerwerk' WHEN contains(t,'gipskarton') THEN 'trockenbau' END AS klasse FROM x""", "quantities")
def material_classes(t: Tables):
    from ..functions.rules import material_class

    extra = F.expr("CASE list_id % 4 WHEN 0 THEN 'Stahlbeton' WHEN 1 THEN 'Holzriegel' WHEN 2 THEN 'Gipskarton' ELSE '' END")
    return t.quantities.select("line_id", material_class(F.concat_ws(" ", F.col("soll_bez"), extra)).alias("klasse"))


@query("colour_classes", "F26 P18", """
, x AS (SELECT segment_id, grau*0.9 AS c, breite AS m, 0.1 AS y, 0.05 AS k FROM segments)
, r AS (SELECT segment_id, (1-c)*(1-k) AS r, (1-m)*(1-k) AS g, (1-y)*(1-k) AS b FROM x)
 SELECT segment_id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6)::DOUBLE AS b, CASE WHEN least(r,g,b) > 0.94 THEN 'weiss' WHEN greatest(r,g,b)-least(r,g,b) < 0.08 THEN 'neutral' WHEN r > b THEN 'warm' ELSE 'kalt' END AS klasse FROM r""", "segments")
def colour_classes(t: Tables):
    from ..functions.rules import cmyk_to_rgb, colour_class

    s = t.segments.withColumn("rgb", cmyk_to_rgb(F.col("grau") * 0.9, F.col("breite"), F.lit(0.1), F.lit(0.05)))
    c = F.col("rgb")
    return s.select("segment_id", F.round(c[0], 6).alias("r"), F.round(c[1], 6).alias("g"), F.round(c[2], 6).alias("b"), colour_class(c).alias("klasse"))
