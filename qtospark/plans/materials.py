"""Material order list per project: base geometry, then one exploded array of lines.

Everything a project needs is first reduced to one row (room sums by category, opening
deductions, resolved factors); all material lines are expressions over that row.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import openings as op
from ..functions.geometry import outer_perimeter_estimate
from ..functions.numbers import finite_quantity
from ..functions.similarity import with_category

# --- fixed values -----------------------------------------------------------------
DEFAULTS = {
    "bodenplatte_aufschlag": 1.15, "include_loggia_decke": 1.0, "include_loggia_bodenplatte": 0.0,
    "sauberkeitsschicht_cm": 5.0, "frostschuerze_tiefe_m": 0.80, "frostschuerze_breite_m": 0.30,
    "frostgraben_aufschlag": 1.15, "aussenumfang_aufschlag": 1.55,
    "wand_anteil_50cm": 85.0, "wand_anteil_38cm": 10.0, "wand_anteil_25cm_aussen": 5.0,
    "wand_anteil_25cm_innen": 25.0, "wand_anteil_20cm": 30.0, "wand_anteil_12cm": 45.0,
    "hlz_verschnitt": 1.05, "innenwand_aufschlag": 1.0, "decke_auskragung": 1.05,
    "loggia_decke_aufschlag": 1.15, "ekv_decke_aufschlag": 1.35, "iso_korb_anteil": 0.80,
    "attika_anteil_aussen": 0.0, "attika_hoehe_m": 0.50, "attika_aktiv": 0.0,
    "anzahl_saeulen": 0.0, "saeule_beton_m3_pro_stk": 0.5, "anzahl_kamine": 0.0,
    "aq65_m2_pro_matte": 5.0, "pe_folie_m2_pro_rolle": 50.0, "xps_frostschuerze_tiefe_m": 1.05,
    "mauermoertel_paletten_pro_100m2": 0.6, "voranstrich_kanister_pro_100m2": 1.0,
    "torstahl_stk_pro_m_randabschluss": 0.25, "steckeisen_stk_pro_m_frostschuerze": 1.7,
    "ekv_aufschlag": 1.0, "ekv_mauerwerk_h_anteil": 0.95,
}
PALLET_M2 = {50: 3.0, 38: 4.5, 25: 6.5, 20: 8.0, 12: 12.0}
PIECES_PER_PALLET = {50: 40, 38: 45, 25: 55, 20: 60, 12: 70}
DEFAULT_OUTER = {50: "wand_anteil_50cm", 38: "wand_anteil_38cm", 25: "wand_anteil_25cm_aussen"}
DEFAULT_INNER = {25: "wand_anteil_25cm_innen", 20: "wand_anteil_20cm", 12: "wand_anteil_12cm"}
LINTELS_CM = [125, 150, 200, 250, 300]
SHUTTER_CLASSES = [(124, 1.0, 1.4), (184, 1.4, 2.0), (214, 2.0, 2.4), (244, 2.4, None)]
REBAR_KG_M3 = 90.0
DENSITY_WORDS = "steckeisen|torstahl|bügel|abstandhalter"
AREA_PRODUCT_WORDS = "aq 65|pe-folie"
PERIMETER_WORDS = "randabschluss|mauersperrbahn"
PERIMETER_FORMULA = "umfang|außenkante|außenwand|frostgraben"


def params_map(overrides: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Long ``(key, faktor, wert)`` overrides to one ``params`` map per key."""
    return overrides.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("faktor", "wert")))).alias("params"))


def p(name: str) -> Column:
    """Factor: override of the project, else default."""
    return F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(DEFAULTS[name]))


def base_geometry(rooms: DataFrame, openings: DataFrame, building: DataFrame, measured: DataFrame | None = None,
                  params: DataFrame | None = None, key: str = "projekt_id") -> DataFrame:
    """One row per project: slab, ceiling, perimeters and net wall areas.

    Doubles are kept full between steps and rounded once, at output.

    ``building`` one row per project; ``measured(key, aussenumfang_m, bodenplatte_flaeche_m2,
    fundament_umfang_m, m_konfidenz, umfang_konfidenz)`` beats the estimates.
    """
    kat = F.col("kategorie")
    f, u, hh = (F.coalesce(c, F.lit(0.0)) for c in ("flaeche_m2", "umfang_m", "hoehe_m"))
    inside, loggia = kat == "Innenraum_warm", kat == "Loggia"
    zero = F.lit(0.0)
    garage = F.lower(F.col("name")).contains("garage")
    r = with_category(rooms.select(key, "name", "flaeche_m2", "umfang_m", "hoehe_m"))
    sums = r.groupBy(key).agg(
        F.sum(F.when(inside, f).otherwise(zero)).alias("f_innen"), F.sum(F.when(loggia, f).otherwise(zero)).alias("f_loggia"),
        F.sum(F.when(inside, u).otherwise(zero)).alias("u_innen"), F.sum(f).alias("f_alle"),
        F.sum(F.when(kat.isin("Nebenraum_kalt", "Loggia"), f).otherwise(zero)).alias("f_kalt"),
        F.sum(F.when(garage, f).otherwise(zero)).alias("f_garage"),
        F.bool_or(garage & (f >= 100.0)).alias("halle"), F.count(F.lit(1)).alias("n_raeume"),
        F.avg(F.when(inside & (hh > 0), hh)).alias("h_raum"), F.avg(F.when(hh > 0, hh)).alias("h_alle"))
    d = sums.join(building.drop("aussenumfang_m", "bodenplatte_m2", "decke_m2", "aussenwand_flaeche_m2"), key, "left")
    if measured is not None:
        d = d.join(measured, key, "left")
    else:
        for c in ("aussenumfang_m", "bodenplatte_flaeche_m2", "fundament_umfang_m", "m_konfidenz", "umfang_konfidenz"):
            d = d.withColumn(c, F.lit(None).cast("double"))
    d = d.join(params, key, "left") if params is not None else d.withColumn("params", F.lit(None).cast("map<string,double>"))

    # opening deductions of the order list (structure threshold)
    o = openings.join(building.select(key, F.col("aussenwand_cm").alias("_aw"), F.col("innenwand_tragend_cm").alias("_iw")), key, "left")
    n = op.net_opening(F.coalesce("breite_m", zero), F.coalesce("hoehe_m", zero),
                       op.wall_cm(F.col("wand_typ"), F.col("art"), F.col("_aw"), F.col("_iw")), F.col("fph_m"), op.threshold("rohbau"))
    outer = op.is_outer_wall(F.col("wand_typ"), F.col("art"))
    ded = o.select(key, outer.alias("_o"), n["abzug"].alias("_a")).groupBy(key).agg(
        F.sum(F.when(F.col("_o"), F.col("_a")).otherwise(zero)).alias("abzug_aw"),
        F.sum(F.when(~F.col("_o"), F.col("_a")).otherwise(zero)).alias("abzug_iw"))
    d = d.join(ded, key, "left").fillna(0.0, ["abzug_aw", "abzug_iw"])

    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    d = d.withColumn("stb", F.coalesce("halle", F.lit(False)) | ((F.col("f_alle") >= 200.0) & (F.col("f_kalt") / F.when(F.col("f_alle") > 0, F.col("f_alle")) > 0.60)))
    d = d.withColumn("stb", F.coalesce("stb", F.lit(False)))
    d = d.withColumn("h", F.coalesce(good("geschosshoehe_m"), F.when(~F.col("stb"), F.col("h_raum")).otherwise(F.col("h_alle")), F.when(F.col("stb"), F.lit(2.75)).otherwise(F.lit(2.70))))
    d = d.withColumn("aw_cm", F.coalesce(good("aussenwand_cm"), F.lit(50.0)))
    d = d.withColumn("d_cm", F.coalesce(good("decke_cm"), F.when(F.col("stb"), F.lit(25.0)).otherwise(F.lit(22.0))))
    d = d.withColumn("bp_cm", F.coalesce(good("bodenplatte_cm"), F.when(F.col("stb"), F.lit(30.0)).otherwise(F.lit(25.0))))
    in_bp = p("include_loggia_bodenplatte") != 0
    meas = F.col("bodenplatte_flaeche_m2") > 0
    bp = F.when(meas, F.col("bodenplatte_flaeche_m2")).otherwise((F.col("f_innen") + F.when(in_bp, F.col("f_loggia")).otherwise(zero)) * p("bodenplatte_aufschlag"))
    d = d.withColumn("bodenplatte", bp)
    twice = ~F.coalesce(meas, F.lit(False)) & in_bp
    over = F.when(p("include_loggia_decke") != 0, F.col("f_loggia")).otherwise(zero)
    d = d.withColumn("decke", (F.col("bodenplatte") + F.when(twice, zero).otherwise(over * p("loggia_decke_aufschlag"))) * p("decke_auskragung"))
    d = d.withColumn("decke_planmass", F.col("bodenplatte") + F.when(twice, zero).otherwise(over))
    est = outer_perimeter_estimate(F.col("bodenplatte")) / 1.40 * p("aussenumfang_aufschlag")
    d = d.withColumn("umfang", F.coalesce(good("aussenumfang_m"), est))
    d = d.withColumn("fundament", F.coalesce(good("fundament_umfang_m"), F.col("umfang")))
    d = d.withColumn("h_mw", F.greatest(F.lit(2.0), F.col("h") - F.col("d_cm") / 100.0))
    inner_edge = F.greatest(zero, F.col("umfang") - 8.0 * F.col("aw_cm") / 100.0)
    d = d.withColumn("aw_brutto", F.col("umfang") * F.col("h_mw"))
    iw_len = F.greatest(zero, (F.col("u_innen") - inner_edge) / 2.0)
    d = d.withColumn("iw_brutto", iw_len * F.col("h_mw") * p("innenwand_aufschlag"))
    d = d.withColumn("aw_netto", F.greatest(zero, F.col("aw_brutto") - F.col("abzug_aw")))
    return d.withColumn("iw_netto", F.greatest(zero, F.col("iw_brutto") - F.col("abzug_iw")))


def _ml(part: str, material, unit: str, qty: Column, formula: str, when: Column | None = None) -> Column:
    mat = F.lit(material) if isinstance(material, str) else material
    s = F.struct(F.lit(part).alias("bauteil"), mat.alias("material"), F.lit(unit).alias("einheit"),
                 finite_quantity(qty.cast("double")).alias("menge"), F.lit(formula).alias("formel"))
    return s if when is None else F.when(when, s)


def masonry_lines(base: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Frost apron, slab, masonry accessories, ceiling, attic, columns, chimneys."""
    c = F.col
    trench = c("fundament") * p("frostgraben_aufschlag")
    up = lambda x: F.greatest(F.lit(1.0), F.ceil(x).cast("double"))
    wall_all = c("aw_netto") + c("iw_netto")
    bigger = c("fundament") > c("umfang") + 0.05
    rim = F.when(bigger, c("fundament")).otherwise(c("umfang"))
    rim = F.when(c("bodenplatte") > 0, rim * F.sqrt(c("decke") / F.when(c("bodenplatte") > 0, c("bodenplatte")))).otherwise(rim)
    blind = F.coalesce(p("sauberkeitsschicht_cm"))
    flat = (p("attika_aktiv") != 0) | (p("attika_anteil_aussen") > 0)
    att = c("umfang") * p("attika_hoehe_m")
    ns, nk = F.floor(p("anzahl_saeulen")), F.floor(p("anzahl_kamine"))
    fs, bp, mw, dk = "Frostschürze", "Bodenplatte", "Mauerwerk EG", "Decke über EG"
    lines = [
        _ml(fs, "Beton C25/30, XC1, F52, GK 22", "m³", trench * p("frostschuerze_tiefe_m") * p("frostschuerze_breite_m"), "Frostgraben-Umfang × Tiefe × Breite"),
        _ml(fs, "XPS-SF G30 140mm", "m²", trench * p("xps_frostschuerze_tiefe_m"), "Frostgraben-Umfang × Sockeldämm-Höhe"),
        _ml(fs, "2k Bitumen Spachtelmasse (5mm)", "m²", trench * p("xps_frostschuerze_tiefe_m"), "Außenkante Frostschürze"),
        _ml(fs, "Noppenfolie 1m", "lfm", trench, "Frostgraben-Umfang"),
        _ml(fs, "Steckeisen 10mm a 1m gekröpft", "Stk", F.rint(trench * p("steckeisen_stk_pro_m_frostschuerze")), "Frostgraben-Umfang × Stk-Dichte"),
        _ml(bp, "Beton C25/30, B2, GK 22, F52", "m³", c("bodenplatte") * c("bp_cm") / 100.0, "Fläche × Dicke"),
        _ml(bp, "Beton C16/20 (Sauberkeitsschicht)", "m³", c("bodenplatte") * blind / 100.0, "Fläche × Dicke"),
        _ml(bp, "EKV-5 Bitumendichtbahn", "m²", c("bodenplatte") * p("ekv_aufschlag"), "Fläche"),
        _ml(bp, "XPS-SF G30 120mm", "m²", c("bodenplatte"), "Fläche"),
        _ml(bp, "Randabschlusskorb 16cm", "lfm", c("fundament"), "Bodenplatten-Außenkante"),
        _ml(bp, "Baustahlgitter AQ 65", "Stk", F.ceil(c("bodenplatte") / p("aq65_m2_pro_matte")), "Fläche ÷ m²/Matte"),
        _ml(bp, "PE-Folie", "Rollen", F.ceil(c("bodenplatte") / p("pe_folie_m2_pro_rolle")), "Fläche ÷ m²/Rolle"),
        _ml(bp, "Torstahl 12mm (Schürzen-Bewehrung)", "Stk", F.rint(c("fundament") * p("torstahl_stk_pro_m_randabschluss")), "Bodenplatten-Außenkante × Stk-Dichte"),
        _ml(mw, "Mauermörtel", "Paletten", wall_all / 100.0 * p("mauermoertel_paletten_pro_100m2"), "Wandfläche"),
        _ml(mw, "bitumin. Voranstrich", "Kanister", up(c("aw_netto") / 100.0 * p("voranstrich_kanister_pro_100m2")), "Außenwand"),
        _ml(mw, "EKV-5 (Außenwand)", "m²", c("aw_netto") * p("ekv_mauerwerk_h_anteil"), "Außenwand × Anteil"),
        _ml(mw, "Mauersperrbahn 25cm", "Rollen", up(c("fundament") / 25.0), "Gebäude-Außenkante ÷ 25"),
        _ml(dk, "Beton C25/30, XC1, GK 22, F52", "m³", c("decke") * c("d_cm") / 100.0, "Fläche × Dicke"),
        _ml(dk, "Schaltafel 200/50", "m²", c("decke"), "Fläche"),
        _ml(dk, "ISO-Korb 8/25", "lfm", c("fundament") * p("iso_korb_anteil"), "Gebäude-Außenkante × Anteil"),
        _ml(dk, "EKV-5 Dachabdichtung", "m²", c("decke") * p("ekv_decke_aufschlag"), "Fläche × Aufschlag"),
        _ml(dk, "Randabschlusskorb 16cm", "lfm", rim, "Decken-Rand (Umfang × √Flächenverhältnis)"),
        _ml(dk, "Baustahlgitter AQ 65", "Stk", F.ceil(c("decke") / p("aq65_m2_pro_matte")), "Fläche ÷ m²/Matte"),
        _ml(dk, "bitumin. Voranstrich", "Kanister", up(c("decke") / 100.0 * p("voranstrich_kanister_pro_100m2")), "Fläche"),
        _ml("Attika", "XPS 6cm Oberfläche rau", "m²", att, "Außenumfang × Höhe", flat),
        _ml("Attika", "Beton C25/30", "m³", att * 0.15, "Fläche × 0,15", flat),
        _ml("Attika", "Steckeisen 10mm a 1m gekröpft", "Stk", F.rint(c("umfang") * 3), "Außenumfang × 3", flat),
        _ml("Säulen", "Beton C25/30 (Fundamente + Säulen)", "m³", ns * p("saeule_beton_m3_pro_stk"), "Stk × m³", ns > 0),
        _ml("Säulen", "Bügel geschlossen 18/18 12mm", "Stk", ns * 15, "Stk × 15", ns > 0),
        _ml("Säulen", "Torstahl 14mm a 7m", "Stk", ns * 2, "Stk × 2", ns > 0),
        _ml("Kamin", "Kamin DN16 mit Fertigfuß und Haube", "Stk", nk, "Anzahl", nk > 0),
    ]
    return base.filter(~c("stb")).select(key, F.inline(F.array_compact(F.array(*lines))))


def concrete_lines(base: DataFrame, key: str = "projekt_id") -> DataFrame:
    """List of the reinforced-concrete sector (underground garage)."""
    c = F.col
    gf = c("f_alle") * 1.05
    umf = F.coalesce(F.when(c("aussenumfang_m") > 0, c("aussenumfang_m")), F.sqrt("f_alle") * 4 * 1.15)
    wall = umf * c("h")
    b, w, d = gf * c("bp_cm") / 100.0, wall * 25.0 / 100.0, gf * c("d_cm") / 100.0
    t = REBAR_KG_M3 / 1000.0
    wd = "Wände (STB)"
    lines = [
        _ml("Bodenplatte", "Beton C25/30", "m³", b, "Fläche × Dicke"), _ml("Bodenplatte", "Sauberkeitsschicht C16/20 5cm", "m³", gf * 0.05, "Fläche × Dicke"),
        _ml("Bodenplatte", "Bewehrung (Kennwert)", "t", b * t, "m³ × kg/m³"), _ml(wd, "Beton C25/30 Wand", "m³", w, "Umfang × h × Dicke"),
        _ml(wd, "Schalung vertikal (2-seitig)", "m²", wall * 2, "Wandfläche × 2"), _ml(wd, "Bewehrung (Kennwert)", "t", w * t, "m³ × kg/m³"),
        _ml("Decke", "Beton C25/30", "m³", d, "Fläche × Dicke"), _ml("Decke", "Schalung horizontal", "m²", gf, "Fläche"),
        _ml("Decke", "Bewehrung (Kennwert)", "t", d * t, "m³ × kg/m³"),
        _ml("Bodenaufbau", "Bodenbeschichtung (OS 8)", "m²", c("f_garage"), "Garagenfläche", c("f_garage") > 0),
    ]
    return base.filter("stb").select(key, F.inline(F.array_compact(F.array(*lines))))


def brick_lines(base: DataFrame, distribution: DataFrame | None = None, lengths: DataFrame | None = None,
                key: str = "projekt_id") -> DataFrame:
    """Brick pallets by thickness: absolute lengths, else read distribution, else default shares.

    ``distribution(key, seite, dicke_cm, pct)``; ``lengths(key, dicke_cm, laenge_m)``.
    """
    b = base.filter(~F.col("stb"))
    zero = F.lit(0.0)
    default = [F.struct(F.lit("aussen").alias("seite"), F.lit(d).alias("dicke_cm"), p(k).alias("pct")) for d, k in DEFAULT_OUTER.items()]
    default += [F.struct(F.lit("innen").alias("seite"), F.lit(d).alias("dicke_cm"), p(k).alias("pct")) for d, k in DEFAULT_INNER.items()]
    cols = [key, "aw_netto", "iw_netto", "params"]
    dist = b.select(*cols, F.inline(F.array(*default)))
    if distribution is not None:
        known = distribution.select(key).distinct()
        dist = dist.join(known, key, "left_anti").unionByName(
            b.select(*cols).join(distribution.select(key, "seite", "dicke_cm", "pct"), key))
    area = dist.select(key, "params", "dicke_cm", (F.when(F.col("seite") == "aussen", F.col("aw_netto")).otherwise(F.col("iw_netto")) * F.col("pct") / 100.0).alias("m2"))
    if lengths is not None:
        measured = b.select(key, "params", "h_mw").join(lengths.filter("laenge_m > 0"), key)
        area = area.join(lengths.select(key).distinct(), key, "left_anti").unionByName(
            measured.select(key, "params", "dicke_cm", (F.col("laenge_m") * F.col("h_mw")).alias("m2")))
    g = area.groupBy(key, "dicke_cm").agg(F.sum("m2").alias("m2"), F.any_value("params").alias("params"))
    cover = F.create_map(*[F.lit(x) for x in chain.from_iterable(PALLET_M2.items())])
    pieces = F.create_map(*[F.lit(x) for x in chain.from_iterable(PIECES_PER_PALLET.items())])
    cov = F.coalesce(F.try_element_at(cover, F.col("dicke_cm")), F.round(F.lit(150.0) / F.col("dicke_cm"), 2))
    pal = F.ceil(F.round(F.col("m2") * p("hlz_verschnitt") / cov, 9))
    return g.select(
        key, F.lit("Mauerwerk EG").alias("bauteil"), F.concat(F.lit("HLZ "), F.col("dicke_cm").cast("string"), F.lit("cm Plan")).alias("material"),
        F.lit("Paletten").alias("einheit"), pal.cast("double").alias("menge"), F.lit("Außenwand/Innenwand ÷ m²/Pal × Verschnitt").alias("formel"),
        (pal * F.try_element_at(pieces, F.col("dicke_cm"))).cast("double").alias("stueck"))


def opening_hardware(openings: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Shutter boxes by width class and lintels by the smallest stocked length that fits.

    Text-read widths are used alone where a project has any; openings without a width
    count as the shortest lintel.  Counting is a plain conditional aggregation.
    """
    win, door = F.col("art") != "tuer", F.col("art") == "tuer"
    has_text = openings.filter("quelle = 'text' and breite_m > 0").groupBy(key).agg(
        F.bool_or(win).alias("wt"), F.bool_or(door).alias("dt"))
    o = openings.join(has_text, key, "left")
    used = F.when(win, ~F.coalesce("wt", F.lit(False)) | (F.col("quelle") == "text")).otherwise(~F.coalesce("dt", F.lit(False)) | (F.col("quelle") == "text"))
    b = F.when((F.col("breite_m") > 0) & used, F.col("breite_m"))
    need = F.round(b * 100.0 + 30.0, 6)
    size = None
    for L in LINTELS_CM[:-1]:
        size = F.when(need <= L, F.lit(L)) if size is None else size.when(need <= L, F.lit(L))
    lintel = size.otherwise(F.lit(LINTELS_CM[-1]))
    narrow = F.round(F.col("breite_m") * 100.0 + 30.0, 6)
    nsize = None
    for L in LINTELS_CM[:-1]:
        nsize = F.when(narrow <= L, F.lit(L)) if nsize is None else nsize.when(narrow <= L, F.lit(L))
    nsize = nsize.otherwise(F.lit(LINTELS_CM[-1]))
    box = F.when(b.between(1.0, 1.4), F.lit(124)).when((b > 1.4) & (b <= 2.0), F.lit(184)).when((b > 2.0) & (b <= 2.4), F.lit(214)).when(b > 2.4, F.lit(244))
    item = F.array_compact(F.array(
        F.when(win & box.isNotNull(), F.concat(F.lit("Rolladenkasten "), box.cast("string"), F.lit("cm"))),
        F.when(door & b.isNotNull(), F.concat(F.lit("Ziegelüberlage "), lintel.cast("string"), F.lit("cm"))),
        F.when(door & b.isNull(), F.concat(F.lit("Ziegelüberlage "), F.lit(str(LINTELS_CM[0])), F.lit("cm"))),
        F.when(win & (F.col("breite_m") > 0) & (F.col("breite_m") < 1.0), F.concat(F.lit("Ziegelüberlage "), nsize.cast("string"), F.lit("cm (Fenster)"))),
    ))
    return (
        o.select(key, F.explode(item).alias("material")).groupBy(key, "material").agg(F.count(F.lit(1)).cast("double").alias("menge"))
        .select(key, F.lit("Öffnungen").alias("bauteil"), "material", F.lit("Stk").alias("einheit"), "menge", F.lit("Anzahl").alias("formel"))
    )


def gable_lines(base: DataFrame, roof: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Gable wall of pitched roofs: short rectangle side × ridge excess / 2 × gables."""
    d = base.join(roof, key).filter(F.lower("dach_typ").isin("sattel", "satteldach", "pult", "pultdach"))
    over = F.col("gebaeudehoehe_m") - (F.col("h") + F.col("d_cm") / 100.0)
    disc = F.col("umfang") * F.col("umfang") / 16.0 - F.col("bodenplatte")
    short = F.col("umfang") / 4.0 - F.sqrt(F.greatest(disc, F.lit(0.0)))
    n = F.when(F.lower("dach_typ").startswith("sattel"), 2).otherwise(1)
    area = short * over / 2.0 * n
    return d.filter((F.col("umfang") > 0) & (F.col("bodenplatte") > 0) & over.between(0.5, 6.0) & (disc > 0) & (area >= 2.0)).select(
        key, F.lit("Mauerwerk EG").alias("bauteil"), F.lit("HLZ Giebel").alias("material"), F.lit("m²").alias("einheit"), area.alias("menge"), F.lit("Giebel").alias("formel"))


def floor_lines(rooms: DataFrame, layers: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Floor build-up by legend layers and flooring per material.

    ``layers(key, estrich_cm, schuettung_cm, belag_cm, trittschall_cm)``.
    """
    r = with_category(rooms).filter("kategorie = 'Innenraum_warm'")
    zero = F.lit(0.0)
    per = r.groupBy(key, F.nullif(F.trim("bodenbelag"), F.lit("")).alias("belag")).agg(
        F.sum(F.coalesce("flaeche_m2", zero)).alias("f"), F.sum(F.coalesce("umfang_m", zero)).alias("u"))
    tot = per.groupBy(key).agg(F.sum("f").alias("f"), F.sum("u").alias("u")).join(layers, key)
    tot = tot.filter((F.col("f") > 0) & F.coalesce("estrich_cm", "schuettung_cm", "belag_cm").isNotNull())
    B = "Bodenaufbau"
    f = F.col("f")
    lines = [
        _ml(B, "Estrich (Volumen)", "m³", f * F.col("estrich_cm") / 100.0, "ΣF × Dicke", F.col("estrich_cm").isNotNull()),
        _ml(B, "Estrich-Fläche", "m²", f, "ΣF"),
        _ml(B, "Schüttung (Volumen)", "m³", f * F.col("schuettung_cm") / 100.0, "ΣF × Dicke", F.col("schuettung_cm").isNotNull()),
        _ml(B, "Trittschalldämmung", "m²", f, "ΣF", F.col("trittschall_cm").isNotNull()),
        _ml(B, "Randdämmstreifen", "lfm", F.col("u"), "ΣU"),
    ]
    a = tot.select(key, F.inline(F.array_compact(F.array(*lines))))
    b = per.filter(F.col("belag").isNotNull() & ~F.lower("belag").isin("nicht erkennbar", "?")).join(tot.select(key), key).select(
        key, F.lit(B).alias("bauteil"), F.concat(F.lit("Bodenbelag "), "belag").alias("material"), F.lit("m²").alias("einheit"),
        F.col("f").alias("menge"), F.lit("ΣF je Belag").alias("formel"))
    return a.unionByName(b)


def rate_confidence(lines: DataFrame, base: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Confidence from the origin of the inputs, and the plan layer a line refers to."""
    cap = lambda c, top, dflt: F.round(F.least(F.lit(top), F.coalesce(c, F.lit(dflt))), 2)
    k = base.select(
        key, cap(F.col("m_konfidenz"), 0.96, 0.62).alias("kg"),
        cap(F.coalesce("umfang_konfidenz", "m_konfidenz"), 0.96, 0.62).alias("ku"))
    d = lines.join(k, key)
    kg, ku = F.col("kg"), F.col("ku")
    mat, frm, b = F.lower("material"), F.lower("formel"), F.col("bauteil")
    umf = frm.rlike(PERIMETER_FORMULA)
    both = F.round(kg * 0.9, 2)
    conf = (
        F.when(mat.rlike(DENSITY_WORDS), F.lit(0.5)).when(mat.rlike(AREA_PRODUCT_WORDS), F.round(F.least(kg, F.lit(0.72)), 2))
        .when(mat.rlike(PERIMETER_WORDS), ku).when((b == "Bodenaufbau") | mat.contains("sauberkeit"), F.round(kg * 0.85, 2))
        .when((b == "Mauerwerk EG") & mat.contains("hlz"), F.round(F.least(both, ku), 2)).when(b == "Öffnungen", F.lit(0.62))
        .when(b.isin("Attika", "Säulen"), F.round(kg * 0.6, 2)).when(b.isin("Kamin", "Infrastruktur"), F.lit(0.7))
        .when(b == "Frostschürze", F.when(mat.contains("noppenfolie"), ku).otherwise(F.round(ku * 0.9, 2)))
        .when(b == "Bodenplatte", F.when(umf, ku).otherwise(kg))
        .when(b == "Decke über EG", F.when(umf, ku).when(mat.rlike("iso-korb|voranstrich"), F.round(kg * 0.85, 2)).otherwise(F.round(kg * 0.92, 2)))
        .when(b == "Mauerwerk EG", F.when(umf, F.round(F.least(kg, ku + 0.05), 2)).otherwise(F.round(kg * 0.88, 2)))
        .otherwise(kg))
    layer = F.when(mat.rlike(r"hlz\s*\d+"), F.lit("waende")).when(mat.rlike("überlage|rolladen"), F.lit("oeffnungen")).when(
        frm.rlike("umfang|außenkante|frostgraben"), F.lit("konturen"))
    return d.withColumn("konfidenz", conf).withColumn("ebene", layer).drop("kg", "ku")


def material_list(rooms: DataFrame, openings: DataFrame, building: DataFrame, measured: DataFrame | None = None,
                  params: DataFrame | None = None, distribution: DataFrame | None = None, lengths: DataFrame | None = None,
                  layers: DataFrame | None = None, key: str = "projekt_id") -> DataFrame:
    """All material lines of all projects with confidence and plan layer."""
    base = base_geometry(rooms, openings, building, measured, params, key)
    cols = [key, "bauteil", "material", "einheit", "menge", "formel"]
    dry = base.filter(~F.col("stb")).select(key)
    out = masonry_lines(base, key).unionByName(concrete_lines(base, key)).unionByName(
        brick_lines(base, distribution, lengths, key).select(*cols)).unionByName(
        opening_hardware(openings, key).join(dry, key, "left_semi").select(*cols))
    if layers is not None:
        out = out.unionByName(floor_lines(rooms, layers, key).join(dry, key, "left_semi").select(*cols))
    return rate_confidence(out, base, key)


# --- corrections and inventory ------------------------------------------------------
NUDGE_MAX_CONFIDENCE, NUDGE_MAX_DEVIATION, NUDGE_CONFIDENCE = 0.80, 0.25, 0.60


def apply_corrections(lines: DataFrame, corrections: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Outcome per correction: rejected, flagged or applied.

    The target is the one estimated line of the part whose material contains the keyword.
    """
    elig = lines.filter(F.col("konfidenz") < NUDGE_MAX_CONFIDENCE).select(
        key, "bauteil", F.col("material").alias("t_mat"), F.col("menge").alias("t_menge"))
    parts = lines.select(key, "bauteil").distinct().withColumn("da", F.lit(True))
    j = corrections.join(parts, [key, "bauteil"], "left").join(elig, [key, "bauteil"], "left")
    hit = F.col("t_mat").isNotNull() & (F.col("k_material").isNull() | F.contains(F.lower("t_mat"), F.lower("k_material")))
    g = j.groupBy("korrektur_id", key, "bauteil", "soll_menge", "beleg").agg(
        F.bool_or("da").alias("da"), F.count_if(hit).alias("n"), F.max(F.when(hit, F.col("t_menge"))).alias("alt"),
        F.max(F.when(hit, F.col("t_mat"))).alias("material"))
    dev = F.abs(F.col("soll_menge") - F.col("alt")) / F.when(F.col("alt") > 0, F.col("alt"))
    status = (
        F.when(F.col("da").isNull(), F.lit("abgelehnt: Bauteil nicht in Liste"))
        .when(F.coalesce(F.trim("beleg"), F.lit("")) == "", F.lit("abgelehnt: kein Beleg"))
        .when(F.col("soll_menge").isNull(), F.lit("abgelehnt: Soll keine Zahl"))
        .when(F.col("soll_menge") <= 0, F.lit("abgelehnt: Soll ≤ 0"))
        .when(F.col("n") != 1, F.lit("abgelehnt: keine eindeutige Zielposition"))
        .when(F.col("alt") <= 0, F.lit("abgelehnt: Ist-Menge 0"))
        .when(dev > NUDGE_MAX_DEVIATION, F.lit("geflaggt")).otherwise(F.lit("angewandt")))
    ok = F.col("status") == "angewandt"
    return g.withColumn("status", status).withColumn("neu", F.when(ok, F.round("soll_menge", 2))).withColumn(
        "material", F.when(F.col("n") == 1, F.col("material"))).withColumn("alt", F.when(F.col("n") == 1, F.col("alt"))).drop("n", "da")


# fixed values: element type, keywords that cover it
INVENTORY_TYPES = {
    "saeule": "stütze|stuetze|säule|saeule|stahlbeton-stütz", "treppe": "treppe|stiege|podest|lauf",
    "kamin": "kamin|schornstein|fang", "unterzug": "unterzug|überzug|ueberzug|sturz|träger|traeger",
    "schacht": "schacht|aufzug|lift", "ringanker": "ringanker|ringbalken", "balkon": "balkon|podest|loggia|kragplatte",
}
INVENTORY_MIN_CONFIDENCE = 0.55


def inventory_type(text: Column) -> Column:
    t = F.lower(text)
    out = None
    for key, rx in INVENTORY_TYPES.items():
        cond = t.rlike(key + "|" + rx)
        out = F.when(cond, key) if out is None else out.when(cond, key)
    return out


def inventory_coverage(inventory: DataFrame, texts: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Seen elements whose type no list text of the project mentions (``gedeckt`` false).

    Texts are turned into the types they cover first, so the join carries at most seven
    rows per project.
    """
    seen = inventory.filter((F.col("konfidenz") >= INVENTORY_MIN_CONFIDENCE) & (F.coalesce(F.trim("beleg"), F.lit("")) != ""))
    seen = seen.withColumn("typ", inventory_type(F.col("typ_text"))).filter("typ is not null")
    t = F.lower("text")
    covered = texts.select(key, F.explode(F.array_compact(F.array(*[F.when(t.rlike(rx), F.lit(k)) for k, rx in INVENTORY_TYPES.items()]))).alias("typ"))
    covered = covered.distinct().withColumn("_c", F.lit(True))
    return seen.join(covered, [key, "typ"], "left").withColumn("gedeckt", F.coalesce("_c", F.lit(False))).drop("_c")


# --- roof ---------------------------------------------------------------------------
# fixed values
ROOF_AREA_RX = r"(?i)Dachfl[äa]+che[nr]?\s+([A-Za-zÄÖÜäöüß]+)\s*:?\s*(?:([\d.,]+)\s*[x×]\s*([\d.,]+)\s*=\s*)?([\d.,]+)\s*m[²2]"
ROOF_TIMBER_RX = (r"(?i)(?:(\d+)\s*[x×]?\s*)?(Sparren(?:abst[üu]tzung)?|Pfette[n]?|Mauerbank|Deckenbalken|Gratsparren|Schifter|"
                  r"Steher|Zange[n]?|Wechsel|Aufdoppelung)\s{0,3}B\s*/\s*H\s*:?\s*(\d+)\s*/\s*(\d+)\s*cm")
ROOF_LAYER_RX = r"(?m)^[\s\-–•]*([A-ZÄÖÜ][A-Za-zÄÖÜäöüß/\- ]{3,44}?)\s+([\d.,]+)\s*cm\s*$"
ROOF_FACTORS = {"latten": 3.3, "konter": 2.6, "unterspann": 1.15, "deckung": 1.05, "ueberstand_m": 0.50}


def roof_readings(pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Areas, timbers and layers found in page texts, duplicates folded (a calculation survives)."""
    from ..functions.numbers import german_number

    pg = pages.filter(F.lower("text").rlike("dach|sparren"))

    def groups(rx, n):
        """One struct of the pattern's groups per match: the text is searched once, groups are read from its matches."""
        found = F.regexp_extract_all("text", F.lit(rx), F.lit(0))
        return F.explode(F.transform(found, lambda t: F.struct(*[F.regexp_extract(t, rx, i).alias(f"g{i}") for i in range(1, n + 1)]))).alias("m")

    a = pg.select(key, "ord", groups(ROOF_AREA_RX, 4)).select(
        key, "ord", F.col("m.g1").alias("name"), german_number(F.col("m.g4"), clean=True).alias("m2"),
        F.when(F.col("m.g2") != "", F.concat_ws(" × ", "m.g2", "m.g3")).alias("rechnung"))
    # dealt out by page at once: the steps that follow group by page and shuffle no more
    areas = a.filter("m2 > 0 and m2 <= 5000").repartition(key).groupBy(key, F.lower("name").alias("nk"), "m2").agg(
        F.min_by("name", "ord").alias("name"), F.max("rechnung").alias("rechnung"))
    h = pg.select(key, groups(ROOF_TIMBER_RX, 4)).select(
        key, F.trim("m.g2").alias("bauteil"), F.coalesce(F.nullif("m.g1", F.lit("")).cast("int"), F.lit(1)).alias("anzahl"),
        F.col("m.g3").cast("int").alias("b_cm"), F.col("m.g4").cast("int").alias("h_cm")).distinct()
    l = pg.select(key, groups(ROOF_LAYER_RX, 2)).select(
        key, F.trim("m.g1").alias("material"), german_number(F.col("m.g2"), clean=True).alias("dicke_cm"))
    layers = l.filter(F.col("dicke_cm").between(0.1, 60)).repartition(key).groupBy(key, F.lower("material").alias("mk"), "dicke_cm").agg(F.min("material").alias("material"))
    return areas, h, layers


def roof_totals(areas: DataFrame, key: str) -> DataFrame:
    """Printed total, else the sum of parts; confirmed when both agree within 0.5 m²."""
    total = F.lower("name").contains("gesamt")
    g = areas.groupBy(key).agg(F.max(F.when(total, F.col("m2"))).alias("ges"), F.sum(F.when(~total, F.col("m2"))).alias("teile"))
    return g.select(key, F.coalesce("ges", F.round("teile", 2)).alias("gesamt_m2"),
                    F.when(F.col("ges").isNotNull() & F.col("teile").isNotNull(), F.abs(F.round("teile", 2) - F.col("ges")) <= 0.5).alias("bestaetigt"))


def roof_materials(totals: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """Covering, battens, underlay per roof area, plus insulation and boarding layers."""
    A = F.col("gesamt_m2")
    lines = [
        _ml("Dachdeckung", "Dacheindeckung", "m²", A * ROOF_FACTORS["deckung"], "Fläche × Verschnitt"),
        _ml("Dachlattung", "Dachlatten", "lfm", A * ROOF_FACTORS["latten"], "Fläche × lfm/m²"),
        _ml("Dachlattung", "Konterlatten", "lfm", A * ROOF_FACTORS["konter"], "Fläche × lfm/m²"),
        _ml("Unterdach", "Unterspannbahn", "m²", A * ROOF_FACTORS["unterspann"], "Fläche × Überlappung"),
    ]
    # a page is one row with its layers, so that totals are worked out once
    own = layers.groupBy(key).agg(F.collect_list(F.struct("material", "dicke_cm")).alias("_l"))

    def of_layer(layer: Column) -> Column:
        m = F.lower(layer["material"])
        not_roof = m.rlike("fassad|trennwand|trittschall|perimeter|estrich|sockel|kellerdeck|bodenplatt|innenputz|außenputz|aussenputz|wandputz|vorsatzschal")
        ins = m.rlike("dämmung|daemmung|mineralwolle|pur|xps|gefälle")
        name = F.concat(layer["material"], F.lit(" "), layer["dicke_cm"].cast("string"), F.lit("cm"))
        return F.array_compact(F.array(
            _ml("Dämmung", name, "m³", A * layer["dicke_cm"] / 100.0, "Fläche × Dicke", ~not_roof & ins),
            _ml("Schalung", name, "m²", A, "Fläche", ~not_roof & ~ins & m.contains("schalung"))))

    j = totals.filter(A > 0).join(own, key, "left")
    return j.select(key, F.inline(F.concat(F.array(*lines), F.coalesce(F.flatten(F.transform("_l", of_layer)), F.array()))))
