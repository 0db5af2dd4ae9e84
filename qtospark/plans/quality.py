"""Set-level quality rules.  Every rule yields the common finding schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mm_if_large  # noqa: F401  (public re-export for rule authors)
from ..functions.text import name_key

# --- fixed values -----------------------------------------------------------------
ROOM_AREA_RANGES = [
    ("wohnzimmer", 15.0, 45.0), ("wohnraum", 15.0, 45.0), ("wohn-ess", 20.0, 55.0), ("wohnkueche", 20.0, 55.0),
    ("schlafzimmer", 10.0, 25.0), ("kinderzimmer", 8.0, 20.0), ("badezimmer", 4.0, 15.0), ("bad", 4.0, 15.0),
    ("wc", 1.5, 5.0), ("toilette", 1.5, 5.0), ("kueche", 6.0, 20.0), ("flur", 3.0, 15.0), ("vorraum", 3.0, 15.0),
    ("vorzimmer", 3.0, 15.0), ("gang", 2.0, 20.0), ("diele", 3.0, 15.0), ("abstellraum", 1.0, 8.0),
    ("abstellkammer", 0.5, 6.0), ("lager", 2.0, 30.0), ("keller", 5.0, 50.0), ("garage", 12.0, 40.0),
    ("balkon", 3.0, 20.0), ("terrasse", 5.0, 40.0), ("loggia", 3.0, 15.0), ("buero", 8.0, 30.0),
    ("arbeitszimmer", 8.0, 20.0), ("hauswirtschaft", 3.0, 12.0), ("technik", 3.0, 15.0), ("technikraum", 3.0, 15.0),
    ("speis", 1.0, 6.0), ("speisekammer", 1.0, 6.0), ("ankleide", 3.0, 12.0), ("garderobe", 1.5, 8.0),
    ("waschkueche", 4.0, 15.0), ("sauna", 4.0, 12.0), ("fitness", 8.0, 30.0), ("hobbyraum", 10.0, 40.0),
]
INTERNAL_ROOMS = ["flur", "vorraum", "gang", "garderobe", "abstellraum", "speis", "speisekammer", "ar"]
WET_PREFIXES = ["bad", "wc", "dusche", "sauna", "waschküche", "waschkueche", "waschraum", "waschen"]
DRY_FLOORS = ["parkett", "laminat", "vinyl", "teppich"]
REQUIRED_TRADES = ["mauerwerk", "putz_innen", "maler", "bodenbelag", "estrich"]
WINDOW_LIMITS = {"max_area": 6.0, "max_h": 3000.0, "max_w": 4000.0, "min_w": 200.0, "max_sill": 1200.0}
DOOR_LIMITS = {"max_w": 2500.0, "min_w": 500.0, "min_h": 1800.0}


def finding(check: str, severity: str, when: Column, affected: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("schwere"), affected.alias("objekt")))


def _emit(df: DataFrame, keep: list[str], rules: list[Column]) -> DataFrame:
    """All row rules of a table in one pass."""
    return df.select(*keep, F.inline(F.array_compact(F.array(*rules))))


def height_findings(rooms: DataFrame) -> DataFrame:
    """Impossible and unusual heights per room, and wide scatter per project.

    The scatter is compared with its limit in whole micrometres, so that no order of summing decides at the limit
    (in doubles only for heights beyond 100 km).
    """
    h, name = F.col("hoehe_m"), F.col("name")
    r = rooms.filter("hoehe_m > 0")
    rows = _emit(r, ["projekt_id"], [
        finding("hoehen", "fehler", (h < 1.8) | (h > 5.0), name),
        finding("hoehen", "warnung", ~((h < 1.8) | (h > 5.0)) & ((h < 2.2) | (h > 4.0)), name),
    ])
    q = F.when(h < 1e5, F.rint(h * 1e6)).cast("decimal(12,0)")
    g = r.groupBy("projekt_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(q).alias("nq"), F.sum(q).alias("sq"), F.sum(q * q).alias("sqq"), F.stddev_samp("hoehe_m").alias("s"),
        F.min_by("name", F.struct("hoehe_m", "room_id")).alias("lo"), F.max_by("name", F.struct("hoehe_m", "room_id")).alias("hi"))
    n = F.col("n").cast("decimal(10,0)")
    wide = n * F.col("sqq") - F.col("sq") * F.col("sq") > F.lit(90_000_000_000) * n * (n - 1)  # variance above 0.30²
    wide = F.when(F.col("nq") == F.col("n"), wide).otherwise(F.col("s") > 0.30)
    spread = _emit(g, ["projekt_id"], [
        finding("hoehen_streuung", "info", (F.col("n") >= 3) & wide, F.concat_ws(" / ", "lo", "hi"))])
    return rows.unionByName(spread)


def area_balance(rooms: DataFrame, key: str = "projekt_id") -> DataFrame:
    """Mean indoor area above 35 m², or covered outside larger than 1.5 × inside.

    Areas are summed in whole cm², so that no order of summing decides at a limit.
    """
    f = F.rint(F.coalesce("flaeche_m2", F.lit(0.0)) * 10000).cast("long")
    inside, loggia = F.col("kategorie") == "Innenraum_warm", F.col("kategorie") == "Loggia"
    g = rooms.groupBy(key).agg(
        F.count(F.when(inside & (f > 0), f)).alias("n"), F.sum(F.when(inside, f)).alias("innen"),
        F.sum(F.when(loggia, f)).alias("loggia"))
    none = F.lit(None).cast("string")
    return _emit(g, [key], [
        finding("raum_summen", "warnung", (F.col("n") > 0) & (F.col("innen") > F.col("n") * 350000), none),
        finding("aussenkontur", "info", (F.col("innen") > 0) & (2 * F.col("loggia") > 3 * F.col("innen")), none)])


def rooms_without_window(rooms: DataFrame, windows: DataFrame) -> DataFrame:
    """Indoor rooms (no corridors) whose name neither contains nor is contained in a window's room.

    Names are reduced to the distinct ones of a project before the containment test, so
    its cost follows the vocabulary, not the rows.
    """
    nk = name_key(F.col("name"))
    internal = nk.rlike("^(" + "|".join(INTERNAL_ROOMS) + ")")
    r = rooms.filter((F.col("kategorie") == "Innenraum_warm") & ~internal).withColumn("nk", nk)
    names = r.select("projekt_id", "nk").distinct()
    w = windows.filter("raum <> ''").select("projekt_id", name_key(F.col("raum")).alias("wk")).distinct()
    seen = names.join(w, "projekt_id").filter(F.contains("nk", F.col("wk")) | F.contains("wk", F.col("nk"))).select("projekt_id", "nk").distinct()
    return r.join(seen, ["projekt_id", "nk"], "left_anti")


def wet_room_dry_floor(rooms: DataFrame) -> DataFrame:
    n = F.lower(F.coalesce("name", F.lit("")))
    return rooms.filter(n.rlike("^(" + "|".join(WET_PREFIXES) + ")") & F.lower("bodenbelag").isin(*DRY_FLOORS))


def cross_plan_conflicts(rooms: DataFrame, tol: float = 0.05) -> DataFrame:
    """Rooms read in two or more plans whose areas differ by more than ``tol``."""
    g = rooms.filter("flaeche_m2 > 0").groupBy("projekt_id", "wohnung", name_key(F.col("name")).alias("nk")).agg(
        F.count_distinct("plan_id").alias("n_plaene"), F.min("flaeche_m2").alias("f_min"), F.max("flaeche_m2").alias("f_max"))
    return g.filter((F.col("n_plaene") >= 2) & ((F.col("f_max") - F.col("f_min")) / F.col("f_max") > tol))


def room_plausibility(rooms: DataFrame) -> DataFrame:
    """Size range of the first room type contained in the name, and perimeter bounds."""
    n, f, u = F.lower("name"), F.coalesce("flaeche_m2", F.lit(0.0)), F.coalesce("umfang_m", F.lit(0.0))
    lo = hi = None
    for key, a, b in ROOM_AREA_RANGES:
        lo = F.when(n.contains(key), F.lit(a)) if lo is None else lo.when(n.contains(key), F.lit(a))
        hi = F.when(n.contains(key), F.lit(b)) if hi is None else hi.when(n.contains(key), F.lit(b))
    sq = 4.0 * F.sqrt(F.greatest(f, F.lit(0.0)))
    pos, rid = f > 0, F.col("room_id")
    return _emit(rooms, ["projekt_id"], [
        finding("flaeche_null", "KRITISCH", ~pos, rid),
        finding("flaeche_klein", "WARNUNG", pos & (f < 1.0), rid),
        finding("flaeche_gross", "WARNUNG", f > 100.0, rid),
        finding("unter_bereich", "WARNUNG", pos & (f < lo * 0.5), rid),
        finding("ueber_bereich", "WARNUNG", pos & (f > hi * 1.5), rid),
        finding("umfang_unmoeglich", "KRITISCH", pos & (u > 0) & (u < sq * 0.85), rid),
        finding("umfang_gross", "WARNUNG", pos & (u > sq * 3.0), rid)])


def opening_plausibility(openings: DataFrame) -> DataFrame:
    """Window and door size rules; sizes below 10 are metres."""
    mm = lambda c: F.when((F.col(c) > 0) & (F.col(c) < 10), F.col(c) * 1000.0).otherwise(F.coalesce(c, F.lit(0.0)))
    w, h, oid = mm("breite_m"), mm("hoehe_m"), F.col("opening_id")
    win, door = F.col("art") != "tuer", F.col("art") == "tuer"
    sill = F.col("fph_m") * 1000.0
    return _emit(openings, ["projekt_id"], [
        finding("fenster_breit", "WARNUNG", win & (w > WINDOW_LIMITS["max_w"]), oid),
        finding("fenster_hoch", "WARNUNG", win & (h > WINDOW_LIMITS["max_h"]), oid),
        finding("fenster_schmal", "WARNUNG", win & (w > 0) & (w < WINDOW_LIMITS["min_w"]), oid),
        finding("fenster_gross", "WARNUNG", win & (w / 1000.0 * (h / 1000.0) > WINDOW_LIMITS["max_area"]), oid),
        finding("parapet_negativ", "WARNUNG", win & (sill < 0), oid),
        finding("parapet_hoch", "HINWEIS", win & (sill > WINDOW_LIMITS["max_sill"]), oid),
        finding("tuer_breit", "WARNUNG", door & (w > DOOR_LIMITS["max_w"]), oid),
        finding("tuer_schmal", "WARNUNG", door & (w > 0) & (w < DOOR_LIMITS["min_w"]), oid),
        finding("tuer_niedrig", "WARNUNG", door & (h > 0) & (h < DOOR_LIMITS["min_h"]), oid)])


def calculation_consistency(positions: DataFrame, rooms: DataFrame) -> DataFrame:
    """Negative totals, floor and screed sums off by more than 10 %, missing sill position.

    Sums are exact, so that no order of summing makes a total of zero a positive one or decides at the limit.
    """
    exact = lambda c: F.sum(c.try_cast("decimal(28,10)")).cast("double")
    neg = _emit(positions, ["projekt_id"], [finding("negativ", "KRITISCH", F.col("endsumme") < 0, F.col("posnr"))])
    area = rooms.groupBy("projekt_id").agg(exact(F.when(F.col("flaeche_m2") > 0, F.col("flaeche_m2"))).alias("f"))
    s = positions.groupBy("projekt_id").agg(
        exact(F.when(F.col("gewerk") == "bodenbelag", F.col("endsumme"))).alias("belag"),
        exact(F.when(F.col("gewerk") == "estrich", F.col("endsumme"))).alias("estrich"),
        F.bool_or(F.col("gewerk").isin("fensterbank", "fensterbaenke")).alias("bank"))
    d = area.join(s, "projekt_id", "left")
    none = F.lit(None).cast("string")
    off = lambda c: (F.col("f") > 0) & (F.col(c) > 0) & (F.abs(F.col(c) - F.col("f")) / F.col("f") > 0.10)
    return neg.unionByName(_emit(d, ["projekt_id"], [
        finding("belag_summe", "WARNUNG", off("belag"), none), finding("estrich_summe", "WARNUNG", off("estrich"), none),
        finding("fensterbank_fehlt", "WARNUNG", ~F.coalesce("bank", F.lit(False)), none)]))


def completeness(rooms: DataFrame, positions: DataFrame) -> DataFrame:
    """Rooms without positions, and mandatory trades a room lacks."""
    per = positions.groupBy("room_id").agg(F.collect_set("gewerk").alias("da"))
    need = F.array(*[F.lit(x) for x in REQUIRED_TRADES])
    j = rooms.select("projekt_id", "room_id").join(per, "room_id", "left")
    miss = F.array_join(F.array_sort(F.array_except(need, "da")), ", ")
    return j.select(
        "projekt_id", "room_id",
        F.when(F.col("da").isNull(), F.lit("KRITISCH")).otherwise(F.lit("WARNUNG")).alias("schwere"),
        F.when(F.col("da").isNull(), F.lit("keine Positionen")).otherwise(miss).alias("fehlt"),
    ).filter("fehlt <> ''")


def severity_summary(findings: DataFrame) -> DataFrame:
    """Counts per severity, the worst one, and quality 100 − 15k − 5w − h in 0..100."""
    s = F.lower("schwere")
    g = findings.groupBy("projekt_id").agg(
        F.count_if(s.isin("kritisch", "fehler")).alias("kritisch"), F.count_if(s == "warnung").alias("warnung"),
        F.count_if(s.isin("hinweis", "info")).alias("hinweis"))
    q = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * F.col("kritisch") - 5 * F.col("warnung") - F.col("hinweis")))
    worst = F.when(F.col("kritisch") > 0, F.lit("kritisch")).when(F.col("warnung") > 0, F.lit("warnung")).otherwise(F.lit("hinweis"))
    return g.withColumn("schwere_max", worst).withColumn("qualitaet", q)


def quality_status(score: Column) -> Column:
    return F.when(score >= 80, F.lit("fertig")).when(score >= 60, F.lit("pruefen")).otherwise(F.lit("unvollstaendig"))


def tier(quelle: Column, verified: Column, manual: Column) -> Column:
    """Provenance tier of a room or field."""
    return (
        F.when(manual, F.lit("manual")).when((quelle == "text") & verified, F.lit("text"))
        .when(verified, F.lit("matched")).otherwise(F.lit("inferred")))
