"""Quantity core: rooms + openings + building data to bill-of-quantity lines.

Every trade is a set of line expressions.  All room lines come from one pass over the
rooms (an array of optional quantities, exploded), all deductions and reveals from one
pass over the openings, so adding a trade adds expressions and no scan or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import openings as op
from ..functions.numbers import sql_round
from ..functions.similarity import with_category
from ..functions.text import is_wet_room, name_key, room_key, tile_height, zero_to_null
from ..operators.assignment import assign_batches
from ..operators.ordering import ordinal
from ..operators.spatial import nearest
from ..session import cut

# --- fixed values -----------------------------------------------------------------
BUILDING_DEFAULTS = {
    "aussenwand_cm": 38.0,
    "innenwand_tragend_cm": 25.0,
    "innenwand_nichttragend_cm": 12.0,
    "decke_cm": 20.0,
    "bodenplatte_cm": 25.0,
    "geschosshoehe_m": 2.70,
    "tuer_breite_m": 0.90,
    "tuer_hoehe_m": 2.10,
}
HIGH_ROOM_M = 3.2
COLUMN_M3 = 0.5
TOPSOIL_M = 0.20
WORKSPACE_M = 0.8
DIG_CELLAR_M, DIG_FROST_M = 2.60, 0.50
GRAVEL_M = 0.15
TRADES = {
    "putz": "10", "rohbau": "08", "beton": "07", "estrich": "11", "maler": "46",
    "fliesen": "27", "fenster": "09", "daemmung": "44", "geruest": "04", "erdarbeiten": "02",
}
UNITS = {
    "putz": {"1.1": "m²", "1.1h": "m²", "1.1a": "lfm", "1.1b": "m²", "1.2": "m²", "1.3": "m²"},
    "rohbau": {"1.0": "m²", "1.1": "m²", "1.2": "m³", "1.3": "m³"},
    "beton": {"1.1": "m³", "1.2": "Stk"},
    "estrich": {"1.1": "m²", "1.2": "lfm"},
    "maler": {"1.1": "m²", "1.1h": "m²", "1.1a": "lfm", "1.1b": "m²", "1.2": "m²"},
    "fliesen": {"1.1": "m²", "1.2": "m²"},
    "fenster": {"1.1": "Stk", "1.2": "Stk", "1.3": "Stk"},
    "daemmung": {"1.1": "m²", "1.1a": "lfm", "1.1b": "m²"},
    "geruest": {"1.1": "m²"},
    "erdarbeiten": {"1.1": "m³", "1.2": "m³", "1.3": "m³", "1.4": "m³"},
}


def best_building(building: DataFrame, project: str = "projekt_id") -> DataFrame:
    """One building-data row per project: highest confidence, then rank, then plan."""
    cols = [c for c in building.columns if c != project]
    return (
        building.groupBy(project)
        .agg(F.max_by(F.struct(*cols), F.struct("konfidenz", "rang", "plan_id")).alias("b"))
        .select(project, "b.*")
    )


def fill_building(building: DataFrame) -> DataFrame:
    """Defaults for missing or non-positive values; ``quelle_<x>`` tells which were filled."""
    out = building
    for k, v in BUILDING_DEFAULTS.items():
        col = F.col(k) if k in building.columns else F.lit(None).cast("double")
        good = col > 0
        out = out.withColumn("quelle_" + k, F.when(good, F.lit("gemessen")).otherwise(F.lit("default")))
        out = out.withColumn(k, F.when(good, col).otherwise(F.lit(v)))
    return out


O_COLS = ("art", "o_b", "o_h", "fph_m", "wand_typ")
SMALL_SCOPE = 256  # rooms of a project that an opening looks through one by one
OPENINGS_SCOPE = 20_000  # openings of a project that one task numbers


def assign_openings(rooms: DataFrame, openings: DataFrame, scope: str = "projekt_id",
                    cap: float = 400.0, room_cols: tuple[str, ...] = (), opening_cols: tuple[str, ...] = ()) -> DataFrame:
    """``(opening_id, room_id, art_der_zuordnung)`` and the named columns of both sides.

    1. one room of that name in the scope - that one;
    2. several, opening has a position - the nearest of them;
    3. several, no position - in turn;
    4. no room of that name - the nearest room closer than ``cap``.

    Rooms and openings of a scope are dealt out together and meet there; so each side is shuffled
    once, and columns asked for here need no join by id afterwards.  Scopes with more than
    ``SMALL_SCOPE`` rooms or ``OPENINGS_SCOPE`` openings are searched by grid and numbered in two levels.
    """
    key = F.col(scope)
    r = rooms.select("room_id", key, "name", "cx", "cy", *[F.col(c).alias("_r_" + c) for c in room_cols])
    o = openings.select("opening_id", key, "cx", "cy", F.col("raum").alias("name"), *[F.col(c).alias("_o_" + c) for c in opening_cols])
    one = F.lit(1).cast("bigint")
    both = rooms.select(key, one.alias("_a"), F.lit(0).cast("bigint").alias("_b")).unionByName(
        openings.select(key, F.lit(0).cast("bigint").alias("_a"), one.alias("_b")))
    sizes = both.groupBy(scope).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    big = cut(sizes.filter((F.col("_a") > SMALL_SCOPE) | (F.col("_b") > OPENINGS_SCOPE)).select(scope))
    keep = ["opening_id", "room_id", "zuordnung"]
    large = None
    if not big.isEmpty():
        lr, lo = r.join(big, scope, "left_semi"), o.join(big, scope, "left_semi")
        large = _assign_large(lr.select("room_id", scope, name_key(F.col("name")).alias("nk"), "cx", "cy"),
                              lo.select("opening_id", scope, F.when(F.col("name") != "", name_key(F.col("name"))).alias("nk"), "cx", "cy"), scope, cap)
        if opening_cols:
            large = large.join(lo.select("opening_id", *[F.col("_o_" + c).alias(c) for c in opening_cols]), "opening_id")
        if room_cols:
            large = large.join(lr.select("room_id", *["_r_" + c for c in room_cols]), "room_id")
            large = large.select(*keep, *opening_cols, *[F.col("_r_" + c).alias(c) for c in room_cols])
        r, o = r.join(big, scope, "left_anti"), o.join(big, scope, "left_anti")

    j = assign_batches(r, o, scope, float(cap))
    out = j.select(*keep, *[F.col("_o_" + c).alias(c) for c in opening_cols], *[F.col("_r_" + c).alias(c) for c in room_cols])
    return out if large is None else out.unionByName(large.select(*keep, *opening_cols, *room_cols))


def _assign_large(r: DataFrame, o: DataFrame, scope: str, cap: float) -> DataFrame:
    """:func:`assign_openings` for scopes of any size: ``r`` and ``o`` have name keys and positions."""
    r = cut(r)  # narrow keys, written once: four branches read them
    names = r.groupBy(scope, "nk").agg(
        F.count(F.lit(1)).alias("n"), F.min("room_id").alias("one"), F.count("cx").alias("n_pos"))
    tagged = cut(o.join(names, [scope, "nk"], "left"))
    has_pos = F.col("cx").isNotNull() & F.col("cy").isNotNull()

    unique = tagged.filter("n = 1").select("opening_id", F.col("one").alias("room_id"), F.lit("name").alias("zuordnung"))
    # cases 2 and 4 are one search: rooms are offered under their name and under '*'
    search = tagged.filter(has_pos & (F.col("n").isNull() | ((F.col("n") > 1) & (F.col("n_pos") > 0))))
    search = search.withColumn("cap", F.when(F.col("n").isNull(), F.lit(float(cap))))
    search = search.withColumn("nk", F.when(F.col("n").isNull(), F.lit("*")).otherwise(F.col("nk")))
    offered = r.filter("cx is not null").withColumn("nk", F.explode(F.array(F.col("nk"), F.lit("*"))))
    near = nearest(search, offered, [scope, "nk"], "opening_id", "room_id", cap="cap")
    near = near.join(search.select("opening_id", "cap"), "opening_id").select(
        "opening_id", "room_id",
        F.when(F.col("cap").isNull(), F.lit("name_position")).otherwise(F.lit("position")).alias("zuordnung"))

    multi = tagged.filter("n > 1")
    turn = ordinal(multi.filter(~has_pos | (F.col("n_pos") == 0)).select("opening_id", scope, "nk", "n"),
                   [scope, "nk"], "opening_id", "i")
    seats = ordinal(r.join(names.filter("n > 1").select(scope, "nk"), [scope, "nk"], "left_semi")
                    .select("room_id", scope, "nk"), [scope, "nk"], "room_id", "seat")
    turn = (
        turn.withColumn("seat", F.col("i") % F.col("n")).join(seats, [scope, "nk", "seat"])
        .select("opening_id", "room_id", F.lit("reihum").alias("zuordnung"))
    )
    return unique.unionByName(near).unionByName(turn)


Line = tuple[tuple[str, str, str, str], Column]


def _line(trade: str, pos: str, kind: str, value: Column, when: Column | None = None) -> Line:
    """Head of a line, and its quantity where the row has such a line."""
    v = value.cast("double")
    return (trade, pos, UNITS[trade][pos], kind), (v if when is None else F.when(when, v))


def _explode(df: DataFrame, lines: list[Line], keep: list[str]) -> DataFrame:
    """A row per line of every row: quantities are one array, heads a constant looked up by place."""
    names = ("gewerk", "posnr", "einheit", "zeile")
    heads = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, head)]) for head, _ in lines])
    rows = df.select(*keep, F.posexplode(F.array(*[v for _, v in lines])).alias("_i", "wert")).filter("wert IS NOT NULL")
    return rows.select(*rows.columns[:-2], *[heads[F.col("_i")][n].alias(n) for n in names], "wert")


def _walls(trade: str, kind: str, value: Column, high: Column, when: Column) -> list[Line]:
    return [_line(trade, "1.1", kind, value, when & ~high), _line(trade, "1.1h", kind, value, when & high)]


def room_facts(rooms: DataFrame, building: DataFrame) -> DataFrame:
    """Rooms with category, wet flag, effective height and the project's building data."""
    bd = fill_building(building)
    b = bd.select("projekt_id", *[F.col(c).alias("b_" + c) for c in bd.columns if c != "projekt_id"])
    r = with_category(rooms).join(b, "projekt_id")
    return (
        r.withColumn("innen", F.coalesce(F.col("kategorie") == "Innenraum_warm", F.lit(False)))
        .withColumn("nass", is_wet_room(F.col("name")))
        .withColumn("u", zero_to_null(F.col("umfang_m")))
        .withColumn("f", zero_to_null(F.col("flaeche_m2")))
        .withColumn("h", F.coalesce(zero_to_null(F.col("hoehe_m")), F.col("b_geschosshoehe_m")))
        .withColumn("rkey", room_key(F.col("name"), F.col("wohnung"), F.col("geschoss"), F.col("flaeche_m2")))
    )


def trade_lines(rooms: DataFrame, openings: DataFrame, building: DataFrame,
                trades: list[str] | None = None, geschoss: str = "EG", by_room: bool = True) -> DataFrame:
    """All lines of the requested trades: ``projekt_id, rkey, gewerk, posnr, einheit, zeile, wert``.

    Without ``by_room`` no ``rkey`` is made: totals of projects need none, and it would travel with every room's place.
    ``building`` has one row per project; ``openings`` are windows and doors of one list.
    """
    trades = [t for t in TRADES if trades is None or t in trades]
    want = set(trades)
    facts = room_facts(rooms, building)
    if not by_room:
        facts = facts.withColumn("rkey", F.lit(None).cast("string"))
    bd = fill_building(building)
    parts: list[DataFrame] = []

    # --- one pass over the rooms
    innen, high = F.col("innen"), F.col("h") > HIGH_ROOM_M
    u, f, h = F.col("u"), F.col("f"), F.col("h")
    wall = u * h
    lines: list[Line] = []
    for t in ("putz", "maler"):
        if t in want:
            lines += _walls(t, "wand", wall, high, innen) + [_line(t, "1.2", "decke", f, innen)]
    if "rohbau" in want:
        slab = F.col("b_decke_cm") / 100.0
        no_slab = F.col("b_decke_m2").isNull() | (F.col("b_decke_m2") == 0)
        no_base = F.col("b_bodenplatte_m2").isNull() | (F.col("b_bodenplatte_m2") == 0)
        lines += [
            _line("rohbau", "1.1", "abwicklung", wall, innen),
            _line("rohbau", "1.2", "decke", f * slab, innen & no_slab),
            _line("rohbau", "1.2", "stiege", -f * slab, (F.col("kategorie") == "Stiegenhaus") & ~no_slab),
        ]
        if geschoss.upper() in ("EG", "KG", "UG"):
            lines.append(_line("rohbau", "1.3", "grundflaeche", f * F.col("b_bodenplatte_cm") / 100.0, innen & no_base))
    if "estrich" in want:
        lines += [_line("estrich", "1.1", "flaeche", f, innen), _line("estrich", "1.2", "rand", u, innen)]
    if "fliesen" in want:
        lines += [
            _line("fliesen", "1.1", "boden", f, F.col("nass")),
            _line("fliesen", "1.2", "wand", u * tile_height(F.col("name")), F.col("nass")),
        ]
    if lines:
        parts.append(_explode(facts, lines, ["projekt_id", "rkey"]))

    # --- deductions and reveals of assigned openings
    o = openings.withColumnsRenamed({"hoehe_m": "o_h", "breite_m": "o_b"})
    b_, h_ = F.coalesce("o_b", F.lit(0.0)), F.coalesce("o_h", F.lit(0.0))
    if want & {"putz", "maler"}:
        # all rooms take part in the assignment; lines come from those inside with a perimeter
        room = facts.withColumn("zaehlt", F.col("innen") & F.col("u").isNotNull())
        room = room.withColumn("rkey", F.when(F.col("zaehlt"), F.col("rkey")))
        j = assign_openings(room, o, room_cols=("projekt_id", "rkey", "h", "b_aussenwand_cm", "b_innenwand_tragend_cm", "zaehlt"),
                            opening_cols=O_COLS).filter("zaehlt")
        wall_t = op.wall_cm(F.col("wand_typ"), F.col("art"), F.col("b_aussenwand_cm"), F.col("b_innenwand_tragend_cm"))
        lines = []
        for t in ("putz", "maler"):
            if t in want:
                n = f"n_{t}"
                j = j.withColumn(n, op.net_opening(b_, h_, wall_t, F.col("fph_m"), op.threshold(t)))
                ded = F.col(f"{n}.abzug") > 0
                flat = F.col(f"{n}.tiefe") <= op.REVEAL_LINEAR_MAX_M
                lines += _walls(t, "abzug", -F.col(f"{n}.abzug"), high, ded)
                lines += [
                    _line(t, "1.1a", "leibung", F.col(f"{n}.abwicklung"), ded & flat),
                    _line(t, "1.1b", "leibung", F.col(f"{n}.laibung"), ded & ~flat),
                ]
        parts.append(_explode(j, lines, ["projekt_id", "rkey"]))
    if "fliesen" in want:
        wet = facts.filter("nass")
        j = assign_openings(wet, o, room_cols=("projekt_id", "rkey", "name", "u"), opening_cols=O_COLS).filter("u is not null")
        fph = F.coalesce("fph_m", F.lit(0.0))
        band = F.least(tile_height(F.col("name")), fph + h_) - F.greatest(F.lit(0.0), fph)
        cutout = F.round(b_ * band, 2)
        j = j.withColumn("cutout", F.when((b_ > 0) & (band > 0), cutout))
        parts.append(_explode(j, [_line("fliesen", "1.2", "abzug", -F.col("cutout"), F.col("cutout") >= 0.1)], ["projekt_id", "rkey"]))

    # --- façade: gross area per project minus outer openings
    aw = F.when(F.col("aussenwand_flaeche_m2") > 0, F.round("aussenwand_flaeche_m2", 2))
    hull = {"putz": ("1.3", "putz"), "rohbau": ("1.0", "rohbau"), "daemmung": ("1.1", "putz")}
    lines = [_line(t, p, "fassade", aw) for t, (p, _) in hull.items() if t in want]
    if "geruest" in want:
        lines.append(_line("geruest", "1.1", "geruest", aw))
    if "rohbau" in want:
        lines.append(_line("rohbau", "1.2", "decke_gesamt", F.col("decke_m2") * F.col("decke_cm") / 100.0, F.col("decke_m2") != 0))
        if geschoss.upper() in ("EG", "KG", "UG"):
            lines.append(_line("rohbau", "1.3", "platte", F.col("bodenplatte_m2") * F.col("bodenplatte_cm") / 100.0, F.col("bodenplatte_m2") != 0))
    if "beton" in want:
        lines += [
            _line("beton", "1.1", "stuetzen", F.col("anzahl_saeulen") * COLUMN_M3, F.col("anzahl_saeulen") > 0),
            _line("beton", "1.2", "kamine", F.col("anzahl_kamine"), F.col("anzahl_kamine") > 0),
        ]
    if lines:
        parts.append(_explode(bd, lines, ["projekt_id", F.lit(None).cast("string").alias("rkey")]))
    outer = [t for t in hull if t in want]
    if outer:
        hullrows = bd.filter("aussenwand_flaeche_m2 > 0").select("projekt_id", "aussenwand_cm")
        j = (
            openings.filter(op.is_outer_wall(F.col("wand_typ"), F.col("art")))
            .select("projekt_id", "art", "wand_typ", "fph_m", F.col("breite_m").alias("o_b"), F.col("hoehe_m").alias("o_h"))
            .join(hullrows, "projekt_id")
        )
        lines = []
        for t in outer:
            n = f"n_{t}"
            j = j.withColumn(n, op.net_opening(b_, h_, F.col("aussenwand_cm"), F.col("fph_m"), op.threshold(hull[t][1])))
            ded = F.col(f"{n}.abzug") > 0
            lines.append(_line(t, hull[t][0], "abzug", -F.col(f"{n}.abzug"), ded))
            if t == "daemmung":
                flat = F.col(f"{n}.tiefe") <= op.REVEAL_LINEAR_MAX_M
                lines += [
                    _line(t, "1.1a", "leibung", F.col(f"{n}.abwicklung"), ded & flat),
                    _line(t, "1.1b", "leibung", F.col(f"{n}.laibung"), ded & ~flat),
                ]
        parts.append(_explode(j, lines, ["projekt_id", F.lit(None).cast("string").alias("rkey")]))

    if "fenster" in want:
        pieces = opening_piece_list(openings)
        parts.append(pieces.select(
            "projekt_id", F.lit(None).cast("string").alias("rkey"), F.lit("fenster").alias("gewerk"), "posnr",
            F.lit("Stk").alias("einheit"), "zeile", F.col("anzahl").cast("double").alias("wert")))
    if "erdarbeiten" in want:
        parts.append(earthworks(facts, bd))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def opening_piece_list(openings: DataFrame) -> DataFrame:
    """Windows, outer doors and inner doors counted by size, with their codes."""
    door = F.col("art") == "tuer"
    outer = op.is_outer_wall(F.col("wand_typ"), F.col("art"))
    posnr = F.when(~F.coalesce(door, F.lit(False)), F.lit("1.1")).when(outer, F.lit("1.2")).otherwise(F.lit("1.3"))
    b = F.round(F.coalesce("breite_m", F.lit(0.0)), 2)
    h = F.round(F.coalesce("hoehe_m", F.lit(0.0)), 2)
    size = F.when((b != 0) & (h != 0), F.format_string("%.2f×%.2f m", F.col("b"), F.col("h"))).otherwise(F.lit("ohne Maß"))
    return (
        openings.select("projekt_id", "code", posnr.alias("posnr"), b.alias("b"), h.alias("h"))
        .groupBy("projekt_id", "posnr", "b", "h", "code").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("projekt_id", "posnr", "b", "h")
        .agg(F.sum("n").alias("anzahl"), F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("codes"))
        .withColumn("zeile", F.when((F.col("b") != 0) & (F.col("h") != 0), F.format_string("%.2f×%.2f m", "b", "h")).otherwise(F.lit("ohne Maß")))
    )


def earthworks(facts: DataFrame, bd: DataFrame) -> DataFrame:
    """Topsoil, excavation, gravel and backfill from the slab area and the outer perimeter."""
    g = F.upper(F.coalesce("geschoss", F.lit("")))
    cellar, ground = g.isin("KG", "UG"), g.isin("EG", "")
    counted = F.col("kategorie").isin("Innenraum_warm", "Nebenraum_kalt", "Stiegenhaus")
    area = F.when(counted, F.coalesce("f", F.lit(0.0))).otherwise(F.lit(0.0))
    base = facts.groupBy("projekt_id").agg(
        F.sum(F.when(cellar, area)).alias("f_kg"), F.sum(F.when(ground, area)).alias("f_eg"),
        F.bool_or(cellar).alias("keller"),
    )
    d = bd.join(base, "projekt_id", "left")
    slab = F.coalesce(
        F.when(F.col("bodenplatte_m2") != 0, F.col("bodenplatte_m2")),
        F.when(F.coalesce("keller", F.lit(False)), F.col("f_kg")).otherwise(F.col("f_eg")),
    )
    d = d.withColumn("slab", slab).filter("slab > 0")
    d = d.withColumn("umf", F.coalesce(F.when(F.col("aussenumfang_m") != 0, F.col("aussenumfang_m")), 4.0 * F.sqrt("slab")))
    d = d.withColumn("grube", F.col("slab") + F.col("umf") * WORKSPACE_M)
    dig = F.when(F.coalesce("keller", F.lit(False)), F.lit(DIG_CELLAR_M)).otherwise(F.lit(DIG_FROST_M))
    t = "erdarbeiten"
    return _explode(d, [
        _line(t, "1.1", "humus", F.col("grube") * TOPSOIL_M),
        _line(t, "1.2", "aushub", F.col("grube") * dig),
        _line(t, "1.3", "rollierung", F.col("slab") * GRAVEL_M),
        _line(t, "1.4", "hinterfuellung", F.col("umf") * WORKSPACE_M * dig),
    ], ["projekt_id", F.lit(None).cast("string").alias("rkey")])


def positions(lines: DataFrame, keys: tuple[str, ...] = ("projekt_id",)) -> DataFrame:
    """Position totals: each line rounded to 4 digits, summed per position.

    A total of such lines that is below half their last digit is zero: what doubles leave there, and its sign, are the order's.
    """
    p = lines.groupBy(*keys, "gewerk", "posnr", "einheit").agg(
        F.sum(sql_round(F.col("wert"), 4)).alias("endsumme"), F.count(F.lit(1)).alias("n_zeilen"))
    return p.withColumn("endsumme", F.when(F.abs("endsumme") < 0.00005, 0.0).otherwise(F.col("endsumme")))


def opening_schedule(openings: DataFrame, building: DataFrame, trade: str = "putz") -> DataFrame:
    """One checkable row per opening with the rule that was applied."""
    bd = fill_building(building).select("projekt_id", "aussenwand_cm", "innenwand_tragend_cm")
    limit = op.threshold(trade)
    b, h = F.coalesce("breite_m", F.lit(0.0)), F.coalesce("hoehe_m", F.lit(0.0))
    w = op.wall_cm(F.col("wand_typ"), F.col("art"), F.col("aussenwand_cm"), F.col("innenwand_tragend_cm"))
    return (
        openings.join(bd, "projekt_id")
        .withColumn("n", op.net_opening(b, h, w, F.col("fph_m"), limit))
        .select(
            "opening_id", "projekt_id", "raum", F.col("art").alias("typ"),
            F.when(op.is_outer_wall(F.col("wand_typ"), F.col("art")), F.lit("AW")).otherwise(F.lit("IW")).alias("wand"),
            F.round(b, 2).alias("breite_m"), F.round(h, 2).alias("hoehe_m"),
            F.col("n.flaeche").alias("flaeche_m2"),
            F.when(F.col("n.uebermessen"), F.lit("übermessen")).otherwise(F.lit("Abzug + Laibung")).alias("regel"),
            F.col("n.abzug").alias("abzug_m2"), F.col("n.laibung").alias("laibung_m2"),
            F.col("n.sohlbank").alias("sohlbank"),
        )
    )


def crosstab(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rooms × positions in long form, and the share of quantities anchored to a room."""
    skey = F.concat_ws("::", "gewerk", "posnr")
    cells = lines.groupBy("projekt_id", "rkey", skey.alias("skey")).agg(F.sum("wert").alias("menge"))
    per_cell = F.abs(F.col("menge"))
    free = lines.filter("rkey is null").groupBy("projekt_id").agg(F.sum(F.abs("wert")).alias("frei"))
    bound = cells.filter("rkey is not null").groupBy("projekt_id").agg(F.sum(per_cell).alias("verankert"))
    cover = bound.join(free, "projekt_id", "full").select(
        "projekt_id", F.coalesce("verankert", F.lit(0.0)).alias("verankert"), F.coalesce("frei", F.lit(0.0)).alias("frei"))
    total = F.col("verankert") + F.col("frei")
    cover = cover.withColumn("deckung_pct", F.when(total > 0, F.col("verankert") / total * 100.0).otherwise(F.lit(0.0)))
    return cells.filter("rkey is not null and abs(menge) >= 0.005"), cover


def crosstab_pivot(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Wide form for the given position keys (known from the catalogue, so no extra job)."""
    return cells.groupBy("projekt_id", "rkey").pivot("skey", keys).agg(F.sum("menge"))


# --- company-own positions ----------------------------------------------------------
# fixed values: rule id, unit, norm, formula
OWN_RULES = {
    "boden": ("m²", "ÖNORM B 2232", "Σ Raumfläche F"),
    "decke": ("m²", "ÖNORM B 2204", "Σ Raumfläche F (Deckenuntersicht)"),
    "wand_brutto": ("m²", "ÖNORM B 2204", "Σ (Umfang U × Höhe H)"),
    "wand_netto": ("m²", "ÖNORM B 2204", "Σ (U × H) − Öffnungen > Schwelle"),
    "umfang": ("m", "ÖNORM B 2204", "Σ Umfang U"),
    "sockel": ("m", "ÖNORM B 2232", "Σ (U − Σ Türbreiten des Raums)"),
}


def own_positions(rules: DataFrame, rooms: DataFrame, openings: DataFrame, building: DataFrame) -> DataFrame:
    """Company-own positions: ``rules(projekt_id, posnr, regel, raum_filter, verschnitt_pct)``.

    Unknown rules yield no quantity.  Waste is its own visible column, never hidden.
    ``raum_filter`` is a room name or null for all rooms.
    """
    b = fill_building(building).select("projekt_id", F.col("geschosshoehe_m").alias("h_def"), "aussenwand_cm", "innenwand_tragend_cm")
    r = (
        rooms.join(b, "projekt_id")
        .withColumn("u", zero_to_null(F.col("umfang_m"))).withColumn("f", zero_to_null(F.col("flaeche_m2")))
        .withColumn("h", F.coalesce(zero_to_null(F.col("hoehe_m")), F.col("h_def")))
    )
    o = openings.withColumnsRenamed({"hoehe_m": "o_h", "breite_m": "o_b"})
    j = assign_openings(r, o, room_cols=("aussenwand_cm", "innenwand_tragend_cm"), opening_cols=O_COLS)
    bb, hh = F.coalesce("o_b", F.lit(0.0)), F.coalesce("o_h", F.lit(0.0))
    w = op.wall_cm(F.col("wand_typ"), F.col("art"), F.col("aussenwand_cm"), F.col("innenwand_tragend_cm"))
    per_room = j.withColumn("n", op.net_opening(bb, hh, w, F.col("fph_m"), op.threshold(None))).groupBy("room_id").agg(
        F.sum("n.abzug").alias("abzug"), F.sum(F.when(F.col("art") == "tuer", bb)).alias("tuerbreite"))
    r = r.join(per_room, "room_id", "left")
    zero = F.lit(0.0)
    q = F.create_map(
        F.lit("boden"), F.col("f"), F.lit("decke"), F.col("f"), F.lit("umfang"), F.col("u"),
        F.lit("wand_brutto"), F.col("u") * F.col("h"),
        F.lit("wand_netto"), F.col("u") * F.col("h") - F.coalesce("abzug", zero),
        F.lit("sockel"), F.when(F.col("u").isNotNull(), F.greatest(zero, F.col("u") - F.coalesce("tuerbreite", zero))),
    )
    r = r.select("projekt_id", name_key(F.col("name")).alias("nk"), q.alias("q"))
    rl = rules.withColumn("fk", F.when(F.col("raum_filter") != "", name_key(F.col("raum_filter"))))
    x = rl.join(r, "projekt_id").filter(F.col("fk").isNull() | (F.col("fk") == F.col("nk")))
    x = x.withColumn("wert", F.try_element_at("q", F.col("regel"))).filter("wert is not null")
    out = x.groupBy("projekt_id", "posnr", "regel", "verschnitt_pct").agg(
        F.sum("wert").alias("menge"), F.count(F.lit(1)).alias("n_zeilen"))
    vp = F.greatest(F.coalesce("verschnitt_pct", zero), zero)
    return out.withColumn("verschnitt", F.col("menge") * vp / 100.0).withColumn("endsumme", F.col("menge") + F.col("verschnitt"))
