"""Domain tables derived from the star-schema test tables.

Each adapter is a list of ``(column, SQL expression)`` over one base table.  The
expressions use only the SQL subset that Spark and ANSI engines share, so one text
defines the table for the Spark job and for its SQL check.  An adapter never filters:
every base row becomes a domain row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession



# --- fixed values -----------------------------------------------------------------
ROOM_NAMES = [
    "Wohnzimmer", "Schlafzimmer", "Küche", "Bad", "WC", "Flur",
    "Vorraum", "Kinderzimmer 1", "Kinderzimmer 2", "Abstellraum", "Terrasse", "Loggia",
    "Stiegenhaus", "Keller", "Garage", "Technik", "Bad-WC", "Wohnküche",
    "Terasse", "Wiese", "Zimmer 3", "Büro", "Waschküche", "Galerie",
]
FLOORS = ["Parkett", "Fliesen", "Laminat", None, "Naturstein"]
STOREYS = ["EG", "OG1", "KG", "OG2"]
MATERIALS = [
    "HLZ 50 Plan", "XPS-SF G30 120", "Schaltafel 3SO", "Noppenfolie 1m",
    "HLZ 25 Plan", "HLZ 12 Plan", "Beton C25/30", "Baustahl AQ 50",
]
PARTS = ["Mauerwerk EG", "Bodenplatte", "Decke über EG", "Frostschürze"]
UNITS = ["m²", "m³", "lfm", "Stk"]


def pick(expr: str, values: list) -> str:
    """``CASE`` expression choosing the i-th value."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"(CASE {expr} {arms} END)"


L_ID = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
    "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || "
    "CAST(CAST(round(l_extendedprice * 100.0) AS BIGINT) AS STRING)"
)
PROJECT = "(l_orderkey - l_orderkey % 8)"
FIRM = "((l_orderkey - l_orderkey % 8) % 97)"
AREA = "round(l_quantity * 0.7 + 2.0, 1)"

ADAPTERS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "plans": ("orders", [
        ("plan_id", "o_orderkey"),
        ("projekt_id", "(o_orderkey - o_orderkey % 8)"),
        ("firma_id", "((o_orderkey - o_orderkey % 8) % 97)"),
        ("geschoss", pick("CAST(o_orderkey % 4 AS INT)", STOREYS)),
        ("status", "(CASE o_orderstatus WHEN 'F' THEN 'fertig' WHEN 'O' THEN 'neu' ELSE 'fehler' END)"),
        ("konfidenz", "round((o_orderkey * 37 % 101) / 100.0, 2)"),
        ("inhalt", "CAST(o_custkey % 400 AS STRING) || ':' || o_orderpriority"),
        ("dateiname", "'plan_' || CAST(o_custkey AS STRING) || (CASE WHEN o_orderkey % 5 = 0 THEN ' (1)' ELSE '' END) || '.pdf'"),
        ("erstellt_am", "o_orderdate"),
    ]),
    "rooms": ("lineitem", [
        ("room_id", L_ID),
        ("firma_id", FIRM),
        ("projekt_id", PROJECT),
        ("plan_id", "l_orderkey"),
        ("seite", "CAST(l_linenumber % 3 + 1 AS BIGINT)"),
        ("name", pick("CAST(l_partkey % 24 AS INT)", ROOM_NAMES)),
        ("wohnung", "'TOP ' || CAST(1 + l_suppkey % 3 AS STRING)"),
        ("geschoss", pick("CAST(l_orderkey % 4 AS INT)", STOREYS)),
        ("flaeche_m2", f"(CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 24 = 19 THEN {AREA} * 6.0 WHEN l_partkey % 24 = 14 THEN {AREA} * 4.0 ELSE {AREA} END)"),
        ("umfang_m", f"(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE round(4.0 * sqrt({AREA}) * (1.0 + l_discount), 2) END)"),
        ("hoehe_m", "(CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 29 = 3 THEN 5.2 ELSE round(2.3 + (l_linenumber % 5) * 0.1 + (l_suppkey % 10) * 0.08, 2) END)"),
        ("bodenbelag", pick("CAST(l_suppkey % 5 AS INT)", FLOORS)),
        ("umfang_quelle", "(CASE l_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'geometrie' ELSE 'geschaetzt' END)"),
        ("cx", "(l_partkey % 40) * 25.0 + l_suppkey % 7"),
        ("cy", "(l_suppkey % 30) * 25.0 + l_partkey % 5"),
        ("konfidenz", "round(1.0 - l_discount * 4.0, 2)"),
        ("quelle", "(CASE WHEN l_linestatus = 'F' THEN 'text' ELSE 'vision' END)"),
        ("ok_f", "(l_partkey % 4 <> 1)"),
        ("ok_u", "(l_partkey % 5 <> 2)"),
        ("ok_h", "(l_suppkey % 3 <> 0)"),
        ("erstellt_am", "l_shipdate"),
    ]),
    "openings": ("lineitem", [
        ("opening_id", f"'O' || {L_ID}"),
        ("firma_id", FIRM),
        ("projekt_id", PROJECT),
        ("plan_id", "l_orderkey"),
        ("geschoss", pick("CAST(l_orderkey % 4 AS INT)", STOREYS)),
        ("art", "(CASE WHEN l_returnflag = 'R' THEN 'tuer' ELSE 'fenster' END)"),
        ("raum", "(CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE " + pick("CAST((l_partkey + l_linenumber) % 24 AS INT)", ROOM_NAMES) + " END)"),
        ("code", "(CASE WHEN l_suppkey % 4 = 3 THEN NULL ELSE 'FE_' || CAST(l_partkey % 50 AS STRING) END)"),
        ("breite_m", "(CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE round(0.6 + (l_partkey % 23) * 0.1, 2) END)"),
        ("hoehe_m", "(CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE round(0.6 + (l_suppkey % 19) * 0.1, 2) END)"),
        ("fph_m", "round((l_linenumber % 4) * 0.3, 2)"),
        ("wand_typ", "(CASE l_suppkey % 3 WHEN 0 THEN 'AW' WHEN 1 THEN 'IW' ELSE NULL END)"),
        ("cx", "(CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (l_partkey % 37) * 27.0 + 3.0 END)"),
        ("cy", "(CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (l_suppkey % 28) * 26.0 + 5.0 END)"),
        ("konfidenz", "round(1.0 - l_tax * 5.0, 2)"),
        ("quelle", "(CASE WHEN l_linestatus = 'F' THEN 'text' ELSE 'vision' END)"),
    ]),
    "building": ("orders", [
        ("plan_id", "o_orderkey"),
        ("projekt_id", "(o_orderkey - o_orderkey % 8)"),
        ("firma_id", "((o_orderkey - o_orderkey % 8) % 97)"),
        ("geschoss", pick("CAST(o_orderkey % 4 AS INT)", STOREYS)),
        ("aussenwand_cm", "(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 38.0 + (o_custkey % 2) * 12.0 END)"),
        ("innenwand_tragend_cm", "(CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 25.0 END)"),
        ("decke_cm", "(CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 18.0 + o_custkey % 5 END)"),
        ("bodenplatte_cm", "(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 25.0 + o_custkey % 3 END)"),
        ("geschosshoehe_m", "(CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE round(2.6 + (o_custkey % 5) * 0.1, 2) END)"),
        ("aussenwand_flaeche_m2", "(CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE round(120.0 + o_custkey % 200, 1) END)"),
        ("aussenumfang_m", "(CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE round(30.0 + o_custkey % 40, 1) END)"),
        ("bodenplatte_m2", "(CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE round(80.0 + o_custkey % 120, 1) END)"),
        ("decke_m2", "(CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE round(85.0 + o_custkey % 120, 1) END)"),
        ("anzahl_saeulen", "o_custkey % 4"),
        ("anzahl_kamine", "o_custkey % 3"),
        ("quelle_h", "(CASE o_custkey % 4 WHEN 0 THEN 'schnitt' WHEN 1 THEN 'legende' WHEN 2 THEN 'vision' ELSE 'default' END)"),
        ("konfidenz", "round((o_orderkey * 53 % 101) / 100.0, 2)"),
        ("rang", "o_orderkey * 7 % 13"),
    ]),
    "readings": ("lineitem", [
        ("entity_id", "l_partkey"),
        ("reading_id", L_ID),
        ("lesung", "(CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE CAST(l_linenumber + l_suppkey % 2 AS DOUBLE) END)"),
        ("mass_m", "round(1.0 + (l_suppkey % 9) * 0.03, 2)"),
        ("quelle", "(CASE l_suppkey % 5 WHEN 0 THEN 'legende' WHEN 1 THEN 'schnitt' WHEN 2 THEN 'vision' WHEN 3 THEN 'urteil' ELSE 'text' END)"),
        ("quelle_typ", "(CASE WHEN l_suppkey % 5 IN (0, 1, 4) THEN 'text' ELSE 'vision' END)"),
        ("wert", "round(2.4 + (l_partkey % 10) * 0.05 + (CASE WHEN l_suppkey % 11 = 0 THEN 0.3 ELSE (l_suppkey % 3) * 0.02 END), 2)"),
        ("kategorie", "(CASE l_suppkey % 13 WHEN 0 THEN 'Flachdach' ELSE 'Satteldach' END)"),
        ("konfidenz", "round(1.0 - l_discount * 4.0, 2)"),
        ("ord", "l_orderkey"),
        ("lauf", "CAST(l_linenumber AS BIGINT)"),
    ]),
    "corrections": ("events", [
        ("korrektur_id", "event_id"),
        ("firma_id", "user_id % 20"),
        ("buero", "'B' || CAST(user_id % 60 AS STRING)"),
        ("user_id", "user_id"),
        ("feld", "(CASE event_type WHEN 'click' THEN 'breite_m' WHEN 'view' THEN 'bodenbelag' WHEN 'purchase' THEN 'flaeche_m2' WHEN 'signup' THEN 'raumname' ELSE 'sonstiges' END)"),
        ("alter_wert", "(CASE event_type WHEN 'click' THEN CAST(event_id % 5 AS STRING) || ',50' WHEN 'view' THEN 'Parkett' ELSE 'alt' || CAST(event_id % 3 AS STRING) END)"),
        ("neuer_wert", "(CASE event_type WHEN 'click' THEN CAST(event_id % 4 AS STRING) || '.5' WHEN 'view' THEN 'Fliesen' ELSE 'neu' || CAST(event_id % 4 AS STRING) END)"),
        ("grund", "(CASE event_id % 6 WHEN 0 THEN 'Einheit in cm gelesen' WHEN 1 THEN 'Raum falsch zugeordnet' WHEN 2 THEN 'fehlt im Plan' WHEN 3 THEN 'Abzug vergessen' ELSE '' END)"),
        ("wert", "value"),
        ("ts", "ts"),
    ]),
    "measurements": ("lineitem", [
        ("messung_id", L_ID),
        ("projekt_id", PROJECT),
        ("position_id", "(CASE WHEN l_suppkey % 12 = 0 THEN NULL ELSE CAST(" + PROJECT + " AS STRING) || ':' || CAST(l_suppkey % 5 AS STRING) END)"),
        ("typ", pick("CAST(l_partkey % 9 AS INT)", ["flaeche", "abzug", "laenge", "stueck", "volumen", "bauteil", "treppe", "dach", "wandflaeche"])),
        ("status", "(CASE WHEN l_partkey % 10 = 3 THEN 'verworfen' WHEN l_partkey % 10 < 6 THEN 'aktiv' ELSE 'vorschlag' END)"),
        ("quelle", "(CASE WHEN l_linestatus = 'F' THEN 'ki' ELSE 'mensch' END)"),
        ("x", "(l_partkey % 50) * 10.0"),
        ("y", "(l_suppkey % 50) * 10.0"),
        ("w", "20.0 + l_quantity * 4.0"),
        ("h", "20.0 + (l_suppkey % 15) * 8.0"),
        ("schief", "(CASE WHEN l_partkey % 6 = 0 THEN 15.0 ELSE 0.0 END)"),
        ("hoehe_m", "(CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE round(2.4 + (l_suppkey % 6) * 0.1, 2) END)"),
        ("neigung_grad", "(CASE WHEN l_suppkey % 9 = 0 THEN 0.0 ELSE 10.0 + l_suppkey % 40 END)"),
        ("geschlossen", "(l_linenumber % 2 = 0)"),
        ("ptm", "28.35"),
        ("stempel_f", "(CASE WHEN l_suppkey % 3 = 0 THEN round(l_quantity * 0.7, 2) ELSE NULL END)"),
        ("erstellt_am", "l_shipdate"),
    ]),
    "quantities": ("lineitem", [
        ("firma_id", "l_suppkey % 20"),
        ("list_id", "l_suppkey"),
        ("line_id", L_ID),
        ("bauteil", pick("CAST(l_partkey % 4 AS INT)", PARTS)),
        ("material", "(CASE l_partkey % 4 WHEN 0 THEN 'HLZ 50 Plan' WHEN 1 THEN 'XPS-SF G30 120' WHEN 2 THEN 'Schaltafel 3SO' ELSE 'Noppenfolie 1m' END)"),
        ("einheit", "(CASE l_partkey % 4 WHEN 0 THEN 'Paletten' WHEN 1 THEN 'm²' WHEN 2 THEN 'm2' ELSE 'lfm' END)"),
        ("ist_menge", "l_quantity"),
        ("soll_menge", "round(l_quantity * (0.8 + (l_suppkey % 9) * 0.1 + l_discount), 2)"),
        ("soll_bez", "(CASE l_partkey % 4 WHEN 0 THEN 'HLZ ' || CAST((CASE l_linenumber % 4 WHEN 0 THEN 50 WHEN 1 THEN 38 WHEN 2 THEN 25 ELSE 12 END) AS STRING) || 'cm Plan' WHEN 1 THEN 'Dämmung XPS-SF G30 120' WHEN 2 THEN 'Schaltafel 3SO' ELSE 'Noppenfolie 1m' END)"),
    ]),
    "segments": ("lineitem", [
        ("segment_id", L_ID),
        ("plan_id", PROJECT),
        ("seite", "CAST(1 AS BIGINT)"),
        ("achse", "(CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END)"),
        ("pos", "(l_partkey % 30) * 4.0"),
        ("lo", "(l_suppkey % 25) * 10.0"),
        ("hi", "(l_suppkey % 25) * 10.0 + 15.0 + l_quantity * 2.0"),
        ("breite", "round(0.12 + (l_linenumber % 4) * 0.12, 2)"),
        ("grau", "round((l_partkey % 5) * 0.2, 1)"),
    ]),
}

DOUBLES = {
    "flaeche_m2", "umfang_m", "hoehe_m", "breite_m", "fph_m", "cx", "cy", "konfidenz",
    "aussenwand_cm", "innenwand_tragend_cm", "decke_cm", "bodenplatte_cm", "geschosshoehe_m",
    "aussenwand_flaeche_m2", "aussenumfang_m", "bodenplatte_m2", "decke_m2", "mass_m", "wert",
    "lesung", "x", "y", "w", "h", "schief", "neigung_grad", "ptm", "stempel_f", "ist_menge",
    "soll_menge", "pos", "lo", "hi", "breite", "grau",
}

# spans: a room stamp (name, area, perimeter, height) and a window code per base row
SPAN_PLAN = PROJECT
SPAN_X = "((l_partkey % 23) * 43.0 + l_suppkey % 11)"
SPAN_Y = "((l_suppkey % 29) * 37.0 + l_partkey % 7)"
SPOT_X = "((l_partkey % 8) * 90.0 + l_suppkey % 23)"
SPOT_Y = "((l_suppkey % 6) * 80.0 + l_partkey % 29)"
SPAN_KINDS: list[tuple[str, str, str, str, str]] = [
    # kind, text, x, y, size
    ("name", pick("CAST(l_partkey % 24 AS INT)", ROOM_NAMES), SPAN_X, SPAN_Y, "9.0"),
    ("flaeche", "'F: ' || replace(CAST(CAST(l_quantity * 0.7 + 2.0 AS DECIMAL(10,2)) AS STRING), '.', ',') || ' m²'", f"{SPAN_X} + 4.0", f"{SPAN_Y} + 12.0", "7.0"),
    ("umfang", "'U: ' || replace(CAST(CAST(l_quantity * 0.3 + 6.0 AS DECIMAL(10,2)) AS STRING), '.', ',') || ' m'", f"{SPAN_X} + 4.0", f"{SPAN_Y} + 20.0", "7.0"),
    ("hoehe", "'RH=' || replace(CAST(CAST(2.4 + (l_linenumber % 5) * 0.1 AS DECIMAL(10,2)) AS STRING), '.', ',')", f"{SPAN_X} + 5.0", f"{SPAN_Y} + 28.0", "7.0"),
    ("mass", "(CASE WHEN l_suppkey % 3 = 0 THEN replace(CAST(CAST(0.6 + (l_partkey % 25) * 0.1 AS DECIMAL(10,2)) AS STRING), '.', ',') ELSE CAST(60 + (l_partkey % 40) * 10 AS STRING) END)", SPOT_X, SPOT_Y, "6.0"),
    ("code", "(CASE l_suppkey % 5 WHEN 0 THEN (CASE WHEN l_partkey % 3 = 0 THEN 'FPH ' || CAST(10 + l_partkey % 90 AS STRING) ELSE 'FPH 0,' || CAST(l_partkey % 10 AS STRING) || '0' END) WHEN 1 THEN (CASE WHEN l_partkey % 3 = 0 THEN 'STUK 2' || CAST(10 + l_partkey % 90 AS STRING) ELSE 'STUK 2,' || CAST(l_partkey % 10 AS STRING) || '0' END) WHEN 2 THEN 'AW' || CAST(l_partkey % 9 AS STRING) WHEN 3 THEN 'TOP ' || CAST(l_partkey % 9 AS STRING) ELSE (CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END) || CAST(l_partkey % 9 AS STRING) || ',' || CAST(10 + l_linenumber * 11 AS STRING) END)", f"{SPOT_X} + 9.0", f"{SPOT_Y} + 7.0", "5.0"),
]
_SPAN_COLS = ["span_id", "plan_id", "seite", "art", "text", "x0", "y0", "size", "ord"]


def _span_exprs(kind, text, x, y, size):
    return [
        f"{L_ID} || ':{kind}'", SPAN_PLAN, "CAST(l_linenumber % 3 + 1 AS BIGINT)", f"'{kind}'",
        text, x, y, size, "l_partkey * 10 + l_linenumber",
    ]


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spans(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """Text spans; ``kinds`` builds only those kinds of span.

    One arm per kind over the same dealt-out rows: all kinds in one expression would be a generated
    method too long for the JVM to compile, and run many times slower.
    """
    used = base(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # dealt out evenly while rows are narrow: each becomes six, which are parsed as text
    even = used.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = None
    for spec in SPAN_KINDS:
        if kinds is None or spec[0] in kinds:
            arm = even.selectExpr(*[
                f"{('CAST(' + e + ' AS DOUBLE)') if c in ('x0', 'y0', 'size') else e} AS {c}"
                for c, e in zip(_SPAN_COLS, _span_exprs(*spec))
            ])
            out = arm if out is None else out.unionByName(arm)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Domain table ``name`` as a DataFrame (one scan, projection only)."""
    if name == "spans":
        return spans(spark, sf_dir)
    src, cols = ADAPTERS[name]
    raw = base(spark, sf_dir, src)
    text = " ".join(e for _, e in cols)
    used = [c for c in raw.columns if c in text]
    return raw.select(*used).selectExpr(*[f"{_typed(e, c)} AS {c}" for c, e in cols])


def _typed(expr: str, col: str) -> str:
    # quantities are doubles: the domain never uses decimals
    return f"CAST({expr} AS DOUBLE)" if col in DOUBLES else expr


def cte(*names: str) -> str:
    """``WITH`` clause that defines the same domain tables for the SQL check."""
    out = []
    for name in names:
        if name == "spans":
            arms = []
            for spec in SPAN_KINDS:
                cols = ", ".join(
                    f"{('CAST(' + e + ' AS DOUBLE)') if c in ('x0', 'y0', 'size') else e} AS {c}"
                    for c, e in zip(_SPAN_COLS, _span_exprs(*spec))
                )
                arms.append(f"SELECT {cols} FROM lineitem")
            out.append("spans AS (" + " UNION ALL ".join(arms) + ")")
        else:
            src, cols = ADAPTERS[name]
            sel = ", ".join(f"{_typed(e, c)} AS {c}" for c, e in cols)
            out.append(f"{name} AS (SELECT {sel} FROM {src})")
    return "WITH " + ",\n".join(out)
