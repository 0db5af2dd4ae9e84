"""Name, token and category expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
CATEGORY_NAMES = {
    "Innenraum_warm": [
        "Wohnküche", "Wohnkueche", "Wohnen", "Wohnzimmer", "Wohnraum", "Esszimmer",
        "Zimmer", "Schlafzimmer", "Kinderzimmer", "Küche", "Kueche", "Bad", "WC",
        "Dusche", "Sauna", "Vorraum", "Vorzimmer", "Flur", "Gang", "Diele", "Garderobe",
        "Abstellraum", "Speis", "Speisekammer", "AR", "HWR", "HSR", "HAR",
        "Büro", "Buero", "Atelier", "Studio", "Praxis", "Arbeitszimmer",
        "Waschküche", "Waschkueche", "Waschraum", "Waschen", "Kiwa",
        "Windfang", "Foyer", "Eingang", "Eingangsbereich", "Fitness",
    ],
    "Loggia": ["Loggia", "Balkon", "Terrasse", "Parkplatz", "Carport"],
    "Stiegenhaus": ["Stiegenhaus", "Stiege", "STGH", "STG", "Treppenhaus"],
    "Nebenraum_kalt": [
        "Tiefgarage", "Garage", "Keller", "Kellerabteil", "Technik", "Technikraum",
        "Müllraum", "E-Technik", "Elektroraum", "Pelletslager", "Pelletslagerraum",
        "Fahrradraum", "Kinderwagenraum", "Schleuse", "Werkstätte", "Werkstatt", "Lager",
    ],
}
WET_ROOMS = [
    "Bad", "Badezimmer", "WC", "Dusche", "Duschbad", "Sauna", "Nassraum",
    "Waschküche", "Waschkueche", "Waschraum", "Waschen", "Kiwa", "Sanitär", "Sanitaer",
]
FUZZY_MIN_RATIO = 0.86
FUZZY_MIN_LEN = 4


def name_key(c: Column) -> Column:
    """Lower case without blanks, hyphens, underscores and slashes."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\-_/]+", "")


def fold_umlauts(c: Column) -> Column:
    out = F.lower(F.coalesce(c, F.lit("")))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def alnum_key(c: Column) -> Column:
    """Umlauts folded, only letters and digits kept."""
    return F.regexp_replace(fold_umlauts(c), r"[^a-z0-9]+", "")


def blank_to_null(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(F.trim(c), F.lit(""))


def zero_to_null(c: Column) -> Column:
    """Zero counts as missing in merges."""
    return F.when(c != 0, c)


def tokens(c: Column) -> Column:
    return F.filter(F.split(fold_umlauts(c), r"[^a-z0-9]+"), lambda t: t != "")


def trailing_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), r"(\d+)\s*$", 1), F.lit("")).cast("bigint")


def name_stem(c: Column) -> Column:
    """Name without its trailing number."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"\s*\d+\s*$", ""))


def head_noun(c: Column) -> Column:
    toks = F.filter(tokens(c), lambda t: ~t.rlike(r"^\d+$"))
    return F.when(F.size(toks) > 0, F.element_at(toks, -1))


def name_candidates(c: Column) -> Column:
    """Whole name, its first word, and its hyphen parts."""
    n = F.trim(c)
    first = F.when(F.contains(n, F.lit(" ")), F.split(n, r"\s+")[0])
    parts = F.when(
        F.contains(n, F.lit("-")), F.transform(F.split(n, "-"), lambda p: F.trim(p))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(n, first), parts))


def _is_one_of(names: list[str]):
    return lambda p: F.trim(p).isin(*names)


def category_exact(c: Column) -> Column:
    """First category (in catalogue order) with an exact candidate; null if none."""
    n = F.trim(c)
    first = F.substring_index(n, " ", 1)
    hyphen = F.contains(n, F.lit("-"))
    out = None
    for cat, names in CATEGORY_NAMES.items():
        part = F.exists(F.split(n, "-"), _is_one_of(names))
        hit = n.isin(*names) | first.isin(*names) | (hyphen & part)
        out = F.when(hit, cat) if out is None else out.when(hit, cat)
    return out


def is_wet_room(c: Column) -> Column:
    n = F.trim(F.coalesce(c, F.lit("")))
    parts = F.concat(
        F.array(n), F.split(n, r"\s+"), F.transform(F.split(n, "-"), lambda p: F.trim(p))
    )
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in WET_ROOMS]))


def tile_height(c: Column) -> Column:
    """Tile band: 1.5 m in a pure WC, else 2.0 m."""
    n = F.lower(c)
    wc = n.contains("wc") & ~n.contains("bad") & ~n.contains("dusch")
    return F.when(wc, F.lit(1.5)).otherwise(F.lit(2.0))


def room_key(name: Column, wohnung: Column, geschoss: Column, flaeche: Column) -> Column:
    e = F.lit("")
    return F.concat_ws(
        "|",
        F.coalesce(name, F.lit("?")),
        F.coalesce(wohnung, e),
        F.coalesce(geschoss, e),
        F.when(flaeche.isNotNull(), F.format_string("%.2f", flaeche)).otherwise(e),
    )


def perimeter_label(u: Column, quelle: Column) -> Column:
    """Evidence text of a perimeter: read, from the outline, or estimated."""
    return (
        F.when(quelle == "geschaetzt", F.concat(F.lit("U≈"), u, F.lit(" (geschätzt)")))
        .when(quelle == "geometrie", F.concat(F.lit("U≈"), u, F.lit(" (aus Umriss)")))
        .otherwise(F.concat(F.lit("U="), u))
    )


def storey_label(c: Column) -> Column:
    u = F.upper(F.trim(c))
    n = F.regexp_extract(u, r"^(\d*)\.?\s*OG(\d*)$", 1)
    m = F.regexp_extract(u, r"^(\d*)\.?\s*OG(\d*)$", 2)
    num = F.coalesce(F.nullif(n, F.lit("")), F.nullif(m, F.lit("")))
    return (
        F.when(c.isNull() | (F.trim(c) == ""), F.lit("ohne Geschoss"))
        .when(u == "EG", F.lit("Erdgeschoss"))
        .when(u.isin("KG", "UG"), F.lit("Kellergeschoss"))
        .when(u == "DG", F.lit("Dachgeschoss"))
        .when(u.rlike(r"^\d*\.?\s*OG\d*$"),
              F.concat_ws(". ", num, F.lit("Obergeschoss")))
        .otherwise(F.trim(c))
    )
