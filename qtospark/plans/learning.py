"""Rules learned from corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
OFFICE_MIN, GLOBAL_MIN = 2, 5
FIELD_TYPES = [
    ("bezeichnung", "FENSTER_NOTATION"), ("fenster_bezeichnung", "FENSTER_NOTATION"), ("fenster_typ", "FENSTER_NOTATION"),
    ("raum_name", "RAUM_ZUORDNUNG"), ("raum_bezeichnung", "RAUM_ZUORDNUNG"), ("raum_referenz", "RAUM_ZUORDNUNG"),
    ("raum_zuordnung", "RAUM_ZUORDNUNG"), ("massstab", "MASSSTAB_KORREKTUR"), ("skalierung", "MASSSTAB_KORREKTUR"),
    ("abzug", "ABZUGS_REGEL"), ("abzugsregel", "ABZUGS_REGEL"), ("abzug_faktor", "ABZUGS_REGEL"),
    ("wandstaerke", "WANDSTAERKE"), ("wand_staerke", "WANDSTAERKE"),
    ("text", "TEXT_KORREKTUR"), ("ocr", "TEXT_KORREKTUR"), ("extraktion", "TEXT_KORREKTUR"),
]
REASON_TYPES = [
    (["fenster", "fe_", "fe ", "fensterbez"], "FENSTER_NOTATION"), (["raum", "zimmer", "bezeichnung"], "RAUM_ZUORDNUNG"),
    (["massstab", "skalierung", "faktor"], "MASSSTAB_KORREKTUR"), (["abzug", "oeffnung", "oenorm"], "ABZUGS_REGEL"),
    (["wand", "staerke", "dicke"], "WANDSTAERKE"), (["text", "ocr", "erkennung", "lesen"], "TEXT_KORREKTUR"),
]


def error_type(field: Column, reason: Column) -> Column:
    f, g = F.lower(F.coalesce(field, F.lit(""))), F.lower(F.coalesce(reason, F.lit("")))
    out = None
    for key, typ in FIELD_TYPES:
        out = F.when(f.contains(key), typ) if out is None else out.when(f.contains(key), typ)
    for words, typ in REASON_TYPES:
        out = out.when(g.rlike("|".join(words)), typ)
    return out.otherwise(F.lit("TEXT_KORREKTUR"))


def _plain(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("string"), c, F.lit(""))


def signature(field: Column, old: Column, new: Column) -> Column:
    return F.concat(F.coalesce(field, F.lit("unbekannt")), F.lit("::"), _plain(old), F.lit("->"), _plain(new))


def instruction(typ: Column, old: Column, new: Column) -> Column:
    return (
        F.when(typ == "FENSTER_NOTATION", F.format_string("Interpretiere '%s' als '%s' bei Fensterbezeichnungen", old, new))
        .when(typ == "RAUM_ZUORDNUNG", F.format_string("Ordne '%s' als '%s' zu", old, new))
        .when(typ == "MASSSTAB_KORREKTUR", F.format_string("Verwende Massstab-Korrekturfaktor: %s -> %s", old, new))
        .when(typ == "WANDSTAERKE", F.format_string("Verwende Wandstaerke %s statt Standard %s", new, old))
        .when(typ == "ABZUGS_REGEL", F.format_string("Abzugsregel anpassen: %s -> %s", old, new))
        .otherwise(F.format_string("Korrigiere '%s' zu '%s'", old, new))
    )


def pattern_rules(corrections: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Office rules from more than two equal corrections, global ones from more than five.

    Signatures already known (``existing(signatur, buero)``) give no new rule.
    """
    c = corrections.withColumn("signatur", signature(F.col("feld"), F.col("alter_wert"), F.col("neuer_wert")))
    first = F.struct("korrektur_id")
    cols = [F.count(F.lit(1)).alias("n"), F.min_by(F.struct("feld", "grund", "alter_wert", "neuer_wert"), first).alias("b")]
    per_office = c.filter("buero <> ''").groupBy("buero", "signatur").agg(*cols)
    # the global counts come from the office counts, not from the rows again
    offices = per_office.filter(F.col("n") > OFFICE_MIN)
    everywhere = c.groupBy("signatur").agg(*cols).filter(F.col("n") > GLOBAL_MIN)
    everywhere = everywhere.join(offices.select("signatur").distinct(), "signatur", "left_anti")
    rules = (
        offices.withColumn("global", F.lit(False)).withColumn("konfidenz", F.round(F.least(F.lit(0.95), 0.5 + F.col("n") * 0.1), 2))
        .unionByName(
            everywhere.withColumn("buero", F.lit("")).withColumn("global", F.lit(True))
            .withColumn("konfidenz", F.round(F.least(F.lit(0.98), 0.6 + F.col("n") * 0.05), 2)))
    )
    typ = error_type(F.col("b.feld"), F.col("b.grund"))
    rules = rules.withColumn("typ", typ).withColumn("anweisung", instruction(F.col("typ"), F.col("b.alter_wert"), F.col("b.neuer_wert")))
    if existing is not None:
        rules = rules.join(existing.select("signatur", "buero"), ["signatur", "buero"], "left_anti")
    return rules.drop("b")


def field_rules(corrections: DataFrame, existing: DataFrame) -> DataFrame:
    """Rule state per (firm, office, field): new at more than two corrections, else one confirmation more."""
    g = corrections.groupBy("firma_id", "buero", "feld").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    e = existing.select("firma_id", "buero", "feld", F.col("bestaetigt").alias("_b"))
    j = g.join(e, ["firma_id", "buero", "feld"], "left")
    return j.select(
        "firma_id", "buero", "feld", F.when(F.col("_b").isNotNull(), F.col("_b") + 1).otherwise(F.col("n")).alias("bestaetigt"),
        F.col("_b").isNull().alias("neu"))


def recommendations(rules: DataFrame, office: Column) -> DataFrame:
    pct = F.format_string("%.0f%%", F.col("konfidenz") * 100)
    text = (
        F.when((F.col("buero") == office) & (office != ""), F.concat(F.lit("[Buero-Regel, Konfidenz "), pct, F.lit("] "), "anweisung"))
        .when(F.col("global"), F.concat(F.lit("[Globale Regel, Konfidenz "), pct, F.lit("] "), "anweisung"))
        .otherwise(F.col("anweisung")))
    return rules.withColumn("empfehlung", text)
