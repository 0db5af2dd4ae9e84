"""Measurements: geometry is the truth, value and formula are derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numbers import german_format
from ..operators.ordering import running_number

# --- fixed values -----------------------------------------------------------------
UNIT_OF_TYPE = {
    "flaeche": "m2", "abzug": "m2", "laenge": "m", "stueck": "stk", "volumen": "m3",
    "bauteil": "m2", "treppe": "m2", "dach": "m2", "wandflaeche": "m2",
}
STAIR_STOREY_M = 2.75


def evaluate(m: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Adds ``wert, einheit, formel`` to ``(messung_id, typ, punkte, ptm, hoehe_m, …)``.

    ``children(parent_id, wert)`` are evaluated deductions, subtracted from area types.
    """
    if children is not None:
        sub = children.groupBy("parent_id").agg(F.sum("wert").alias("_kinder"))
        m = m.join(sub, m["messung_id"] == sub["parent_id"], "left").drop("parent_id")
    else:
        m = m.withColumn("_kinder", F.lit(None).cast("double"))
    p, ptm, h = F.col("punkte"), F.col("ptm"), F.col("hoehe_m")
    area = G.polygon_area(p) / (ptm * ptm)
    length = G.polyline_length(p, F.col("geschlossen")) / ptm
    rise = F.coalesce(h, F.lit(STAIR_STOREY_M))
    run = F.greatest(G.extent(p, 0), G.extent(p, 1)) / ptm
    tilt = F.col("neigung_grad")
    typ = F.col("typ")
    value = (
        F.when(typ == "stueck", F.size(p).cast("double"))
        .when(typ == "laenge", length)
        .when(typ == "wandflaeche", F.when((length > 0) & (h > 0), length * h))
        .when(typ == "dach", F.when((tilt > 0) & (tilt < 80) & (area > 0), area / F.cos(F.radians(tilt))))
        .when(typ == "treppe", F.when((run > 0) & (area > 0), area * F.sqrt(1.0 + (rise / run) * (rise / run))))
        .when(typ == "volumen", area * F.coalesce(h, F.lit(0.0)))
        .otherwise(area - F.coalesce("_kinder", F.lit(0.0)))
    )
    units = F.create_map(*[F.lit(x) for kv in UNIT_OF_TYPE.items() for x in kv])
    ab = G.rectangle_sides(p, ptm)
    shape = F.when(ab.isNotNull(), F.concat(german_format(F.get(ab, F.lit(0))), F.lit(" × "), german_format(F.get(ab, F.lit(1))))).otherwise(
        F.concat(F.lit("Polygon "), F.size(p), F.lit(" Punkte")))
    formula = (
        F.when(typ == "stueck", F.concat(F.size(p), F.lit(" Stk")))
        .when(typ == "wandflaeche", F.concat(german_format(length), F.lit(" × "), german_format(h)))
        .when(typ == "volumen", F.concat(F.lit("("), shape, F.lit(") × "), german_format(F.coalesce(h, F.lit(0.0)))))
        .when(typ.isin("flaeche", "abzug", "bauteil"), shape)
    )
    ok = ptm > 0
    return (
        m.withColumn("wert", F.when(ok, value)).withColumn("einheit", F.coalesce(F.try_element_at(units, typ), F.lit("m2")))
        .withColumn("formel", F.when(ok & F.col("wert").isNotNull(), formula)).drop("_kinder")
    )


def protocol(measurements: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed sum per position with waste, and the measurements without a position."""
    live = measurements.filter(F.coalesce("status", F.lit("aktiv")) != "verworfen")
    w = F.coalesce("wert", F.lit(0.0))
    signed = F.when(F.col("typ") == "abzug", -w).otherwise(w)
    sums = live.filter("position_id is not null").groupBy("position_id").agg(
        F.sum(signed).alias("summe"), F.count(F.lit(1)).alias("n_messungen"))
    vp = F.coalesce("verschnitt_pct", F.lit(0.0))
    out = (
        positions.join(sums, "position_id", "left")
        .withColumn("summe", F.coalesce("summe", F.lit(0.0)))
        .withColumn("n_messungen", F.coalesce("n_messungen", F.lit(0)))
        .withColumn("endsumme", F.col("summe") * (1.0 + vp / 100.0))
    )
    return out, live.filter("position_id is null")


def proposals(rooms: DataFrame) -> DataFrame:
    """Room outline to measurement proposal; a printed area beats the geometry."""
    ok = F.size("punkte") >= 3
    geo = G.polygon_area(F.col("punkte")) / (F.col("ptm") * F.col("ptm"))
    stamp = F.when(F.col("stempel_f") != 0, F.col("stempel_f"))
    return rooms.filter(ok).select(
        "messung_id", "projekt_id", F.lit("flaeche").alias("typ"), F.coalesce(stamp, geo).alias("wert"),
        F.when(stamp.isNotNull(), F.concat(german_format(stamp), F.lit(" lt. Raumstempel"))).alias("formel"),
        F.lit("ki").alias("quelle"), F.lit("vorschlag").alias("status"))


def replace_proposals(existing: DataFrame, fresh: DataFrame, ref: str = "ref") -> DataFrame:
    """Open machine proposals go, human and confirmed rows stay, new refs are added."""
    open_row = (F.col("quelle") == "ki") & (F.col("status") == "vorschlag")
    kept = existing.filter(~open_row)
    new = fresh.join(kept.select(ref).distinct(), ref, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def number_measurements(m: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Next running number per project: highest taken number plus rank by time and id."""
    n = running_number(m, ["projekt_id"], F.date_trunc("month", "erstellt_am"), ["erstellt_am", "messung_id"], "_rn")
    if taken is None:
        return n.withColumnRenamed("_rn", "nummer")
    top = taken.groupBy("projekt_id").agg(F.max("nummer").alias("_top"))
    return (
        n.join(top, "projekt_id", "left")
        .withColumn("nummer", F.coalesce("_top", F.lit(0)) + F.col("_rn")).drop("_rn", "_top")
    )
