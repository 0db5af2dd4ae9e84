"""Second rule set: per-room pre-calculation with graduated deductions, and storey scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import square_perimeter
from ..functions.numbers import steady_sum
from ..functions.rules import graduated_factor


def room_precalculation(rooms: DataFrame, openings: DataFrame, wall_m: float = 0.25) -> DataFrame:
    """Masonry volume, plaster, paint, flooring and screed per room.

    ``openings(room_id, breite_m, hoehe_m, art)`` are already assigned.  Each opening is
    deducted by the share of its own band; reveals are added to plaster and paint.
    """
    b = F.coalesce("breite_m", F.lit(0.0))
    h = F.when((F.col("art") == "tuer") & (F.coalesce("hoehe_m", F.lit(0.0)) <= 0), F.lit(2.10)).otherwise(F.coalesce("hoehe_m", F.lit(0.0)))
    o = openings.select("room_id", b.alias("b"), h.alias("h")).withColumn("a", F.col("b") * F.col("h"))
    reveal = 2.0 * wall_m * F.col("h") + 2.0 * wall_m * F.col("b")
    per = o.groupBy("room_id").agg(
        F.sum(F.col("a") * graduated_factor(F.col("a"), "mauerwerk")).alias("ab_mw"),
        F.sum(F.col("a") * graduated_factor(F.col("a"), "putz_innen")).alias("ab_putz"), F.sum(reveal).alias("leibung"))
    f = F.coalesce("flaeche_m2", F.lit(0.0))
    u = F.when(F.coalesce("umfang_m", F.lit(0.0)) > 0, F.col("umfang_m")).when(f > 0, square_perimeter(f)).otherwise(F.lit(0.0))
    hh = F.coalesce("hoehe_m", F.lit(2.60))
    zero = F.lit(0.0)
    r = rooms.join(per, "room_id", "left").withColumn("brutto", u * hh)
    wall = F.greatest(zero, F.col("brutto") - F.coalesce("ab_mw", zero))
    plaster = F.greatest(zero, F.col("brutto") - F.coalesce("ab_putz", zero) + F.coalesce("leibung", zero))
    return r.select(
        "room_id", "projekt_id", (wall * wall_m).alias("mauerwerk_m3"), plaster.alias("putz_m2"), plaster.alias("maler_m2"),
        F.when(f > 0, f).alias("bodenbelag_m2"), F.when(f > 0, f).alias("estrich_m2"))


def storey_scaled_paint(rooms: DataFrame, openings: DataFrame, storeys: int, flats_per_upper: int, h_ground: float, h_upper: float) -> DataFrame:
    """Paint of the ground floor and its scaling to the upper floors.

    This rule set takes the deduction band from the *sum* of a room's openings, unlike the
    per-opening rule above; the two are kept apart on purpose.  No order of adding decides the band of a sum at its limit.
    """
    per = openings.groupBy("room_id").agg(steady_sum(F.coalesce("breite_m", F.lit(0.0)) * F.coalesce("hoehe_m", F.lit(0.0))).alias("o"))
    zero = F.lit(0.0)
    u, f = F.coalesce("umfang_m", zero), F.coalesce("flaeche_m2", zero)
    r = rooms.join(per, "room_id", "left").withColumn("o", F.coalesce("o", zero))
    net = u * h_ground - F.col("o") * graduated_factor(F.col("o"), "maler")
    g = r.groupBy("projekt_id").agg(F.sum(net).alias("wand_eg"), F.sum(f).alias("decke_eg"), F.count_distinct("wohnung").alias("whg"))
    flats = F.lit(float(flats_per_upper)) / F.greatest(F.col("whg"), F.lit(1))
    return g.select(
        "projekt_id", "wand_eg", "decke_eg", (F.col("wand_eg") * flats * (h_upper / h_ground) * (storeys - 1)).alias("wand_og"),
        (F.col("decke_eg") * flats * (storeys - 1)).alias("decke_og"))
