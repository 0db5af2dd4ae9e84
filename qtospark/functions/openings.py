"""Opening rules: area, deduction, reveal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
DEDUCT_DEFAULT_M2 = 4.0
DEDUCT_BY_TRADE = {"maler": 2.5, "rohbau": 0.5, "beton": 0.5}
FRAME_SETBACK_CM = 6.0
MIN_REVEAL_M = 0.04
SILL_FROM_PARAPET_M = 0.15
REVEAL_LINEAR_MAX_M = 0.25


def threshold(trade: str | None, override: Column | None = None, general: Column | None = None) -> Column:
    """Per-trade override, then company-wide value, then the trade's default."""
    cols = [c for c in (override, general) if c is not None]
    return F.coalesce(*cols, F.lit(DEDUCT_BY_TRADE.get(trade, DEDUCT_DEFAULT_M2)))


def opening_area(b: Column, h: Column) -> Column:
    return F.coalesce(b, F.lit(0.0)) * F.coalesce(h, F.lit(0.0))


def is_outer_wall(wand_typ: Column, art: Column) -> Column:
    """The wall tag decides; without one a window is in an outer wall, a door in an inner."""
    tag = F.lower(F.nullif(wand_typ, F.lit("")))
    return F.coalesce(tag.startswith("a"), F.coalesce(art != "tuer", F.lit(True)))


def wall_cm(wand_typ: Column, art: Column, aussen: Column, innen: Column) -> Column:
    return F.when(is_outer_wall(wand_typ, art), F.coalesce(aussen, F.lit(50.0))).otherwise(
        F.coalesce(innen, F.lit(25.0))
    )


def net_opening(b: Column, h: Column, wand: Column, fph: Column, limit: Column) -> Column:
    """struct(flaeche, abzug, laibung, uebermessen, tiefe, sohlbank, abwicklung)."""
    area = opening_area(b, h)
    over = area > limit
    depth = F.greatest(F.lit(MIN_REVEAL_M), F.coalesce(wand, F.lit(0.0)) / 100.0 - FRAME_SETBACK_CM / 100.0)
    sill = F.coalesce(fph, F.lit(0.0)) > SILL_FROM_PARAPET_M
    around = 2 * h + b + F.when(sill, b).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    return F.struct(
        F.round(F.greatest(area, zero), 3).alias("flaeche"),
        F.when(over, F.round(area, 3)).otherwise(zero).alias("abzug"),
        F.when(over, F.round(depth * around, 3)).otherwise(zero).alias("laibung"),
        (~over).alias("uebermessen"),
        F.when(over, F.round(depth, 3)).otherwise(zero).alias("tiefe"),
        (over & sill).alias("sohlbank"),
        F.when(over, around).otherwise(zero).alias("abwicklung"),
    )
