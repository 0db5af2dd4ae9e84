"""Number parsing, unit inference and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def german_number(c: Column, clean: bool = False) -> Column:
    """'1.234,56', '123,4', '123.4', '12.345' (thousands dot) to double; null if no number; ``clean``: digits, points and commas alone."""
    t = c if clean else F.regexp_replace(F.trim(c), r"[^\d.,\-]", "")
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    norm = (
        F.when(comma & dot, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma, F.replace(t, F.lit(","), F.lit(".")))
        .when(dot & t.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit("")))
        .otherwise(t)
    )
    return F.nullif(norm, F.lit("")).try_cast("double")


def length_to_m(v: Column) -> Column:
    """Reading without unit: below 4 metres, below 350 centimetres, else millimetres."""
    return F.when(v < 4, v).when(v < 350, v / 100.0).otherwise(v / 1000.0)


def text_length_to_m(t: Column) -> Column:
    """Printed number: decimals are metres, whole numbers above 5 centimetres."""
    v = german_number(t)
    return F.when(F.regexp_like(t, F.lit(r"[.,]\d")), v).when(v > 5, v / 100.0).otherwise(v)


def window_dim_to_m(v: Column) -> Column:
    """Window size: below 30 metres, below 300 centimetres, else millimetres."""
    return F.when(v < 30, v).when(v < 300, v / 100.0).otherwise(v / 1000.0)


def mm_if_large(v: Column) -> Column:
    """Sizes above 10 can only be millimetres."""
    return F.when(v > 10, v / 1000.0).otherwise(v)


def unit_family(e: Column) -> Column:
    u = F.regexp_replace(F.trim(F.lower(F.coalesce(e, F.lit("")))), r"\.+$", "")
    return (
        F.when(u.isin("m²", "m2"), F.lit("flaeche"))
        .when(u.isin("m³", "m3"), F.lit("volumen"))
        .when(u.isin("lfm", "m", "laufmeter"), F.lit("laenge"))
        .otherwise(F.lit("stk"))
    )


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def finite_quantity(c: Column) -> Column:
    """Quantities are finite and not negative; anything else is zero."""
    bad = c.isNull() | F.isnan(c) | (c == float("inf")) | (c < 0)
    return F.when(bad, F.lit(0.0)).otherwise(c)


def sql_round(c: Column, digits: int) -> Column:
    """Rounded as the SQL checks do: the double is scaled, its halves go away from zero, zero keeps the sign.

    ``F.round`` rounds the shortest decimal of the double instead, so sums of lines differ at halves.
    """
    m = F.lit(10.0 ** digits)
    a = F.abs(c * m)
    whole = F.floor(a).cast("double")
    # the fraction is exact; beyond 2^52 a double has none
    r = F.when(a < 2.0 ** 52, whole + F.when(a - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(a) / m
    return F.when(c < 0, -r).otherwise(r)


def steady_sum(c: Column) -> Column:
    """Sum of doubles that no order of adding changes; for one or two values it is their plain sum.

    Whole parts and fractions (to 2^-62) are added as integers; values of 10^9 and more make it the plain sum.
    """
    unit = F.lit(2 ** 62)
    part = F.when(F.abs(c) < 1e9, c)
    whole = part.cast("bigint")
    rest = ((part - whole.cast("double")) * 2.0 ** 62).cast("bigint")
    exact = F.sum(whole).cast("decimal(18,0)") * unit.cast("decimal(19,0)") + F.sum(rest.cast("decimal(19,0)"))
    return F.when(F.count(c) == F.count(part), exact.cast("double") / 2.0 ** 62).otherwise(F.sum(c))


def german_format(c: Column, digits: int = 2) -> Column:
    """Decimals after a comma; what is rounded is the double itself, not its shortest decimal."""
    return F.replace(F.call_function("format_number", c, F.lit("0." + "0" * digits if digits else "0")), F.lit("."), F.lit(","))


def scale_points_per_m(c: Column) -> Column:
    """Scale label '1:M' to PDF points per metre; M must lie in 10..5000."""
    m = F.nullif(F.regexp_extract(c, r"1\s*:\s*(\d+)", 1), F.lit("")).try_cast("double")
    return F.when(m.between(10, 5000), F.lit(2835.0) / m)


def chain_value_cm(t: Column) -> Column:
    """Dimension text in whole centimetres, 5..1500."""
    s = F.trim(t)
    v = F.when(s.rlike(r"^\d{1,4}(,\d)?$"), F.replace(s, F.lit(","), F.lit(".")).try_cast("double"))
    return F.when(v.between(5, 1500), v)


def chain_value_m(t: Column) -> Column:
    """Dimension text in metres with decimals, 0.30..15, returned in centimetres."""
    s = F.trim(t)
    v = F.when(
        s.rlike(r"^\d{1,2}[.,]\d{1,2}$"), F.replace(s, F.lit(","), F.lit(".")).try_cast("double")
    )
    return F.when(v.between(0.30, 15.0), v * 100.0)


def csv_field(c: Column, sep: str = ";") -> Column:
    q = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    need = F.contains(c, F.lit(sep)) | F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n"))
    return F.when(c.isNull(), F.lit("")).when(need, q).otherwise(c)
