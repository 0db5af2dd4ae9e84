"""Scalar expressions against pinned values."""

import math

from pyspark.sql import functions as F

from qtospark.functions import geometry as G
from qtospark.functions import numbers as N
from qtospark.functions import openings as O
from qtospark.functions import rules as R
from qtospark.functions import text as X
from qtospark.functions.similarity import with_category


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_german_numbers(spark):
    cases = {"1.234,56": 1234.56, "123,4": 123.4, "123.4": 123.4, "12.345": 12345.0, "-1.234": -1234.0, "2,80 m": 2.8, "abc": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.v for r in df.select("s", N.german_number(F.col("s")).alias("v")).collect()}
    assert got == cases


def test_units_differ_by_design(spark):
    r = one(spark, a=N.length_to_m(F.lit(2.5)), b=N.length_to_m(F.lit(120.0)), c=N.length_to_m(F.lit(1200.0)),
            d=N.window_dim_to_m(F.lit(120.0)), e=N.window_dim_to_m(F.lit(1470.0)), f=N.mm_if_large(F.lit(900.0)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (2.5, 1.2, 1.2, 1.2, 1.47, 0.9)


def test_categories(spark):
    want = {"Bad": "Innenraum_warm", "Zimmer 3": "Innenraum_warm", "Bad-WC": "Innenraum_warm", "Terasse": "Loggia", "Stiege": "Stiegenhaus",
            "Garage": "Nebenraum_kalt", "Wiese": None, "Wohnkuche": "Innenraum_warm", None: None}
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r.name: r.kategorie for r in with_category(df).collect()} == want


def test_net_opening(spark):
    n = lambda b, h, w, f, s: O.net_opening(F.lit(b), F.lit(h), F.lit(w), F.lit(f), F.lit(s))
    r = one(spark, klein=n(1.2, 1.4, 38.0, 0.9, 4.0), gross=n(2.5, 2.0, 38.0, 0.9, 4.0), tuer=n(2.5, 2.0, 8.0, 0.0, 4.0), grenze=n(2.0, 2.0, 38.0, 0.0, 4.0))
    assert r.klein.uebermessen and r.klein.abzug == 0 and r.grenze.uebermessen
    assert r.gross.abzug == 5.0 and r.gross.tiefe == 0.32 and r.gross.laibung == round(0.32 * (4.0 + 5.0), 3) and r.gross.sohlbank
    assert r.tuer.tiefe == 0.04 and not r.tuer.sohlbank


def test_geometry(spark):
    pts = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in [(0, 0), (4, 0), (4, 3), (0, 3)]])
    r = one(spark, a=G.polygon_area(pts), u=G.polyline_length(pts, True), l=G.polyline_length(pts), s=G.rectangle_sides(pts, F.lit(1.0)),
            i=G.point_in_polygon(F.lit(1.0), F.lit(1.0), pts), o=G.point_in_polygon(F.lit(5.0), F.lit(1.0), pts), q=G.rectangle_from_area(F.lit(12.0), F.lit(14.0)))
    assert (r.a, r.u, r.l, list(r.s), r.i, r.o) == (12.0, 14.0, 11.0, [4.0, 3.0], True, False)
    assert (r.q.a, r.q.b) == (4.0, 3.0)
    assert math.isclose(one(spark, v=G.iso_perimeter(F.lit(20.0))).v, 2 * (math.sqrt(27) + math.sqrt(20 / 1.35)))


def test_simplify(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [1.0, 0.01], [2.0, 0.0], [2.0, 2.0]],)], "p array<array<double>>")
    assert df.select(G.simplify("p", F.lit(0.1)).alias("q")).first().q == [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]]


def test_rule_citation(spark):
    rows = {"in Anlehnung an ÖNORM B 2204 (vormals B 2210) · Σ Raumfläche": ("norm", "ÖNORM B 2204", True, "Σ Raumfläche"),
            "ÖNORM B 2230-1 · 2.5 m² NICHT normbelegt · Σ(U×H)": ("norm_offen", "ÖNORM B 2230-1", False, "Σ(U×H)"),
            "nach DIN 18363": ("fremdnorm", "DIN 18363", False, "nach DIN 18363"), "3 Stk × 2": ("stueckzahl", None, False, "3 Stk × 2")}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    got = {r.t: (r.c.art, r.c.norm, r.c.angelehnt, r.c.formel) for r in df.select("t", R.citation(F.col("t")).alias("c")).collect()}
    assert got == rows


def test_deduction_bands(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (3.0,), (3.1,)], "a double")
    assert [r[0] for r in df.select(R.graduated_factor(F.col("a"), "mauerwerk")).collect()] == [0.0, 0.5, 0.5, 1.0]


def test_storey_labels(spark):
    df = spark.createDataFrame([("EG",), ("2.OG",), ("OG1",), (None,)], "g string")
    assert [r[0] for r in df.select(X.storey_label(F.col("g"))).collect()] == ["Erdgeschoss", "2. Obergeschoss", "1. Obergeschoss", "ohne Geschoss"]
