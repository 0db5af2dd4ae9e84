"""Longest-matching-block similarity, the one string measure Spark lacks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .text import (
    CATEGORY_NAMES,
    FUZZY_MIN_LEN,
    FUZZY_MIN_RATIO,
    category_exact,
)


def _closest(name: str) -> str | None:
    parts = [name] + ([name.split()[0]] if " " in name else [])
    parts += [p.strip() for p in name.split("-")] if "-" in name else []
    parts = [p.lower() for p in parts if len(p) >= FUZZY_MIN_LEN]
    for cat, names in CATEGORY_NAMES.items():
        for p in parts:
            if any(SequenceMatcher(None, p, n.lower()).ratio() >= FUZZY_MIN_RATIO for n in names):
                return cat
    return None


@F.pandas_udf(T.StringType())
def fuzzy_category(names: pd.Series) -> pd.Series:
    """Category by similarity; each distinct name of an Arrow batch is compared once."""
    known = {n: _closest(n.strip()) for n in names.dropna().unique() if n.strip()}
    return names.map(known).astype(object).where(names.notna(), None)


def with_category(rooms: DataFrame, name: str = "name", out: str = "kategorie") -> DataFrame:
    """Room category: exact catalogue look-up in the JVM, similarity only for the leftovers.

    Distinct leftover names are scored once and written; their categories join back by name, by
    broadcast where that table is measured small.  Rows themselves never go through Python.
    """
    exact = category_exact(F.col(name))
    rest = rooms.filter(F.col(name).isNotNull() & exact.isNull()).select(F.col(name).alias("_name")).distinct()
    like = cut(rest.withColumn("_like", fuzzy_category("_name")).filter("_like is not null"))
    j = rooms.join(like, F.col(name) == F.col("_name"), "left")
    return j.withColumn(out, F.coalesce(exact, F.col("_like"))).drop("_name", "_like")
