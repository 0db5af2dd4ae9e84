"""Registry of runnable queries over the driver tables, each with its SQL check."""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import adapters

MODULES = [
    "scalars", "trades_q", "measure_q", "material_q", "merge_q", "truth_q", "learn_q",
    "spans_q", "drawing_q", "quality_q", "io_q", "stream_q",
]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """Lazy access to base and domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in adapters.ADAPTERS or name == "spans":
            return adapters.table(self.spark, self.sf_dir, name)
        return adapters.base(self.spark, self.sf_dir, name)


def query(name: str, ids: str, oracle: str | None = None, tables: str = ""):
    """Register ``fn(t: Tables) -> DataFrame``; ``tables`` are defined before ``oracle``.

    The oracle text continues the ``WITH`` clause when it starts with a comma.
    """

    def deco(fn):
        sql = None
        if oracle is not None:
            sql = (adapters.cte(*tables.split()) if tables else "") + "\n" + oracle.strip()
        REGISTRY[name] = Query(name, tuple(ids.split()), lambda s, d: fn(Tables(s, d)), sql)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
