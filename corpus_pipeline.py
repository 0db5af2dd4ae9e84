"""Corpus pipeline: from documents to packed token sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qtospark.llm import mixing, packing, similarity_join, substrings, toxicity
from qtospark.llm.common import Scratch, documents

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", similarity_join.stage),
    ("suffix_dedup", substrings.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The classifier, the similarity join and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every stage reads what the one before has written."""
    store, docs = Scratch(spark), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        done = store.put(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            store.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
