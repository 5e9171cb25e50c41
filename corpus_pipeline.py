"""A corpus from documents to token digests, each stage on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm import bpe, exact, mixture, simhash, toxicity
from panelloom.llm.common import read
from panelloom.session import cut_lineage

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact dedup", exact.stage),
    ("simhash near-dedup", simhash.stage),
    ("mixture", mixture.stage),
    ("bpe", bpe.stage),
]

# Scores of a learnt model, fingerprints and tokens are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
