"""The corpus pipeline: documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last give the
columns of documents; the last gives packed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadra.llm.decontaminate import decontaminate
from quadra.llm.documents import table
from quadra.llm.minhash import keep_one
from quadra.llm.mixing import mix
from quadra.llm.packing import packed_rows
from quadra.llm.quality import keep_good
from quadra.llm.store import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, width=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window of ten words."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2,048 token ids."""
    return packed_rows(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_free),
    ("source_mixing", mixed),
    ("token_packing", packed),
]

#: A trained classifier, random rounding and byte-pair encoding are not SQL; tests check every stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again by the next, and go when
    that one's are written."""
    space = Workspace(spark, "pipeline")
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
        if old is not None:
            space.drop(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
