"""A training corpus from raw documents: quality, toxicity, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paxlens.llm import mixing, packing, quality, simhash, toxicity
from paxlens.llm.common import read, written
from paxlens.llm.tokens import public_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below one half; nulls, empty and repeated rows: see quality.kept()."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches their language's threshold; nulls, empty and repeated rows: see toxicity.kept()."""
    return toxicity.kept(docs, read(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group; null and empty texts are one group, see simhash.deduplicated()."""
    return simhash.deduplicated(docs, bits=4, words=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents repeated, cut or left out as the sources' budgets say; null and empty texts give nothing, see mixing.mixture()."""
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; null and empty texts are the end id alone, see packing.packed()."""
    return packing.packed(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # classifiers, XXH64 and byte-pair encoding have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "pipeline")
    return docs
