"""A training corpus from ``documents``: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import fmindex, jaccard, pii, toxicity
from pathloom.llm.packing import pack_documents
from pathloom.llm.queries import table, vocabulary
from pathloom.llm.store import is_stored, stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out.  Whole texts pass through Python here, so the
    stage stores its table itself: its batches are of bounded bytes, whoever reads it."""
    return stored(fmindex.decontaminated(docs, table(spark, sf_dir, "benchmark")), "decontamination")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds."""
    return pii.redacted(docs, pii.fit(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return pack_documents(docs, vocabulary())


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", packing)]

#: The learnt stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs if is_stored(docs) else stored(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)
