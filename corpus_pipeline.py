"""The corpus pipeline over documents: each stage is written as Parquet and read again as the next one's input.

The stages, in order: quality classifier (rejected documents go), line dedup (repeated lines go, and
documents of which nothing else is left), near-duplicates (one document of each group stays),
personal data (spans are replaced by their kind) and packing into sequences.

Defined results: rows with a null id are never taken for duplicates; a null text stays null up to
packing, where it counts as empty; an empty table gives an empty result; further columns of the
input stay up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.llm import line_dedup, near_dup, packing, pii, quality_gam
from spikeloom.llm.common import Shelf, bounded_batches, table


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    score = quality_gam.scorer(quality_gam.train(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score("text") >= quality_gam.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup.without_repeats(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    copies = near_dup.link(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    redact = pii.redactor(pii.learn(docs))
    return _recounted(docs.withColumn("text", redact("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = shelf.put(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
