"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's documents; all but the last return the columns of ``documents``. Documents keep
their ids; a document that the mix takes twice stands there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markset.llm import disclosure, jaccard, mixing, packing, ranking
from markset.llm.common import DOCUMENT, stored, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts; it learns from the labels outside the held-out fold."""
    model = ranking.learn(table(spark, sf_dir, "documents"), ranking.training_labels(table(spark, sf_dir, "labels")))
    return ranking.score_documents(docs, model).where("accepted").select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of linked texts."""
    return jaccard.one_per_component(docs).select(*DOCUMENT)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that disclose it."""
    clean = disclosure.sanitise(docs.select(*DOCUMENT)).withColumn("text", F.col("sanitised"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs).select(*DOCUMENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", sanitise),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot state the learned ranking, the draw of the mix or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
