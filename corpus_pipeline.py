"""From raw documents to a training mix: five stages, each one of the operators over all that the one before kept.

Every stage but the last returns the columns of ``documents``:

* quality: rows that the classifier rejects as low quality or toxic go;
* near_duplicates: of each group of five-word similarity 0.8 or more the row of
  the smallest doc_id stays;
* decontaminate: rows that hit two benchmark items or more, short ones included,
  go, others lose the words they hit;
* personal_data: spans are replaced by their kind in brackets;
* mix: rows that the mix takes, with mix_size, mix_taken and mix_copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import stored, table
from quern.llm.decontaminate import decontaminate
from quern.llm.mixing import mixed
from quern.llm.pii import redact_pii
from quern.llm.quality import keep_good
from quern.llm.similar import similar_dedup


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar_dedup(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate(docs, table(spark, sf_dir, "benchmark"), short_items=True))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(redact_pii(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", clean_of_benchmarks),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: Stages learn models and hash texts, which SQL cannot express; tests hold ``run`` against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
