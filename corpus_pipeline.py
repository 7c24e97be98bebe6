"""A corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept;
all but the last return the columns of documents. ``run`` writes each result as Parquet and reads it
again, so a lost executor costs a stage's tasks and never an earlier stage.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra
columns of any name; what it makes of them stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontamination, ngram_join, packing, pii, quality
from quernstone.llm.common import surrogate_key, tokenizer_path, written
from quernstone.session import ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted outside the held-out third of labels, finds good.

    A null text is scored as an empty one; repeated rows stay or go together; null ids are scored as any
    others. Without labels of both kinds the ensemble is a constant and all documents stay or all go: all
    stay where labels say nothing or only good, all go where they say only bad.
    """
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component under Jaccard 0.8 on five-word shingles.

    Texts that are null or have no words, and rows with a null id, stay; rows that repeat a kept id stay.
    """
    ship_package(spark)
    return ngram_join.one_per_component(docs, size=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs; null and empty texts stay."""
    ship_package(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates, checked first; n_chars follows the new text.

    A null text stays null, with a null n_chars. The key is that of ``surrogate_key``.
    """
    ship_package(spark)
    key = surrogate_key(spark)
    pii.check_collisions(docs, key)
    new = pii.with_surrogates(docs, key)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a null or empty text is its end token alone."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: The stages are beyond SQL (a fitted model, keyed surrogates, a tokenizer); tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
