"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quernstone.llm import centroids, decontamination, license_scan, media, merkle, ngram_join, oracles, packing, pii, quality, secret_scan, sharding, token_counts, warc
from quernstone.llm.common import surrogate_key, tokenizer_path
from quernstone.session import ship_package

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    """Register ``f`` under its name; the package goes to the executors before it runs."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    QUERIES[f.__name__] = run
    return run


@query
def op2_decontamination(spark, table) -> DataFrame:
    """Every document against all benchmark windows of 10 words."""
    return decontamination.digest(decontamination.find_contamination(table("documents"), table("benchmark"), window=10))


@query
def op3_sharding(spark, table) -> DataFrame:
    """Every document in one of 16 shards by jump hashing, with its slot and its shard among 17."""
    return sharding.assign_shards(table("documents"), shards=16)


@query
def op4_token_counts(spark, table) -> DataFrame:
    """Token counts of every whole document under the 32k piece model."""
    return token_counts.count_tokens(table("documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op5_media_columns(spark, table) -> DataFrame:
    """Every document stored as an ISO media file and read back through its sample tables."""
    return media.store_texts(table("documents"))


@query
def op6_packing(spark, table) -> DataFrame:
    """All documents packed into sequences of 4096 tokens by best-fit decreasing."""
    return packing.pack(table("documents"), tokenizer_path("word_bpe_49k.json"), window=4096, end_id=2)


@query
def op7_ngram_jaccard_join(spark, table) -> DataFrame:
    """Every document's component under links of Jaccard 0.9 on three-word shingles."""
    return ngram_join.jaccard_components(table("documents"), size=3, num=90, den=100)


@query
def op10_warc(spark, table) -> DataFrame:
    """Every page written to WARC archives and read back by the salvage reader."""
    return warc.round_trip(table("pages"))


@query
def op1_license_scan(spark, table) -> DataFrame:
    """Every document's licence notices."""
    return license_scan.report(license_scan.scan(table("documents")))


@query
def op8_pii_surrogates(spark, table) -> DataFrame:
    """Every document with its personal data replaced; surrogates are checked over all documents first."""
    docs, key = table("documents"), surrogate_key(spark)
    pii.check_collisions(docs, key)
    return pii.replace_entities(docs, key)


@query
def op9_quality_classifier(spark, table) -> DataFrame:
    """Every document's quality score under a rule ensemble fitted outside the held-out third."""
    docs = table("documents")
    return quality.score(docs, quality.fit(docs, table("labels")))


@query
def op11_secret_scan(spark, table) -> DataFrame:
    """Every document's secrets: the base rules, and what a network fitted on labelled findings adds."""
    docs = table("documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.fit(docs)))


@query
def op12_merkle_manifest(spark, table) -> DataFrame:
    """Every document's leaf, its proof, and whether a partly tampered copy still gives the root."""
    return merkle.audit(table("documents"))


@query
def op13_centroid_clustering(spark, table) -> DataFrame:
    """Every 64-component vector's cluster after three rounds with 16 centroids."""
    return centroids.report(centroids.cluster(table("embeddings"), k=16, rounds=3, dims=64, scale=64))


ORACLE["op1_license_scan"] = license_scan.oracle()
ORACLE["op2_decontamination"] = oracles.DECONTAMINATION
ORACLE["op7_ngram_jaccard_join"] = oracles.JACCARD
ORACLE["op10_warc"] = oracles.WARC
ORACLE["op12_merkle_manifest"] = oracles.MERKLE
ORACLE["op13_centroid_clustering"] = oracles.CENTROIDS
QUERIES["pipeline"] = corpus_pipeline.run
