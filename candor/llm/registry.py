"""The queries of this subpackage, (spark, sf_dir) to DataFrame, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import annsearch, bpe, licenses, lm, minhash, mixing, pii, quality, rangejoin, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return annsearch.search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op4_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's first category is bad quality, its second toxicity."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    told = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, told, ["low_quality", "toxic"])
    return toxicity.classify(docs, chain)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.range_join(_read(spark, sf_dir, "embeddings"), cosine=0.93)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(_read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_license_scan,
        op3_nearest_neighbours,
        op4_find_pii,
        op5_bpe,
        op6_toxicity,
        op7_quality,
        op8_range_join,
        op9_lm_score,
        op10_near_duplicates,
    )
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_license_scan": licenses.ORACLE,
    "op8_range_join": rangejoin.ORACLE,
}
