"""The corpus operators as queries over the driver tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadspark.llm import (centroids, decontaminate, exact_dedup, licenses, packing, pii, sharding, simhash, substring_dedup, suffix_dedup, toxicity,
                           url_filter, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@_query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), packing.public_vocabulary())


@_query("op2_spaced_seed_decontamination")
def spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query("op3_vector_sharding")
def vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op4_counterfactual_toxicity")
def counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query("op5_license_digests", licenses.sql())
def license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op6_bootstrapped_pii")
def bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op7_suffix_prefix_doubling")
def suffix_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op8_url_digest_array", url_filter.SQL)
def url_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op10_exact_dedup", exact_dedup.SQL)
def exact_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op11_substring_doubling", substring_dedup.SQL)
def substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op12_va_file_clusters", centroids.sql())
def va_file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
