"""Caches of scores, candidates and embeddings: what is still valid, what is missing, and what to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["dedup_key", "raw_fp", "product_id"]


def valid_scores(cache: DataFrame, products: DataFrame, model_hash: str) -> DataFrame:
    """Cached scores (dedup_key, raw_fp, product_id, score, product_fp, model_hash) of this model whose product is
    unchanged. raw_fp is the hash of the raw text that was scored, so another raw text isn't given its score."""
    now = products.select(F.col("id").alias("product_id"), "product_fp")
    return cache.where(F.col("model_hash") == model_hash).join(now, ["product_id", "product_fp"], "left_semi")


def cache_counts(cache: DataFrame, valid: DataFrame) -> DataFrame:
    """One row: kept and dropped entries."""
    kept = valid.agg(F.count("*").alias("kept"))
    return cache.agg(F.count("*").alias("n")).join(kept, F.lit(True)).select("kept", (F.col("n") - F.col("kept")).alias("dropped"))


def missing_pairs(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """Pairs without a valid score."""
    return pairs.join(valid.select(*PAIR), PAIR, "left_anti")


def kept_scores(scores: DataFrame, active: DataFrame, products: DataFrame) -> DataFrame:
    """The scores to store: of keys in use and products in the catalog."""
    return scores.join(active.select("dedup_key"), "dedup_key", "left_semi").join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")


def missing_keys(active: DataFrame, candidates: DataFrame, config: str) -> DataFrame:
    """Active keys without candidates that were found under this configuration."""
    return active.join(candidates.where(F.col("config") == config).select("dedup_key"), "dedup_key", "left_anti")


def current_candidates(candidates: DataFrame, products: DataFrame, config: str) -> DataFrame:
    """Stored candidates of this configuration whose product is still there."""
    return candidates.where(F.col("config") == config).join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")


def missing_embeddings(rows: DataFrame, stored: DataFrame, key: str = "id", fp: str = "product_fp") -> DataFrame:
    """Rows whose text has no stored embedding; the fingerprint of each text is compared."""
    return rows.join(stored.select(key, fp), [key, fp], "left_anti")
