"""Weekly serving: mappings in every mode, and the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.operators import choice, quality


def serve(recipes: DataFrame, catalog: DataFrame, url_lines: DataFrame) -> dict[str, DataFrame]:
    urls = choice.url_map(url_lines)
    return {mode: choice.build_mappings(recipes, catalog, urls, mode) for mode in choice.PICKERS}


def gate(spark: SparkSession, catalog: DataFrame, recipes: DataFrame, history: str, snapshot: str) -> dict:
    return quality.run_gate(spark, quality.ids(catalog), quality.ids(catalog.where("on_offer")), quality.matched_ids(recipes), history, snapshot)
