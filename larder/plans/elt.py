"""From landed pages to the fact table and the catalog, as one plan per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.operators import warehouse as W
from larder.operators.catalog import catalog
from larder.sources import landing

ARTICLES, IMAGES = "products___embedded__articles", "products__media__images"


def fact_from_tables(tables: dict[str, DataFrame], loads: DataFrame, link_prefix: str = "", articles: str = ARTICLES, images: str = IMAGES) -> DataFrame:
    return W.fact_products(W.stage_products(tables["products"], link_prefix), W.stage_articles(tables[articles]), W.stage_images(tables[images]), W.stage_loads(loads))


def run(spark: SparkSession, folder: str, load_id: str, inserted_at: str, schema=None, link_prefix: str = "", shop_words: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The newest landed folder's fact table and catalog. Without any file the result is empty."""
    newest = landing.newest_folder(landing.files(spark, folder))
    if newest is None:
        return {}
    tables = landing.normalize(landing.unnest(landing.read_pages(spark, newest, schema)), "products", load_id)
    fact = fact_from_tables(tables, landing.load_row(spark, load_id, "shop", inserted_at), link_prefix)
    return {**tables, "fact": fact, "catalog": catalog(fact, shop_words)}
