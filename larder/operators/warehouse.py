"""Staging projections of the loaded tables, and the fact table of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.vocabulary import EXCLUDED_CATEGORIES

ROW, PARENT, LOAD = "_dlt_id", "_dlt_parent_id", "_dlt_load_id"

# Columns of the loaded tables and the names that they get.
PRODUCT_COLUMNS = {
    "id": "product_id", "nan": "nan", "version": "version", "product_name": "product_name",
    "attributes__tags__discounted__label": "attributes__tags__discounted__label", "_embedded__category_path": "category_path",
    "has_variants": "has_variants", "has_diverse_variant_prices": "has_diverse_variant_prices",
    "should_details_link_be_masked": "should_details_link_be_masked", "free_shipping": "free_shipping", LOAD: LOAD, ROW: ROW,
    "attributes__tags__organic__label": "attributes__tags__organic__label", "brand__name": "brand",
    "attributes__tags__has_loyalty_bonus__label": "attributes__tags__has_loyalty_bonus__label",
    "attributes__tags__lowestprice__label": "attributes__tags__lowestprice__label", "loyalty_bonus__bonus_type": "loyalty_bonus__bonus_type",
    "loyalty_bonus__bonus_value": "loyalty_bonus__bonus_value", "attributes__tags__regional__label": "attributes__tags__regional__label",
    "attributes__tags__lactosefree__label": "attributes__tags__lactosefree__label", "attributes__tags__vegan__label": "attributes__tags__vegan__label",
    "attributes__tags__vegetarian__label": "attributes__tags__vegetarian__label", "reusable_container": "reusable_container",
    "bulky_goods_points": "bulky_goods_points",
}
ARTICLE_COLUMNS = {
    "id": "product_id", "version": "version", "gtin": "gtin", "_embedded__listing__id": "listing_id", "_embedded__listing__version": "listing_version",
    "_embedded__listing__pricing__current_retail_price": "listing_price", "_embedded__listing__pricing__currency": "listing_currency",
    "_embedded__listing__pricing__base_price": "listing_base_price", "_embedded__listing__pricing__base_unit__kg": "listing_base_unit_kg",
    "_embedded__listing__pricing__discount__regular_price": "listing_regular_price",
    "_embedded__listing__pricing__discount__discount_rate": "listing_discount_rate", "_embedded__listing__pricing__grammage": "listing_grammage",
    "_embedded__listing__limitations__order_limit": "listing_order_limit", "_embedded__store__id": "store_id",
    "_embedded__store__version": "store_version", "_embedded__merchant__id": "merchant_id", "_embedded__merchant__version": "merchant_version",
    "_embedded__merchant__name": "merchant_name", "_embedded__merchant__type": "merchant_type", "_embedded__merchant__logo": "merchant_logo",
    PARENT: PARENT, "_dlt_list_idx": "_dlt_list_idx", ROW: ROW, "_embedded__listing__pricing__base_unit__l": "listing_base_unit_l",
    "_embedded__listing__pricing__total_refund": "listing_total_refund",
    "_embedded__listing__limitations__bulky_goods_share": "listing_bulky_goods_share",
}
IMAGE_COLUMNS = {"_links__self__href": "image_link", PARENT: PARENT, "_dlt_list_idx": "_dlt_list_idx", ROW: ROW}
LOAD_COLUMNS = ("load_id", "schema_name", "status", "inserted_at", "schema_version_hash")
DISCOUNT_END = "_embedded__listing__pricing__discount__valid_to"
FACT_COLUMNS = {
    "p": ("product_id", "product_name", "category_path", "category_level_1", "category_level_2", "category_level_3", "category_level_4", "link", "brand"),
    "a": ("listing_price", "listing_regular_price", "listing_discount_rate", "listing_discount_valid_to", "listing_grammage", "extracted_grammage"),
    "i": ("image_link",),
    "l": ("inserted_at",),
}


def category_levels(path: Column, n: int = 4) -> list[Column]:
    """The first parts of a path, slashes at its end ignored; null beyond its end."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return [F.get(parts, i).alias(f"category_level_{i + 1}") for i in range(n)]


def zoned_timestamp(text: Column) -> Column:
    """An instant from a text whose zone may be CET or CEST; raises on other texts that aren't instants."""
    named = F.when(text.contains("CET"), F.replace(text, F.lit("CET"), F.lit("+01:00"))).when(text.contains("CEST"), F.replace(text, F.lit("CEST"), F.lit("+02:00"))).otherwise(text)
    return F.to_timestamp(named, "yyyy-MM-dd'T'HH:mm:ssXXX")


def grammage_prefix(grammage: Column) -> Column:
    """What stands before a base price such as ` (1 kg = ...`; null without one."""
    pattern = r"^(.*?)(?:\s\(1\s(?:kg|l))"
    return F.when(grammage.rlike(pattern), F.regexp_extract(grammage, pattern, 1))


def named(raw: DataFrame, columns: dict[str, str]) -> list[Column]:
    return [F.col(f"`{a}`").alias(b) for a, b in columns.items()]


def stage_products(raw: DataFrame, link_prefix: str = "") -> DataFrame:
    """`link_prefix`: the shop's address before product links."""
    link = F.concat(F.lit(link_prefix), F.col("_links__detail__href")).alias("link")
    return raw.select(*named(raw, PRODUCT_COLUMNS), *category_levels(F.col("_embedded__category_path")), link)


def stage_articles(raw: DataFrame) -> DataFrame:
    ends = zoned_timestamp(F.col(DISCOUNT_END)).alias("listing_discount_valid_to")
    return raw.select(*named(raw, ARTICLE_COLUMNS), ends, grammage_prefix(F.col("_embedded__listing__pricing__grammage")).alias("extracted_grammage"))


def stage_images(raw: DataFrame) -> DataFrame:
    return raw.select(*named(raw, IMAGE_COLUMNS))


def stage_loads(raw: DataFrame) -> DataFrame:
    return raw.select(*LOAD_COLUMNS)


def outside(path: Column, prefixes: tuple[str, ...] = EXCLUDED_CATEGORIES) -> Column:
    """Whether a path begins with none of the prefixes; null, so false as a filter, for a null path."""
    out = F.lit(True)
    for p in prefixes:
        out = out & ~path.startswith(p)
    return out


def fact_products(products: DataFrame, articles: DataFrame, images: DataFrame, loads: DataFrame) -> DataFrame:
    """One row for each different combination of product, article and image of a load.

    Products without an article or image have none; several images give several rows. The category filter reaches the
    scan of products. Products, articles and images meet on one key, so each is shuffled once at most; loads are few and
    Spark broadcasts them if their size allows.
    """
    p, a, i, l = products.alias("p"), articles.alias("a"), images.alias("i"), loads.alias("l")
    joined = p.where(outside(F.col("category_path"))).join(a, F.col(f"p.{ROW}") == F.col(f"a.{PARENT}")).join(i, F.col(f"p.{ROW}") == F.col(f"i.{PARENT}")).join(l, F.col(f"p.{LOAD}") == F.col("l.load_id"))
    return joined.select(*(F.col(f"{t}.{c}") for t, names in FACT_COLUMNS.items() for c in names)).distinct()


def latest(rows: DataFrame, by: str = "inserted_at") -> DataFrame:
    """The rows of the newest load. One number is aggregated and joined; rows aren't gathered."""
    newest = rows.agg(F.max(by).alias("_newest"))
    return rows.join(F.broadcast(newest), F.col(by) == F.col("_newest"), "left_semi")
