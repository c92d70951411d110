"""The catalog of current products and offers, and its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import fingerprint, keywords, local_date, normalize, safe
from larder.operators.warehouse import latest


def on_offer(rate: Column) -> Column:
    """Whether a discount rate is there; zero is one, NaN isn't."""
    return rate.isNotNull() & ~F.isnan(F.coalesce(rate.cast("double"), F.lit(0.0)))


def catalog(fact: DataFrame, shop_words: tuple[str, ...] = ()) -> DataFrame:
    """Records of the newest load in order of the name; regular price, discount and its end only for what is on offer."""
    offer = on_offer(F.col("listing_discount_rate"))
    if_offer = lambda c: F.when(offer, c)
    ends = F.nullif(safe(local_date(F.col("listing_discount_valid_to"))), F.lit(""))
    return (
        latest(fact)
        .orderBy("product_name")
        .select(
            F.col("product_id").cast("string").alias("id"),
            F.col("product_name").alias("name"),
            safe(F.col("brand")).alias("brand"),
            safe(F.col("category_level_1")).alias("cat1"),
            safe(F.col("category_level_2")).alias("cat2"),
            F.col("listing_price").cast("int").alias("price"),
            if_offer(F.col("listing_regular_price").cast("int")).alias("price_regular"),
            if_offer(F.col("listing_discount_rate").cast("int")).alias("discount"),
            if_offer(ends).alias("offer_until"),
            safe(F.col("listing_grammage")).alias("grammage"),
            safe(F.col("image_link")).alias("image"),
            safe(F.col("link")).alias("link"),
            offer.alias("on_offer"),
            keywords(F.col("product_name"), shop_words).alias("keywords"),
        )
    )


def product_text(name: Column, cat1: Column, cat2: Column) -> Column:
    """Name and the finest category there is."""
    category = F.coalesce(F.nullif(cat2, F.lit("")), F.nullif(cat1, F.lit("")), F.lit(""))
    return F.concat(name, F.lit(" | "), category)


def prepared(products: DataFrame) -> DataFrame:
    """Products (prod_idx, id, name, cat1, cat2) with text, normalized text, category and fingerprint for matching."""
    text = product_text(F.col("name"), F.col("cat1"), F.col("cat2"))
    category = F.coalesce(F.nullif("cat2", F.lit("")), F.col("cat1"), F.lit(""))
    return products.select("*", text.alias("text"), normalize(text).alias("norm"), category.alias("category"), fingerprint(text).alias("product_fp"))


def catalog_hash(products: DataFrame) -> DataFrame:
    """One row with a hash of all ids and names in order of the id.

    Rows are hashed and combined in ranges of ids, then the ranges' hashes: the list that is gathered has a fixed length,
    however many products there are.
    """
    keyed = products.select(F.col("id").cast("string").alias("id"), F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("name", F.lit(""))), 256).alias("h"))
    parts = keyed.groupBy(F.substring(F.sha2("id", 256), 1, 2).alias("part")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    return parts.agg(F.substring(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])), 256), 1, 16).alias("catalog_hash"))


def ordered_hash(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The sha256 over `key|name` of all rows in order of the key, 16 digits; for small tables, since it gathers the text."""
    text = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(name).alias("n")))), lambda x: F.concat(x["k"], F.lit("|"), x["n"]))
    return rows.agg(F.substring(F.sha2(F.concat_ws("", text), 256), 1, 16).alias("catalog_hash"))
