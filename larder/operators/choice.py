"""Choice of one product for each ingredient, and mappings of recipes to products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import ingredient_name, last_segment


def packages_of(info: Column, product_id: Column) -> Column:
    """Packages needed by the map of product ids; 1 where it doesn't say a number of at least 1."""
    n = F.try_element_at(info, product_id)["packages_needed"].cast("double")
    return F.coalesce(F.when((n >= 1) & ~F.isnan(n), n.cast("int")), F.lit(1))


def cheapest_order() -> Column:
    return F.struct("cost", "pos")


def offer_order() -> Column:
    """What is on offer goes first; without any offer this is the cheapest."""
    return F.struct((~F.coalesce("on_offer", F.lit(False))).alias("not_offered"), "cost", "pos")


PICKERS: dict[str, Callable[[], Column]] = {"cheapest": cheapest_order, "offers": offer_order}


def candidates(ingredients: DataFrame, products: DataFrame) -> DataFrame:
    """Ingredients (…, product_ids, package_info) to one row for each candidate in the catalog, with its cost."""
    info = F.col("package_info") if "package_info" in ingredients.columns else F.lit(None).cast("map<string,struct<packages_needed:double>>")
    rows = ingredients.withColumn("package_info", info).select("*", F.posexplode("product_ids").alias("pos", "product_id"))
    prices = products.select(F.col("id").alias("product_id"), "price", "on_offer")
    return rows.join(prices, "product_id").withColumn("packages", packages_of(F.col("package_info"), F.col("product_id"))).withColumn("cost", F.col("price") * F.col("packages"))


def pick(rows: DataFrame, keys: list[str], mode: str = "cheapest") -> DataFrame:
    """The best candidate of each key: (keys, product_id, packages, cost). The first one wins ties."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("product_id", "packages", "cost"), PICKERS[mode]()).alias("best"))
    return best.select(*keys, "best.*")


def dedupe_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each name of a key: first raw text, cheapest product (the first wins ties), largest amount."""
    return rows.groupBy(*keys, "name").agg(
        F.min_by("raw", "pos").alias("raw"),
        F.min_by("product_id", F.struct("cost", "pos")).alias("product_id"),
        F.max("amount").alias("amount"),
        F.min("pos").alias("pos"),
    )


def url_map(lines: DataFrame, source: str = "recipe_url", target: str = "mapping_url") -> DataFrame:
    """(source, target, recipe_name) of lines (line_no, …) that have both addresses; the last line of a source wins."""
    both = lines.where((F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != ""))
    name = F.col("recipe_name") if "recipe_name" in lines.columns else F.lit(None).cast("string")
    return both.groupBy(source).agg(F.max_by(F.struct(F.col(target).alias("target"), name.alias("recipe_name")), "line_no").alias("m")).select(F.col(source).alias("U"), "m.target", F.col("m.recipe_name").alias("mapped_name"))


def build_mappings(recipes: DataFrame, products: DataFrame, urls: DataFrame, mode: str = "cheapest") -> DataFrame:
    """hash, recipe_name, url and ingredients of every recipe that has an address to map to and a product.

    recipes: (recipe_idx, N, U, I array of (raw, product_ids, optionally package_info)). Of recipes with one hash the last wins.
    """
    mapped = recipes.join(urls, "U")
    fields = [f"ing.{f.name}" for f in mapped.schema["I"].dataType.elementType.fields if f.name in ("raw", "product_ids", "package_info")]
    lines = mapped.select("recipe_idx", F.posexplode("I").alias("pos_in_recipe", "ing")).select("recipe_idx", "pos_in_recipe", *fields)
    best = pick(candidates(lines, products), ["recipe_idx", "pos_in_recipe", "raw"], mode)
    entries = best.select("recipe_idx", ingredient_name(F.col("raw")).alias("name"), "raw", "product_id", F.col("packages").alias("amount"), "cost", F.col("pos_in_recipe").alias("pos"))
    chosen = dedupe_names(entries, ["recipe_idx"]).groupBy("recipe_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "raw", "product_id", "amount"))).alias("list"))
    shown = F.transform("list", lambda e: F.struct(e["name"].alias("name"), e["raw"].alias("raw"), e["product_id"].alias("product_id"), e["amount"].alias("amount")))
    whole = mapped.join(chosen, "recipe_idx").select("recipe_idx", last_segment(F.col("target")).alias("hash"), F.coalesce(F.nullif("mapped_name", F.lit("")), "N").alias("recipe_name"), F.col("U").alias("url"), shown.alias("ingredients"))
    last = whole.groupBy("hash").agg(F.max_by(F.struct("recipe_name", "url", "ingredients"), "recipe_idx").alias("m"))
    return last.select("hash", "m.*")


def mapping_counts(recipes: DataFrame, products: DataFrame, urls: DataFrame) -> DataFrame:
    """One row: recipes mapped, without a mapping, ingredients of recipes that have one, and those without a product."""
    known = recipes.join(urls.select("U", F.lit(True).alias("known")), "U", "left")
    lines = known.where("known").select("recipe_idx", F.posexplode("I").alias("p", "ing")).select("recipe_idx", "p", "ing.product_ids")
    found = lines.select("recipe_idx", "p", F.explode("product_ids").alias("id")).join(products.select("id"), "id", "left_semi").select("recipe_idx", "p").distinct()
    per_line = lines.select("recipe_idx", "p").join(found.withColumn("hit", F.lit(1)), ["recipe_idx", "p"], "left")
    a = known.agg(F.count_if(F.col("known").isNull()).alias("no_mapping"))
    b = per_line.agg(F.count("*").alias("ingredients"), F.count_if(F.col("hit").isNull()).alias("unmatched"), F.count_distinct(F.when(F.col("hit") == 1, F.col("recipe_idx"))).alias("recipes"))
    return a.join(b, F.lit(True)).select("recipes", "no_mapping", "ingredients", "unmatched")


def lookup(mappings: DataFrame, key: str) -> DataFrame:
    return mappings.where(F.col("hash") == key)
