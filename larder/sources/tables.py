"""Readers and writers of catalogs, recipes, mappings, caches and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import last_segment, strip, total_time

RECIPE_SCHEMA = (
    "name string, mainEntityOfPage string, recipeYield string, aggregateRating struct<ratingValue:double,ratingCount:bigint>, totalTime string, image string, "
    "recipeCategory string, keywords string, recipeIngredient array<string>"
)
MATCHED_SCHEMA = (
    "N string, U string, `yield` string, rating double, rating_count bigint, time string, image string, category string, keywords array<string>, "
    "I array<struct<raw:string,product_ids:array<string>,package_info:map<string,struct<packages_needed:double>>>>"
)


def register(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """Temporary views of a folder's Parquet tables."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def append_table(rows: DataFrame, name: str) -> None:
    rows.write.mode("append").saveAsTable(name)


def replace_table(rows: DataFrame, name: str) -> None:
    rows.write.mode("overwrite").saveAsTable(name)


def bare_lines(lines: str | F.Column) -> F.Column:
    """Lines without white space around them, empty ones dropped."""
    return F.filter(F.transform(F.filter(lines, lambda x: x.isNotNull()), strip), lambda x: x != "")


def recipes_from_jsonl(rows: DataFrame) -> DataFrame:
    """Recipes of schema.org records that have ingredients; missing texts are empty, keywords cut at commas."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return (
        rows.withColumn("I_raw", bare_lines("recipeIngredient"))
        .where(F.size("I_raw") > 0)
        .select(
            strip(text(F.col("name"))).alias("N"),
            text(F.col("mainEntityOfPage")).alias("U"),
            text(F.col("recipeYield")).alias("yield"),
            F.col("aggregateRating.ratingValue").alias("rating"),
            F.col("aggregateRating.ratingCount").alias("rating_count"),
            total_time(F.col("totalTime")).alias("time"),
            text(F.col("image")).alias("image"),
            text(F.col("recipeCategory")).alias("category"),
            F.transform(F.split(text(F.col("keywords")), ","), strip).alias("keywords"),
            "I_raw",
        )
    )


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return recipes_from_jsonl(spark.read.schema(RECIPE_SCHEMA).json(path))


def recipes_from_matched(rows: DataFrame) -> DataFrame:
    """Recipes of an earlier result; its product ids are ignored."""
    lines = rows.withColumn("I_raw", bare_lines(F.transform("I", lambda i: i["raw"]))).where(F.size("I_raw") > 0)
    return lines.select("N", "U", "yield", "rating", "rating_count", "time", "image", "category", "keywords", "I_raw")


def read_matched(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCHED_SCHEMA).option("multiLine", True).json(path)


def write_matched(recipes: DataFrame, path: str) -> None:
    """Recipes with their matches, one JSON object a line."""
    recipes.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Products (id, name, cat1, cat2) of a CSV file with a header; missing categories are empty."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(F.col("product_id").cast("string").alias("id"), F.col("product_name").alias("name"), F.coalesce("category_level_1", F.lit("")).alias("cat1"), F.coalesce("category_level_2", F.lit("")).alias("cat2"))


def products_from_catalog(catalog: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return catalog.select(F.col("id").cast("string").alias("id"), text("name"), text("cat1"), text("cat2"))


def write_catalog(catalog: DataFrame, path: str) -> None:
    """One JSON object a line. NaN, which JSON has not, raises."""
    numbers = [c for c, t in catalog.dtypes if t in ("double", "float")]
    checked = catalog
    for c in numbers:
        checked = checked.withColumn(c, F.when(F.isnan(c), F.raise_error(F.lit(f"{c} is NaN"))).otherwise(F.col(c)))
    checked.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_url_lines(spark: SparkSession, path: str, source: str = "recipe_url", target: str = "mapping_url") -> DataFrame:
    """Lines of JSONL files of addresses with their place, by which later lines win: file, block of the file, and row number, which
    rises within a block. Files are read in blocks, by as many tasks as there are."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(place.alias("line_no"), "value")
    parsed = lines.select("line_no", F.from_json("value", f"{source} string, {target} string, recipe_name string").alias("j"))
    return parsed.select("line_no", "j.*")


def write_mappings(mappings: DataFrame, path: str, mode: str) -> None:
    """Mappings of one mode (cheapest or offers) beside those of others, in place of that mode's earlier ones."""
    mappings.withColumn("mode", F.lit(mode)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").json(path)


def point_lookup(mappings: DataFrame, page_url: str) -> DataFrame:
    return mappings.where(F.col("hash") == last_segment(F.lit(page_url)))


def hadoop(spark: SparkSession, path: str):
    """The file system of a path and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions below a path, in order."""
    fs, at = hadoop(spark, path)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    done = [p.getName() for p in found if p.getName().startswith("v=") and fs.exists(hadoop(spark, f"{p}/_SUCCESS")[1])]
    return sorted(int(n[2:]) for n in done)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest finished version; None if there is none."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def write_snapshot(rows: DataFrame, path: str, keep: int = 2) -> None:
    """Write a new version in full, then drop all but the newest `keep`; no version is overwritten while it is read."""
    spark = rows.sparkSession
    found = versions(spark, path)
    rows.write.parquet(f"{path}/v={found[-1] + 1 if found else 1}")
    for v in [*found, 0][: len(found) + 1 - keep] if found else []:
        fs, at = hadoop(spark, f"{path}/v={v}")
        fs.delete(at, True)
