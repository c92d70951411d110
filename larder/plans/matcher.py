"""Matching recipes' ingredients with products: dedup, retrieval, scoring of what no cache holds, filters, assembly."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.rules import vetoed
from larder.functions.text import dedup_key, fingerprint, is_pantry, normalize
from larder.operators import cache as C
from larder.operators import scoring as S
from larder.operators.catalog import catalog_hash, prepared
from larder.operators.retrieval import Embedder, embed, hashed_embedding, retrieve
from larder.plans.config import MatchConfig
from larder.sources.tables import MATCHED_SCHEMA


@dataclass
class Matched:
    recipes: DataFrame
    matches: DataFrame
    scores: DataFrame
    candidates: DataFrame


def occurrences(recipes: DataFrame) -> DataFrame:
    """(recipe_idx, ing_idx, raw, dedup_key) of recipes (recipe_idx, …, I_raw)."""
    return recipes.select("recipe_idx", F.posexplode("I_raw").alias("ing_idx", "raw")).withColumn("dedup_key", dedup_key(F.col("raw")))


def active_keys(occ: DataFrame) -> DataFrame:
    """(dedup_key, raw, query, raw_fp): each key's first line; empty names and pantry goods don't count."""
    first = occ.where(~F.col("dedup_key").startswith("|")).groupBy("dedup_key").agg(F.min_by("raw", F.struct("recipe_idx", "ing_idx")).alias("raw"))
    keyed = first.withColumn("query", normalize(F.col("raw"))).withColumn("raw_fp", fingerprint(F.col("raw")))
    return keyed.where((F.col("query") != "") & ~is_pantry(F.col("query")))


def dedup_ratio(occ: DataFrame) -> DataFrame:
    """One row: share of lines that need no scoring of their own; null without lines."""
    return occ.agg((1 - F.count_distinct("dedup_key") / F.nullif(F.count("*"), F.lit(0))).alias("dedup_ratio"), F.count_distinct("dedup_key").alias("n_keys"))


#: Bytes of matches that are sent to each task.
FEW = 4 << 20


def looked_up(recipes: DataFrame, matches: DataFrame) -> DataFrame | None:
    """`assemble` without a shuffle, whatever the lists' length: lines look their matches up in one value of some FEW bytes at most, a
    list of maps by the keys' hashes; None if the matches are more."""
    matches = matches.where(F.col("dedup_key").isNotNull())
    n, size = matches.agg(F.count("*"), F.sum(F.length("dedup_key") + F.length(F.array_join("product_ids", "   ", "null")))).first()
    if (size or 0) > FEW:
        return None
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(max(1, n))).cast("int")
    maps: list[dict[str, list[str]]] = [{} for _ in range(max(1, n))]
    for key, ids, at in matches.select("dedup_key", "product_ids", place(F.col("dedup_key"))).collect():
        maps[at][key] = ids
    # one constant: the optimizer reads it once
    known = F.from_json(F.lit(json.dumps(maps)), "array<map<string,array<string>>>")
    found = lambda key: F.try_element_at(F.get(known, place(key)), key)
    whole = F.transform("I_raw", lambda raw: F.struct(raw.alias("raw"), F.coalesce(found(dedup_key(raw)), F.array().cast("array<string>")).alias("product_ids")))
    return recipes.where(F.size("I_raw") > 0).withColumn("I", whole).drop("I_raw")


def assemble(recipes: DataFrame, occ: DataFrame, matches: DataFrame) -> DataFrame:
    """Recipes with I, an array of (raw, product_ids), in the lines' order; no match gives an empty list."""
    lines = occ.join(matches, "dedup_key", "left").select("recipe_idx", F.struct("ing_idx", "raw", F.coalesce("product_ids", F.array().cast("array<string>")).alias("product_ids")).alias("i"))
    ordered = lines.groupBy("recipe_idx").agg(F.transform(F.sort_array(F.collect_list("i")), lambda i: F.struct(i["raw"].alias("raw"), i["product_ids"].alias("product_ids"))).alias("I"))
    return recipes.drop("I_raw").join(ordered, "recipe_idx")


def store(recipes: DataFrame, matches: DataFrame, path: str) -> None:
    """The matched recipes (…, I_raw) as JSON lines with each list of matches once, so files grow with lines and matches, not with their
    product: `recipes` with I's raw lines, `lines` (raw, dedup_key), each line once, `matches` (dedup_key, product_ids)."""
    write = lambda rows, name: rows.write.mode("overwrite").json(f"{path}/{name}", compression="gzip", ignoreNullFields=False)
    write(recipes.where(F.size("I_raw") > 0).withColumn("I", F.transform("I_raw", lambda raw: F.struct(raw.alias("raw")))).drop("I_raw"), "recipes")
    raw = stored_recipes(recipes.sparkSession, path).select(F.explode("I.raw").alias("raw")).where("raw IS NOT NULL").distinct()
    write(raw.withColumn("dedup_key", dedup_key(F.col("raw"))), "lines")
    write(matches.select("dedup_key", "product_ids"), "matches")


def stored_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Stored recipes without their matches."""
    return spark.read.schema(MATCHED_SCHEMA).json(f"{path}/recipes")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Stored recipes with I as `assemble` gives it, numbered in the order of the files."""
    recipes = stored_recipes(spark, path).withColumn("recipe_idx", F.monotonically_increasing_id()).withColumn("I_raw", F.col("I.raw")).drop("I")
    lines = spark.read.schema("raw string, dedup_key string").json(f"{path}/lines")
    occ = recipes.select("recipe_idx", F.posexplode("I_raw").alias("ing_idx", "raw")).join(lines, "raw", "left")
    return assemble(recipes, occ, spark.read.schema("dedup_key string, product_ids array<string>").json(f"{path}/matches"))


def match(
    spark: SparkSession, recipes: DataFrame, products: DataFrame, config: MatchConfig = MatchConfig(), *,
    embedder: Embedder = hashed_embedding, scorer: S.PairScorer = S.stand_in_scorer, predict=None,
    score_cache: DataFrame | None = None, candidate_cache: DataFrame | None = None,
) -> Matched:
    """recipes: (recipe_idx, …, I_raw); products: (prod_idx, id, name, cat1, cat2).

    With `predict`, the boosted model's probability replaces the score for the threshold; the order stays that of scores.
    """
    catalog = prepared(products)
    occ = occurrences(recipes)
    keys = active_keys(occ)
    print_of = config.fingerprint(catalog_hash(products).first().catalog_hash)
    found = None
    wanted = keys
    if config.reuse and candidate_cache is not None:
        found = C.current_candidates(candidate_cache, products, print_of).select("dedup_key", "pos", "product_id")
        wanted = C.missing_keys(keys, candidate_cache, print_of)
    asked = embed(wanted.select(F.col("dedup_key").alias("key"), "query"), "query", embedder)
    fresh = retrieve(asked, embed(catalog, "text", embedder), k=config.top_k).withColumnRenamed("key", "dedup_key")
    candidates = fresh if found is None else found.unionByName(fresh)
    pairs = candidates.join(keys, "dedup_key").join(catalog.withColumnRenamed("id", "product_id"), "product_id")
    known = None
    if config.reuse and score_cache is not None:
        known = C.valid_scores(score_cache, catalog, config.model_hash).select(*C.PAIR, "score")
        scored = S.score_pairs(C.missing_pairs(pairs, known), scorer)
        scored = scored.unionByName(pairs.join(known, C.PAIR).select(*scored.columns))
    else:
        scored = S.score_pairs(pairs, scorer)
    kept = scored
    if predict is not None:
        both = embed(embed(kept, "query", embedder, "ing_emb"), "text", embedder, "prod_emb")
        kept = S.boosted(S.features(both, ingredient="query"), predict)
    kept = S.passing(kept, config.threshold).where(~vetoed(F.col("raw"), F.col("name"), F.col("category")))
    order = F.sort_array(F.collect_list(F.struct("score", "prod_idx", "product_id")), asc=False)
    matches = kept.groupBy("dedup_key").agg(F.transform(order, lambda x: x["product_id"]).alias("product_ids"))
    stored = C.kept_scores(scored.select(*C.PAIR, "score", "product_fp", F.lit(config.model_hash).alias("model_hash")), keys, products)
    return Matched(assemble(recipes, occ, matches), matches, stored, candidates.withColumn("config", F.lit(print_of)))


def match_rate(recipes: DataFrame) -> DataFrame:
    """One row: lines, matched lines, their share (null without lines), mean and most matches of matched lines."""
    sizes = recipes.select(F.explode(F.transform("I", lambda i: F.size(i["product_ids"]))).alias("n"))
    hit = F.col("n") > 0
    return sizes.agg(
        F.count("*").alias("lines"), F.count_if(hit).alias("matched"), (F.count_if(hit) / F.nullif(F.count("*"), F.lit(0))).alias("rate"),
        F.avg(F.when(hit, F.col("n"))).alias("mean_matches"), F.max(F.when(hit, F.col("n"))).alias("most_matches"),
    )
