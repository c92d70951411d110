"""Command line: match recipes with products, build mappings, run the quality gate.

    python -m larder match --recipes R.jsonl --products P --out DIR [--from-matched] [--top-k 25] [--threshold 0.5] [--cache DIR] [--no-reuse]
    python -m larder serve --matched DIR --catalog DIR --urls U.jsonl --out DIR
    python -m larder gate --matched DIR --catalog DIR --history DIR --snapshot DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.quality import summary
from larder.plans import matcher, serving
from larder.plans.config import MatchConfig
from larder.session import ship
from larder.sources import tables


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """With a number that grows in the order of the files."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larder", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    m = commands.add_parser("match")
    for name in ("recipes", "products", "out"):
        m.add_argument(f"--{name}", required=True)
    m.add_argument("--from-matched", action="store_true")
    m.add_argument("--top-k", type=int, default=MatchConfig.top_k)
    m.add_argument("--threshold", type=float, default=MatchConfig.threshold)
    m.add_argument("--cache")
    m.add_argument("--no-reuse", action="store_true")
    s = commands.add_parser("serve")
    g = commands.add_parser("gate")
    for q, names in ((s, ("matched", "catalog", "urls", "out")), (g, ("matched", "catalog", "history", "snapshot"))):
        for name in names:
            q.add_argument(f"--{name}", required=True)
    return p


def run_match(spark: SparkSession, a: argparse.Namespace) -> None:
    recipes = tables.recipes_from_matched(spark.read.schema(tables.MATCHED_SCHEMA).json(a.recipes)) if a.from_matched else tables.read_recipes(spark, a.recipes)
    products = tables.read_products_csv(spark, a.products) if a.products.endswith(".csv") else tables.products_from_catalog(spark.read.json(a.products))
    config = MatchConfig(top_k=a.top_k, threshold=a.threshold, reuse=not a.no_reuse)
    scores, candidates = ((tables.read_snapshot(spark, f"{a.cache}/{n}") for n in ("scores", "candidates")) if a.cache else (None, None))
    out = matcher.match(spark, numbered(recipes, "recipe_idx"), numbered(products, "prod_idx"), config, score_cache=scores, candidate_cache=candidates)
    tables.write_matched(out.recipes.drop("recipe_idx"), a.out)
    if a.cache:
        tables.write_snapshot(out.scores, f"{a.cache}/scores")
        tables.write_snapshot(out.candidates, f"{a.cache}/candidates")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("larder").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if a.command == "match":
        return run_match(spark, a)
    catalog, matched = spark.read.json(a.catalog), spark.read.schema(tables.MATCHED_SCHEMA).json(a.matched)
    if a.command == "serve":
        for mode, mappings in serving.serve(numbered(matched, "recipe_idx"), catalog, tables.read_url_lines(spark, a.urls)).items():
            tables.write_mappings(mappings, a.out, mode)
    else:
        print(summary(serving.gate(spark, catalog, matched, a.history, a.snapshot)))


if __name__ == "__main__":
    main()
