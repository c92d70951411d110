import json

from pyspark.sql import functions as F

from larder.__main__ import main
from larder.functions import text
from larder.plans.config import MatchConfig


def test_commands(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    recipes = [{"name": "A", "mainEntityOfPage": "https://r/a", "recipeIngredient": ["2 Zwiebeln", "1 l Milch"]}, {"name": "B", "mainEntityOfPage": "https://r/b", "recipeIngredient": ["3 Zwiebeln"]}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, recipes)))
    products = [{"id": i, "name": n, "cat1": "C", "cat2": "", "price": 100 + i, "on_offer": i == 2} for i, n in enumerate(["Zwiebeln", "Milch frisch", "Zwiebeln rot"])]
    (tmp_path / "catalog.json").write_text("\n".join(map(json.dumps, products)))
    (tmp_path / "u.jsonl").write_text(json.dumps({"recipe_url": "https://r/a", "mapping_url": "https://m/h1"}))
    args = ["match", "--recipes", at("r.jsonl"), "--products", at("catalog.json"), "--cache", at("cache"), "--top-k", "3", "--threshold", "0.3"]
    main([*args, "--out", at("matched")], spark)
    main([*args, "--out", at("again")], spark)  # from the caches
    rows = [sorted(spark.read.json(at(n)).collect()) for n in ("matched", "again")]
    assert rows[0] == rows[1] and len(rows[0]) == 2
    main(["match", "--recipes", at("matched"), "--from-matched", "--products", at("catalog.json"), "--out", at("third"), "--no-reuse", "--top-k", "3", "--threshold", "0.3"], spark)
    assert [r.I for r in sorted(spark.read.json(at("third")).collect(), key=lambda r: r.N)] == [r.I for r in sorted(rows[0], key=lambda r: r.N)]
    main(["serve", "--matched", at("matched"), "--catalog", at("catalog.json"), "--urls", at("u.jsonl"), "--out", at("map")], spark)
    assert {(r["mode"], r.hash) for r in spark.read.json(at("map")).collect()} == {("cheapest", "h1"), ("offers", "h1")}
    main(["gate", "--matched", at("matched"), "--catalog", at("catalog.json"), "--history", at("history"), "--snapshot", at("snapshot")], spark)
    assert "| catalog | 3 |" in capsys.readouterr().out


def test_small_functions(spark):
    row = spark.range(1).select(text.euros(F.lit(123456)).alias("a"), text.euros(F.lit(-5)).alias("b"), text.percent_done(F.lit(1), F.lit(3)).alias("c"), text.percent_done(F.lit(1), F.lit(0)).alias("d")).first()
    assert tuple(row) == ("1234,56 €", "-0,05 €", 33, 0)
    config = MatchConfig().with_sidecars({"threshold.json": '{"threshold": 0.7}', "version.txt": "v2\n"})
    assert (config.threshold, config.model_hash) == (0.7, "v2")
