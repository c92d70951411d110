"""Operators on small fixtures with nulls, ties and empty inputs."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from larder.operators import cache, catalog, choice, pages, preprocess, quality, retrieval, scoring, warehouse
from larder.plans import elt, matcher, serving
from larder.plans.config import MatchConfig
from larder.sources import landing, tables
from larder.streaming.landing import page_stream, windowed_counts, write_parquet

PAGE_SCHEMA = (
    "pagination struct<totalPages:int>, _embedded struct<products:array<struct<id:string,nan:string,version:string,product_name:string,brand:struct<name:string>,"
    "attributes:struct<tags:struct<discounted:struct<label:string>,organic:struct<label:string>,has_loyalty_bonus:struct<label:string>,lowestprice:struct<label:string>,"
    "regional:struct<label:string>,lactosefree:struct<label:string>,vegan:struct<label:string>,vegetarian:struct<label:string>>>,"
    "has_variants:boolean,has_diverse_variant_prices:boolean,should_details_link_be_masked:boolean,free_shipping:boolean,loyalty_bonus:struct<bonus_type:string,bonus_value:double>,"
    "reusable_container:boolean,bulky_goods_points:double,_links:struct<detail:struct<href:string>>,media:struct<images:array<struct<_links:struct<self:struct<href:string>>>>>,"
    "_embedded:struct<category_path:string,articles:array<struct<id:string,version:string,gtin:string,_embedded:struct<listing:struct<id:string,version:string,"
    "pricing:struct<current_retail_price:int,currency:string,base_price:int,base_unit:struct<kg:double,l:double>,discount:struct<regular_price:int,discount_rate:double,valid_to:string>,"
    "grammage:string,total_refund:double>,limitations:struct<order_limit:int,bulky_goods_share:double>>,store:struct<id:string,version:string>,"
    "merchant:struct<id:string,version:string,name:string,type:string,logo:string>>>>>>>>"
)


def product(i, name, category, price, rate=None, ends=None, images=("a",), grammage="132g (1 kg = 16,59 €)"):
    pricing = {"current_retail_price": price, "grammage": grammage, "discount": {"regular_price": price + 50, "discount_rate": rate, "valid_to": ends}}
    article = {"id": i, "_embedded": {"listing": {"id": f"l{i}", "pricing": pricing}}}
    return {"id": i, "product_name": name, "brand": {"name": "B"}, "_links": {"detail": {"href": f"/p/{i}"}}, "media": {"images": [{"_links": {"self": {"href": x}}} for x in images]}, "_embedded": {"category_path": category, "articles": [article]}}


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    products = [
        product("1", "Zimt gemahlen", "Gewürze/Backen/A/B//", 219, 24.0, "2026-06-28T21:59:59CEST", ("a", "b")),
        product("2", "Apfel rot", "Obst/", 150),
        product("3", "Katzenfutter", "Tierbedarf/Katze", 99),
        product("4", "Ohne Bild", "Obst", 100, images=()),
        product("5", "Ohne Pfad", None, 100),
    ]
    old, new = folder / "2026-01-01", folder / "2026-02-02"
    for d, items in ((old, products[:1]), (new, products)):
        d.mkdir()
        (d / "page_1.json").write_text(json.dumps({"pagination": {"totalPages": 1}, "_embedded": {"products": items}}))
    import os

    os.utime(old / "page_1.json", (1, 1))
    return str(folder)


def test_elt(spark, landed):
    out = elt.run(spark, landed, "load1", "2026-02-02 10:00:00", spark.createDataFrame([], PAGE_SCHEMA).schema, "https://shop", ("b",))
    fact = {(r.product_id, r.image_link): r for r in out["fact"].collect()}
    assert sorted(fact) == [("1", "a"), ("1", "b"), ("2", "a")]
    row = fact["1", "a"]
    assert (row.category_level_1, row.category_level_2, row.category_level_4, row.link, row.extracted_grammage) == ("Gewürze", "Backen", "B", "https://shop/p/1", "132g")
    assert row.listing_discount_valid_to == datetime(2026, 6, 28, 19, 59, 59)
    assert fact["2", "a"].category_level_2 is None and fact["2", "a"].listing_discount_rate is None
    records = out["catalog"].collect()
    assert [r.name for r in records] == ["Apfel rot", "Zimt gemahlen", "Zimt gemahlen"]
    assert (records[0].on_offer, records[0].price_regular, records[0].offer_until) == (False, None, None)
    assert (records[1].on_offer, records[1].discount, records[1].offer_until, records[1].keywords) == (True, 24, "2026-06-28", ["zimt", "gemahlen"])
    again = landing.normalize(landing.unnest(landing.read_pages(spark, landed, spark.createDataFrame([], PAGE_SCHEMA).schema)), "products", "load1")
    assert set(again) == {"products", "products__media__images", "products___embedded__articles"}
    assert again["products"].count() == 6 and again["products"].select("_dlt_id").distinct().count() == 6


def test_landing_helpers(spark, landed, tmp_path):
    assert landing.newest_folder(landing.files(spark, landed)).endswith("2026-02-02")
    (tmp_path / "empty").mkdir()
    assert elt.run(spark, str(tmp_path / "empty"), "x", "2026-01-01 00:00:00") == {}
    landing.write_pages(spark.range(2), str(tmp_path / "pages"))
    assert "load_timestamp" in landing.with_load_time(landing.read_pages(spark, str(tmp_path / "pages"))).columns
    with pytest.raises(Exception, match="CANNOT_PARSE|could not be parsed"):
        spark.createDataFrame([("nonsense",)], "t string").select(warehouse.zoned_timestamp(F.col("t"))).collect()


def test_streams(spark, landed, tmp_path):
    rows = page_stream(spark, landed, spark.createDataFrame([], PAGE_SCHEMA).schema).select("id", "product_name")
    for _ in range(2):  # what has been read isn't read again
        write_parquet(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    schema = "ts timestamp, event_type string, value double"
    for i, (day, at) in enumerate([("2024-01-01", "10:05:00"), ("2024-01-01", "12:00:00"), ("2024-01-01", "12:05:00"), ("2024-01-01", "10:01:00"), ("2024-01-02", "00:00:00")]):
        spark.createDataFrame([(datetime.fromisoformat(f"{day} {at}"), "a", 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"ev/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "ev"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.start.hour, r.n) for r in spark.table("windows").collect()} == {(10, 1), (12, 2)}  # the late event isn't counted


def recipes_of(spark):
    lines = [
        (0, "A", "u0", [("2 Zwiebeln", ["p1", "p2", "gone"]), ("Zwiebeln, rot", ["p2"]), ("Salz", [])]),
        (1, "B", "u1", [("Milch", ["p3", "p2"])]),
        (2, "C", "none", [("Milch", ["p3"])]),
        (3, "D", "u3", [("Salz", [])]),
        (4, "E", "u4", [("Milch", ["p3"])]),
    ]
    rows = [(i, n, u, [(raw, ids, {"p1": (float(k),)}) for raw, ids in ing]) for (i, n, u, ing), k in zip(lines, (3, 1, 1, 1, 1))]
    return spark.createDataFrame(rows, "recipe_idx long, N string, U string, I array<struct<raw:string,product_ids:array<string>,package_info:map<string,struct<packages_needed:double>>>>")


PRODUCTS = [("p1", 100, False), ("p2", 300, True), ("p3", 300, False)]


def test_mappings(spark):
    products = spark.createDataFrame(PRODUCTS, "id string, price int, on_offer boolean")
    urls = spark.createDataFrame([(0, "u0", "https://m/h0/", None), (1, "u0", "https://m/h0b", "Renamed"), (2, "u1", "https://m/h1", ""), (3, "u3", "https://m/h3", None), (4, "u4", "https://m/h1//", None), (5, None, "https://m/x", None), (6, "u2", "", None)], "line_no int, recipe_url string, mapping_url string, recipe_name string")
    out = serving.serve(recipes_of(spark), products, urls)
    cheap = {r.hash: r for r in out["cheapest"].collect()}
    assert sorted(cheap) == ["h0b", "h1"]
    assert [tuple(e) for e in cheap["h0b"].ingredients] == [("zwiebeln", "2 Zwiebeln", "p1", 3)]  # 3 packages of 100 tie with 300; the first wins
    assert cheap["h0b"].recipe_name == "Renamed" and cheap["h1"].recipe_name == "E"  # the later recipe of one hash
    offers = {r.hash: r for r in out["offers"].collect()}
    assert offers["h0b"].ingredients[0].product_id == "p2" and offers["h1"].ingredients[0].product_id == "p3"
    counts = choice.mapping_counts(recipes_of(spark), products, choice.url_map(urls)).first()
    assert tuple(counts) == (3, 1, 6, 2)
    assert choice.lookup(out["cheapest"], "h1").count() == tables.point_lookup(out["cheapest"], "https://m/h1/").count() == 1


def test_package_map(spark):
    info = "map<string,struct<packages_needed:double>>"
    rows = spark.createDataFrame([({"a": (2.9,)},), ({"a": (0.5,)},), ({"a": (float("nan"),)},), ({"a": None},), ({},), (None,)], f"m {info}")
    assert [r[0] for r in rows.select(choice.packages_of(F.col("m"), F.lit("a"))).collect()] == [2, 1, 1, 1, 1, 1]


def test_quality_gate(spark, tmp_path):
    ids = lambda xs: quality.ids(spark.createDataFrame([(x,) for x in xs], "id string"))
    path = [str(tmp_path / x) for x in ("history", "snapshot")]
    first = quality.run_gate(spark, ids("abc"), ids("b"), ids("bcx"), *path, day=date(2026, 1, 1))
    assert (first["stale"], first["missed_deals"], first["new_ids"], first["stale_sample"], first["error"], first["warning"]) == (1, 0, None, ["x"], True, False)
    second = quality.run_gate(spark, ids("abd"), ids("d"), ids("bc"), *path, day=date(2026, 1, 8))
    assert (second["new_ids"], second["gone_matched"], second["missed_deals"]) == (1, 1, 1)
    third = quality.run_gate(spark, ids("ab"), ids(""), ids(""), *path)
    assert third["new_ids"] == 0 and spark.read.parquet(path[0]).count() == 3 and tables.versions(spark, path[1]) == [2, 3]
    assert "| stale | 1 |" in quality.summary(first) and "new_ids=\n" in quality.outputs(first)


GOLDEN = [
    (["Salz und Pfeffer", "Salz"], ["Salz", "Pfeffer"], ["split", "dedup"]),
    (["500 g Mehl", "1 kg Mehl"], ["1500 g Mehl"], ["merge"]),
    (["1 TL Zucker", "2 TL Zucker", "Zucker"], ["3 TL Zucker"], ["merge"]),
    (["1 Prise(n) Salz", "1 TL Salz"], ["1 Prise(n) Salz"], ["dedup"]),
    (["200 g Zwiebel", "2 Zwiebel"], ["200 g Zwiebel", "2 Zwiebel"], ["skip_ambiguous"]),
    (["1,5 l Milch", "250 ml Milch", "evtl. Milch"], ["1750 ml Milch"], ["merge"]),
    (["2 Knoblauchzehe(n)", "3 Knoblauchzehe(n)"], ["5 Knoblauchzehe(n)"], ["merge"]),
    (["Tomaten", "Dose Tomaten"], ["Tomaten", "Dose Tomaten"], []),
    (["1,25 TL Zimt", "0,5 TL Zimt"], ["1.75 TL Zimt"], ["merge"]),
]


@pytest.mark.parametrize("lines,want,ops", GOLDEN)
def test_preprocess(spark, lines, want, ops):
    frame = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "recipe_idx long, ing_idx int, raw string")
    out, log = preprocess.preprocess(frame)
    assert out.first().ingredients == want
    assert [r.type for r in log.orderBy("seq").collect()] == ops


def catalog_rows(spark):
    names = ["Zwiebeln rot", "Zwiebeln gelb", "Milch frisch", "Mehl Type 405", "Zimt gemahlen", "Pfeffer ganz", "Tomaten passiert", "Apfel"]
    return spark.createDataFrame([(i, f"p{i}", n, "Kategorie", "" if i % 2 else "Fein") for i, n in enumerate(names)], "prod_idx long, id string, name string, cat1 string, cat2 string")


def matched_recipes(spark):
    return spark.createDataFrame([(0, "A", ["2 Zwiebeln", "Salz", "1 l Milch", ""]), (1, "B", ["3 Zwiebeln", "heißes Wasser", "Prise(n) Pfeffer"])], "recipe_idx long, N string, I_raw array<string>")


def test_matcher_and_caches(spark):
    config = MatchConfig(top_k=3, threshold=0.4)
    cold = matcher.match(spark, matched_recipes(spark), catalog_rows(spark), config)
    found = {r.recipe_idx: r.I for r in cold.recipes.collect()}
    assert [i.raw for i in found[0]] == ["2 Zwiebeln", "Salz", "1 l Milch", ""]
    assert set(found[0][0].product_ids) == {"p0", "p1"} and found[0][0].product_ids == found[1][0].product_ids
    assert found[1][1].product_ids == [] and "p5" not in found[1][2].product_ids  # pantry; whole pepper for a pinch
    scores, candidates = cold.scores.cache(), cold.candidates.cache()
    calls = spark.sparkContext.accumulator(0)

    def counting(raws, texts):
        calls.add(len(raws))
        return scoring.stand_in_scorer(raws, texts)

    warm = matcher.match(spark, matched_recipes(spark), catalog_rows(spark), config, scorer=counting, score_cache=scores, candidate_cache=candidates)
    assert {r.recipe_idx: r.I for r in warm.recipes.collect()} == found and calls.value == 0
    renamed = catalog_rows(spark).withColumn("name", F.when(F.col("id") == "p0", "Zwiebeln lila").otherwise(F.col("name")))
    assert cache.valid_scores(scores, catalog.prepared(renamed), "stand-in").where("product_id = 'p0'").count() == 0
    assert cache.valid_scores(scores, catalog.prepared(renamed), "other").count() == 0
    assert cache.cache_counts(scores, cache.valid_scores(scores, catalog.prepared(renamed), "stand-in")).first().dropped > 0
    boosted = matcher.match(spark, matched_recipes(spark), catalog_rows(spark), config, predict=lambda x: (x[:, 4] > 0).astype(float) if x.shape[1] == 17 else None)
    assert {r.recipe_idx: r.I for r in boosted.recipes.collect()}[0][0].product_ids
    rate = matcher.match_rate(cold.recipes).first()
    assert rate.lines == 7 and rate.matched == sum(bool(i.product_ids) for r in found.values() for i in r)
    assert matcher.match_rate(cold.recipes.limit(0)).first().rate is None
    assert matcher.dedup_ratio(matcher.occurrences(matched_recipes(spark)).limit(0)).first().dedup_ratio is None


def test_retrieval_variants_agree(spark):
    products = retrieval.embed(catalog.prepared(catalog_rows(spark)), "text")
    keys = retrieval.embed(spark.createDataFrame([(q, q) for q in ("zwiebeln", "milch", "zimt gemahlen", "e")], "key string, query string"), "query")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for k in (1, 2, 5, 20):
        small = rows(retrieval.retrieve(keys, products, k=k))
        assert small == rows(retrieval.retrieve_by_ranks(keys, products, k=k, block=3)) == rows(retrieval.fuse(retrieval.score_pairs(keys, products, block=5), k))
    assert rows(retrieval.retrieve(keys, products, k=2, max_products=3)) == rows(retrieval.retrieve(keys, products, k=2))


def test_retrieval_of_a_large_catalog(spark):
    """More products than the first pass keeps."""
    names = [f"{a}{b} {c}" for a in ("zwie", "mil", "zi") for b in ("bel", "ch", "mt", "x") for c in range(30)]
    rows = spark.createDataFrame([(i, f"p{i}", n, "", "") for i, n in enumerate(names)], "prod_idx long, id string, name string, cat1 string, cat2 string")
    products = retrieval.embed(catalog.prepared(rows), "text")
    keys = retrieval.embed(spark.createDataFrame([(q, q) for q in ("zwiebel", "milch", "q")], "key string, query string"), "query")
    got = [sorted(tuple(r) for r in x.collect()) for x in (retrieval.retrieve(keys, products, k=4), retrieval.retrieve_by_ranks(keys, products, k=4, block=100))]
    assert got[0] == got[1] and len(got[0]) == 12


def test_features(spark):
    row = spark.createDataFrame([("500g Mehl", "Mehl Type 0,5 kg", "Mehl & Co", [1.0, 0.0], [0.6, 0.8], 0.7)], "ingredient string, name string, category string, ing_emb array<float>, prod_emb array<float>, score double")
    f = scoring.features(row).first().features
    assert len(f) == 17 and f[9:12] == [1.0, 1.0, 1.0] and abs(f[15] - 0.6) < 1e-6 and f[16] == 0.7
    rounded = spark.createDataFrame([("0.25 kg 0.35g 2 Stück 0.25g",)], "a string").select(scoring.amounts(F.col("a"))).first()[0]
    assert [tuple(x) for x in rounded] == [(250.0, "mass"), (0.3, "mass"), (2.0, "count"), (0.2, "mass")]


def test_pages(spark):
    rows = spark.createDataFrame([("h", 1, "2 Auberginen", 5), ("h", 2, "Salz", 6), ("h", 3, "rote Zwiebel", 7), ("h", 4, "", 8)], "hash string, row_id int, search_term string, current_id int")
    wanted = spark.createDataFrame([("h", 0, "aubergine", "5", 1), ("h", 1, "zwiebeln rot", "9", 0), ("h", 2, "zwiebel", "10", 2), ("x", 0, "salz", "1", 1)], "hash string, pos int, name string, product_id string, amount int")
    best = pages.best_matches(rows, wanted)
    shown = best.select("row_id", "wanted_id", pages.action(F.col("wanted_id").isNotNull(), F.col("current_id"), F.lit(None).cast("int"), F.col("wanted_id"), F.col("wanted_amount")).alias("a"))
    assert sorted(tuple(r) for r in shown.collect()) == [(1, "5", "skip"), (2, None, "missing"), (3, "9", "swap"), (4, None, "missing")]


def test_sources(spark, tmp_path):
    recipes = [{"name": " A ", "mainEntityOfPage": "u", "totalTime": "1:05:00", "keywords": "a, b", "recipeIngredient": [" x ", "", None], "aggregateRating": {"ratingValue": 4.5, "ratingCount": 2}}, {"name": "B", "recipeIngredient": [" "]}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, recipes)) + "\n\n")
    row = tables.read_recipes(spark, str(tmp_path / "r.jsonl")).collect()
    assert len(row) == 1 and tuple(row[0])[:8] == ("A", "u", "", 4.5, 2, "1 Std 5 Min", "", "") and row[0].I_raw == ["x"] and row[0].keywords == ["a", "b"]
    (tmp_path / "m.json").write_text(json.dumps([{"N": "A", "U": "u", "I": [{"raw": " x ", "product_ids": ["1"]}, {"raw": None}]}, {"N": "B", "I": []}]))
    assert [r.I_raw for r in tables.recipes_from_matched(tables.read_matched(spark, str(tmp_path / "m.json"))).collect()] == [["x"]]
    (tmp_path / "p.csv").write_text('product_id,product_name,category_level_1,category_level_2\n7,"A ""b"", c",X,\n')
    assert tuple(tables.read_products_csv(spark, str(tmp_path / "p.csv")).first()) == ("7", 'A "b", c', "X", "")
    (tmp_path / "u.jsonl").write_text('{"recipe_url":"a","mapping_url":"m1"}\n{"recipe_url":"a","mapping_url":"m2","recipe_name":"n"}\n')
    assert tuple(choice.url_map(tables.read_url_lines(spark, str(tmp_path / "u.jsonl"))).first()) == ("a", "m2", "n")
    with pytest.raises(Exception, match="NaN"):
        tables.write_catalog(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "c"))
    products = tables.products_from_catalog(spark.createDataFrame([(1, None, "a", None)], "id int, name string, cat1 string, cat2 string"))
    assert tuple(products.first()) == ("1", "", "a", "")
    assert catalog.catalog_hash(products).first() != catalog.catalog_hash(products.withColumn("name", F.lit("z"))).first()
    tables.write_mappings(spark.createDataFrame([("h",)], "hash string"), str(tmp_path / "map"), "cheapest")
    assert spark.read.json(str(tmp_path / "map")).first().mode == "cheapest"


def test_recurring_names_of_a_page_are_compared_once(spark):
    names = ["kartoffel", "paprika"]
    rows = spark.createDataFrame([("h", i, f"rote {names[i % 2]}") for i in range(6)] + [("h", 9, None), ("g", 10, "rote paprika")], "hash string, row_id long, search_term string")
    wanted = spark.createDataFrame([("h", i, f"rote {names[i % 2]}", 100 + i, 0) for i in range(6)], "hash string, pos long, name string, product_id long, amount int")
    best = pages.best_matches(rows, wanted, own="row_id")
    got = {(r.hash, r.row_id): (r.wanted_id, r.wanted_amount) for r in best.collect()}
    assert got == {("h", 0): ("102", 1), ("h", 1): ("103", 1), **{("h", i): (str(100 + i % 2), 1) for i in range(2, 6)}, ("h", 9): (None, None), ("g", 10): (None, None)}
    assert {(r.hash, r.row_id): r.wanted_id for r in pages.best_matches(rows, wanted).collect()}["h", 0] == "100"


def test_matches_are_looked_up_without_a_shuffle(spark, monkeypatch):
    recipes = spark.createDataFrame([(1, "a", ["2 kg Äpfel", "1 kg Birnen", None]), (2, "b", ["3 kg Äpfel"]), (3, "c", []), (4, "d", None)], "recipe_idx long, N string, I_raw array<string>")
    occ = matcher.occurrences(recipes)
    key = occ.where("raw = '3 kg Äpfel'").first().dedup_key
    matches = spark.createDataFrame([(key, ["7", '"8', "9"]), ("other|", ["1"]), (None, ["2"])], "dedup_key string, product_ids array<string>")
    found = matcher.looked_up(recipes, matches)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    plain = matcher.assemble(recipes, occ, matches)
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert found.where("recipe_idx = 2").first().I[0].product_ids == ["7", '"8', "9"]
    assert matcher.looked_up(recipes, matches.limit(0)).where("recipe_idx = 2").first().I[0].product_ids == []
    monkeypatch.setattr(matcher, "FEW", 3)
    assert matcher.looked_up(recipes, matches) is None


def test_stored_matches_grow_with_lines_and_lists_not_with_their_product(spark, tmp_path, monkeypatch):
    """Each list of 300 ids is written once for its 400 lines; what is stored is the whole result."""
    import duckdb

    from larder.plans import shop_queries
    from larder.plans.registry import ORACLES, QUERIES

    part = [(i, ("red nut", "old bolt")[i % 2], 1) for i in range(600)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(o, o % 600, n, n) for o in range(200) for n in range(4)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(shop_queries, "scratch", lambda spark: str(tmp_path / "files"))
    got = sorted((r.N, r.lines) for r in QUERIES["rematched_files"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(c.sql(ORACLES["rematched_files"]).fetchall()) and len(got) == 200
    assert sum(f.stat().st_size for f in (tmp_path / "files").rglob("part-*")) < 30_000  # lists inline: 1,446,400
    shown = lambda rows: sorted(str([(i.raw, i.product_ids) for i in r.I]) for r in rows.collect())
    whole = shown(matcher.stored(spark, str(tmp_path / "files")))
    assert whole == shown(shop_queries.matched_orders(spark, str(tmp_path))) and "'299'" in whole[0] + whole[1]


def test_stored_recipes_are_whole(spark, tmp_path):
    recipes = spark.createDataFrame([(1, "a", ["2 kg Äpfel", "1 kg \"Birnen\"\n", None, " x "], 1.5), (2, "b", ["3 kg Äpfel", "3 kg Äpfel"], None), (3, "c", [], 1.0), (4, None, None, 1.0)], "recipe_idx long, N string, I_raw array<string>, rating double")
    occ = matcher.occurrences(recipes)
    key = occ.where("raw = '3 kg Äpfel'").first().dedup_key
    matches = spark.createDataFrame([(key, ["7", '"8', "9"]), ("other|", ["1"]), (None, ["2"])], "dedup_key string, product_ids array<string>")
    matcher.store(recipes.drop("recipe_idx"), matches, str(tmp_path / "m"))
    rows = lambda df: sorted(str((r.N, r.rating, r.I)) for r in df.collect())
    assert rows(matcher.stored(spark, str(tmp_path / "m"))) == rows(matcher.assemble(recipes, occ, matches))
    assert [r.I_raw for r in tables.recipes_from_matched(matcher.stored_recipes(spark, str(tmp_path / "m"))).orderBy("N").collect()][1] == ["3 kg Äpfel"] * 2
    matcher.store(recipes.drop("recipe_idx").limit(0), matches.limit(0), str(tmp_path / "none"))
    assert matcher.stored(spark, str(tmp_path / "none")).count() == 0
