"""Registered queries: the operators on the test tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import quantity, rules, text
from larder.functions import vocabulary as V
from larder.functions.regex import py_regex
from larder.operators import cache, catalog, choice, dashboards, pages, preprocess, quality, retrieval, scoring, vectors, warehouse
from larder.plans import matcher
from larder.plans.registry import ORACLES, QUERIES, cents, query, table
from larder.streaming.landing import windowed_counts

# Warehouse and catalog


@query("""
WITH newest AS (SELECT date_trunc('month', max(o_orderdate)) AS m FROM orders),
lines AS (
  SELECT l_partkey, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_trunc('month', o_orderdate) = (SELECT m FROM newest)),
best AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY cost, l_orderkey, l_linenumber) AS n FROM lines)
SELECT p_partkey AS part_id, p_name AS name, p_brand AS brand, l_orderkey AS order_id, l_linenumber AS line_number, cost FROM best JOIN part ON l_partkey = p_partkey WHERE n = 1
""")
def offer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest line of each part in the newest month of orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").alias("month"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("cost"))
    rows = lines.join(warehouse.latest(orders, "month"), F.col("l_orderkey") == F.col("o_orderkey"))
    best = rows.groupBy("l_partkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber", "cost"), F.struct("cost", "l_orderkey", "l_linenumber")).alias("b"))
    part = table(spark, sf_dir, "part")
    return best.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("b.l_orderkey").alias("order_id"), F.col("b.l_linenumber").alias("line_number"), "b.cost")


@query("""
SELECT DISTINCT c_custkey, c_mktsegment, n_name, r_name, o_orderpriority, p_brand, p_type, l_returnflag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE NOT starts_with(r_name, 'A') AND NOT starts_with(r_name, 'MID')
""")
def fact_join_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins of a fact with its dimensions, prefixes excluded, distinct over all columns."""
    t = lambda n: table(spark, sf_dir, n)
    region = t("region").where(warehouse.outside(F.col("r_name"), ("A", "MID")))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("c_custkey", "c_mktsegment", "n_name", "r_name", "o_orderpriority", "p_brand", "p_type", "l_returnflag").distinct()


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, A2, T1."""
    return warehouse.latest(table(spark, sf_dir, "orders"), "o_orderdate").orderBy("o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
SELECT page_id, nullif(s[1], '') AS level_1, s[2] AS level_2, s[3] AS level_3, s[4] AS level_4, 'https://shop' || url AS link
FROM (SELECT page_id, url, string_split(rtrim(url, '/'), '/') AS s FROM pages)
""")
def category_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P3."""
    levels = [c.alias(f"level_{i + 1}") for i, c in enumerate(warehouse.category_levels(F.col("url")))]
    return table(spark, sf_dir, "pages").select("page_id", *levels, F.concat(F.lit("https://shop"), "url").alias("link")).withColumn("level_1", F.nullif("level_1", F.lit("")))


@query("""
WITH t AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE event_id % 3 WHEN 0 THEN 3600 WHEN 1 THEN 7200 ELSE 0 END AS seconds FROM events),
u AS (SELECT *, make_timestamp(seconds * 1000000) AS tt FROM t),
v AS (SELECT *, make_timestamp(year(tt), 3, 31, 1, 0, 0) - to_days(CAST(dayofweek(make_date(year(tt), 3, 31)) AS INTEGER)) AS summer,
             make_timestamp(year(tt), 10, 31, 1, 0, 0) - to_days(CAST(dayofweek(make_date(year(tt), 10, 31)) AS INTEGER)) AS winter FROM u)
SELECT event_id, seconds, strftime(tt + to_hours(CASE WHEN tt >= summer AND tt < winter THEN 2 ELSE 1 END), '%Y-%m-%d') AS local_day FROM v
""")
def timestamp_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with zone names to instants, then to days of a zone with summer time."""
    zone = F.when(F.col("event_id") % 3 == 0, "CET").when(F.col("event_id") % 3 == 1, "CEST").otherwise("Z")
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    at = table(spark, sf_dir, "events").select("event_id", warehouse.zoned_timestamp(shown).alias("at"))
    return at.select("event_id", F.unix_seconds("at").alias("seconds"), text.local_date(F.col("at")).alias("local_day"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size || 'g' END AS prefix,
  CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN p_size * 1.0 ELSE p_size * 1.0 END AS amount FROM part
""")
def grammage_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, F11."""
    end = F.when(F.col("p_partkey") % 3 == 0, "g (1 kg = 9,99 €)").when(F.col("p_partkey") % 3 == 1, "g (1 l = 3,00 €)").otherwise(" Packung")
    shown = F.concat(F.col("p_size").cast("string"), end)
    prefix = warehouse.grammage_prefix(shown)
    return table(spark, sf_dir, "part").select("p_partkey", prefix.alias("prefix"), quantity.product_quantity(prefix, F.col("p_name"))["amount"].alias("amount"))


@query("""
WITH t AS (SELECT *, CASE WHEN l_discount > 0.03 THEN l_discount * 100 WHEN l_discount > 0.01 THEN 'nan'::DOUBLE END AS rate FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS id, rate IS NOT NULL AND NOT isnan(rate) AS on_offer, CAST(trunc(l_extendedprice) AS INTEGER) AS price,
  CASE WHEN NOT isnan(rate) THEN CAST(trunc(l_extendedprice * 2) AS INTEGER) END AS price_regular, CASE WHEN NOT isnan(rate) THEN CAST(round(rate) AS INTEGER) END AS discount,
  CASE WHEN rate IS NULL OR isnan(rate) THEN '' ELSE 'yes' END AS shown FROM t
""")
def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, F32: fields that only offers have; null and NaN are no offer."""
    rate = F.when(F.col("l_discount") > 0.03, F.col("l_discount") * 100).when(F.col("l_discount") > 0.01, F.lit(float("nan")))
    rows = table(spark, sf_dir, "lineitem").withColumn("rate", rate)
    offer = catalog.on_offer(F.col("rate"))
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), offer.alias("on_offer"), F.col("l_extendedprice").cast("int").alias("price"),
        F.when(offer, (F.col("l_extendedprice") * 2).cast("int")).alias("price_regular"), F.when(offer, F.round("rate").cast("int")).alias("discount"),
        F.when(text.safe(F.col("rate")) == "", "").otherwise("yes").alias("shown"),
    )


@query("""
WITH h AS (SELECT substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 2) AS part, sha256(p_partkey || '|' || p_name) AS h FROM part),
r AS (SELECT part, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY part)
SELECT substr(sha256(string_agg(h, '' ORDER BY part)), 1, 16) AS catalog_hash FROM r
""")
def catalog_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that the matcher keys its candidate cache by."""
    return catalog.catalog_hash(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


# Text and rules

STOP_SQL = ", ".join(f"'{w}'" for w in V.KEYWORD_STOPWORDS)


@query(rf"""
WITH a AS (
  SELECT p_partkey AS id, lower(p_name || ' Größe ' || p_size || CASE p_partkey % 4 WHEN 0 THEN ' kg' WHEN 1 THEN 'g' WHEN 2 THEN ' stücke' ELSE ' % frisch' END) AS s FROM part),
b AS (SELECT id, list_filter(regexp_extract_all(regexp_replace(s, '\d+[,.]?\d*\s*(g|kg)$', '', 'g'), '[a-züäöß]+'), lambda w: len(w) > 2 AND NOT list_contains([{STOP_SQL}], w)) AS k FROM a)
SELECT id, array_to_string(k, ' ') AS keywords FROM b
""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    end = F.element_at(F.array(*map(F.lit, (" kg", "g", " stücke", " % frisch"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(F.col("p_name"), F.lit(" Größe "), F.col("p_size").cast("string"), end)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.keywords(name), " ").alias("keywords"))


@query()
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 to F3 on whole texts; tested against a plain Python specification."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.normalize(F.col("text"))).alias("n_chars"), F.sha2(text.dedup_key(F.col("text")), 256).alias("key_sha256"))


@query("""
SELECT md5(lower(text)) AS key, min(doc_id) AS first_id, count(*) AS n, arg_min(source, doc_id) AS first_source FROM documents GROUP BY 1
""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: groups with their first member."""
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.lower("text")).alias("key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min_by("source", "doc_id").alias("first_source"))


@query("SELECT 1 - count(DISTINCT md5(lower(text))) / count(*)::DOUBLE AS dedup_ratio, count(DISTINCT md5(lower(text))) AS n_keys FROM documents")
def dedup_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return matcher.dedup_ratio(table(spark, sf_dir, "documents").select(F.md5(F.lower("text")).alias("dedup_key")))


@query("""
SELECT p_partkey, p_name FROM part WHERE len(list_distinct(string_split(p_name, ' '))) <= 3
  AND list_has_any(string_split(p_name, ' '), ['red', 'hot']) AND p_name <> ''
""")
def pantry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14, U6."""
    return table(spark, sf_dir, "part").where(text.is_pantry(F.col("p_name"), ("red", "hot")) & (F.col("p_name") != "")).select("p_partkey", "p_name")


def colour_sql(column: str) -> str:
    tests = (f"CASE WHEN regexp_matches({column}, '(^|[^\\pL\\pN_])(?:{words})([^\\pL\\pN_]|$)', 'i') THEN '{name}' END" for name, words in V.COLOURS.items())
    return "list_filter([" + ", ".join(tests) + "], lambda x: x IS NOT NULL)"


@query(f"""
SELECT doc_id, array_to_string({colour_sql("text")}, ',') AS colours, NOT regexp_matches(text, '(^|[^\\pL\\pN_])(bunt|gemischt|mehrfarbig|versch)', 'i')
  AND len({colour_sql("text")}) > 0 AND NOT list_contains({colour_sql("text")}, 'rot') AS mismatch FROM documents
""")
def colour_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, F17 on whole texts."""
    colours = rules.colours(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(colours, ",").alias("colours"), rules.colour_mismatch(F.col("text"), F.lit("Paprika rot 1 Stück")).alias("mismatch"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 AND p_size > 0 THEN CAST(ceil(CASE p_partkey % 3 WHEN 0 THEN 1500.0 ELSE 7.0 END / p_size) AS BIGINT) END AS packages FROM part
""")
def package_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, an incomparable pair, and pieces."""
    pick = lambda *x: F.element_at(F.array(*x), (F.col("p_partkey") % 3 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    raw = pick(F.lit("1,5 kg Mehl"), F.lit("250 ml Sahne"), F.lit("7 Eier"))
    grammage = pick(F.concat(size, F.lit("g")), F.concat(size, F.lit("g")), F.lit(None).cast("string"))
    name = pick(F.lit("x"), F.lit("x"), F.concat(F.lit("Eier "), size, F.lit(" Stück")))
    return table(spark, sf_dir, "part").select("p_partkey", quantity.package_count(raw, grammage, name)["packages_needed"].alias("packages"))


# Choice and mapping


@query("""
WITH c AS (
  SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * greatest(1, CAST(trunc(l_quantity / 10) AS INTEGER)) AS cost FROM lineitem)
SELECT l_partkey AS part_id, arg_min(l_suppkey, (cost, l_orderkey, l_linenumber)) AS supplier_id, min(cost) AS cost FROM c GROUP BY 1
""")
def argmin_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest by price times packages; the first wins ties."""
    n = F.col("l_quantity") / 10
    packages = F.coalesce(F.when((n >= 1) & ~F.isnan(n), n.cast("int")), F.lit(1))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("product_id"), packages.alias("packages"), (cents("l_extendedprice") * packages).alias("cost"), F.struct("l_orderkey", "l_linenumber").alias("pos"))
    return choice.pick(rows, ["part_id"]).select("part_id", F.col("product_id").alias("supplier_id"), "cost")


@query("""
WITH c AS (SELECT l_partkey, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost, l_discount >= 0.09 AS offer FROM lineitem)
SELECT l_partkey AS part_id, arg_min(l_orderkey, (NOT offer, cost, l_orderkey, l_linenumber)) AS order_id, arg_min(cost, (NOT offer, cost, l_orderkey, l_linenumber)) AS cost FROM c GROUP BY 1
""")
def offer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on offer first, else the cheapest."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_orderkey").alias("product_id"), F.lit(1).alias("packages"), cents("l_extendedprice").alias("cost"), (F.col("l_discount") >= 0.09).alias("on_offer"), F.struct("l_orderkey", "l_linenumber").alias("pos"))
    return choice.pick(rows, ["part_id"], "offers").select("part_id", F.col("product_id").alias("order_id"), "cost")


@query("""
WITH e AS (SELECT l_orderkey, p_name AS name, p_brand, l_partkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost, CAST(l_quantity AS INTEGER) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey AS order_id, name, arg_min(p_brand, (l_linenumber, l_partkey)) AS raw, arg_min(l_partkey, (cost, l_linenumber, l_partkey)) AS product_id, max(amount) AS amount, min(l_linenumber) AS pos FROM e GROUP BY 1, 2
""")
def dedupe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, W6."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entries = rows.select(F.col("l_orderkey").alias("order_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("raw"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("amount"), cents("l_extendedprice").alias("cost"), F.struct("l_linenumber", "l_partkey").alias("pos"))
    return choice.dedupe_names(entries, ["order_id"]).withColumn("pos", F.col("pos.l_linenumber")).select("order_id", "name", "raw", "product_id", "amount", "pos")


@query("""
WITH line AS (
  SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_suppkey FROM lineitem),
cand AS (SELECT l_orderkey, pos, l_partkey AS id, 0 AS k, l_partkey FROM line UNION ALL SELECT l_orderkey, pos, l_suppkey, 1, l_partkey FROM line),
priced AS (SELECT c.*, CAST(round(p.p_retailprice * 100) AS BIGINT) AS cost, n.p_name AS raw FROM cand c JOIN part p ON c.id = p.p_partkey JOIN part n ON c.l_partkey = n.p_partkey),
best AS (SELECT l_orderkey, pos, any_value(raw) AS raw, arg_min(id, (cost, k)) AS id, min(cost) AS cost FROM priced GROUP BY 1, 2),
named AS (SELECT l_orderkey, raw AS name, arg_min(id, (cost, pos)) AS id, min(pos) AS pos FROM best GROUP BY 1, 2)
SELECT CAST(l_orderkey AS VARCHAR) AS hash, 'Order ' || l_orderkey AS recipe_name, string_agg(name || '=' || id, ';' ORDER BY pos) AS ingredients FROM named GROUP BY l_orderkey
""")
def build_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 with J4, J5, A8, A11, A15, F21, F22: orders as recipes, their lines as ingredients."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    entry = F.struct(F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("p_name").alias("raw"), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("product_ids"))
    recipes = lines.groupBy(F.col("l_orderkey").alias("recipe_idx")).agg(F.sort_array(F.collect_list(entry)).alias("I"))
    recipes = recipes.select("recipe_idx", F.lit("").alias("N"), F.concat(F.lit("https://r/"), F.col("recipe_idx").cast("string")).alias("U"), "I")
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), cents("p_retailprice").alias("price"), F.lit(False).alias("on_offer"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    urls = choice.url_map(orders.select(F.lit(1).alias("line_no"), F.concat(F.lit("https://r/"), "k").alias("recipe_url"), F.concat(F.lit("https://m/"), "k", F.lit("/")).alias("mapping_url"), F.concat(F.lit("Order "), "k").alias("recipe_name")))
    out = choice.build_mappings(recipes, products, urls)
    return out.select("hash", "recipe_name", F.array_join(F.transform("ingredients", lambda e: F.concat(e["name"], F.lit("="), e["product_id"])), ";").alias("ingredients"))


# Sets, caches, metrics


@query("""
WITH c AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0), o AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND c_custkey % 5 <> 0),
m AS (SELECT DISTINCT o_custkey AS id FROM orders), p AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0)
SELECT (SELECT count(*) FROM c) AS catalog, (SELECT count(*) FROM o) AS on_offer, (SELECT count(*) FROM m) AS matched,
  (SELECT count(*) FROM (FROM m EXCEPT FROM c)) AS stale, (SELECT count(*) FROM (FROM o EXCEPT FROM m)) AS missed_deals,
  (SELECT count(*) FROM (FROM c EXCEPT FROM p)) AS new_ids, (SELECT count(*) FROM ((FROM p EXCEPT FROM c) INTERSECT FROM m)) AS gone_matched
""")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 to U5, A16, A17."""
    customer = table(spark, sf_dir, "customer")
    now = customer.where("c_custkey % 5 <> 0")
    return quality.metrics(quality.ids(now, "c_custkey"), quality.ids(now.where("c_acctbal < 0"), "c_custkey"), quality.ids(table(spark, sf_dir, "orders"), "o_custkey"), quality.ids(customer.where("c_custkey % 7 <> 0"), "c_custkey"))


@query("""
SELECT CAST(id AS VARCHAR) AS id FROM ((SELECT o_custkey AS id FROM orders) EXCEPT (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)) ORDER BY 1 LIMIT 10
""")
def stale_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first ids in text order."""
    known = quality.ids(table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0"), "c_custkey")
    return quality.sample(quality.id_sets(known, known, quality.ids(table(spark, sf_dir, "orders"), "o_custkey"))["stale"])


@query("""
WITH v AS (SELECT * FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 10 <> 3)
SELECT l_orderkey AS dedup_key, l_partkey AS product_id FROM lineitem t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.l_orderkey = t.l_orderkey AND v.l_partkey = t.l_partkey)
""")
def anti_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without a score that is still valid (of the model, and of a product whose text is unchanged)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dedup_key"), F.lit("").alias("raw_fp"), F.col("l_partkey").alias("product_id"), F.col("l_linestatus").alias("model_hash"))
    stored = lines.withColumn("product_fp", F.col("product_id") % 10)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 3, -1).otherwise(F.col("p_partkey") % 10).alias("product_fp"))
    valid = cache.valid_scores(stored, parts, "F")
    return cache.missing_pairs(lines.drop("model_hash"), valid).select("dedup_key", "product_id")


@query("""
SELECT count(*) AS kept FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)
""")
def cache_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of active keys and current products."""
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dedup_key"), F.col("l_partkey").alias("product_id"))
    active = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("dedup_key"))
    return cache.kept_scores(scores, active, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))).agg(F.count("*").alias("kept"))


@query("SELECT o_orderkey AS dedup_key FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active keys without candidates of this configuration."""
    active = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("dedup_key"))
    stored = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dedup_key"), F.col("l_returnflag").alias("config"))
    return cache.missing_keys(active, stored, "R")


# Retrieval and scoring


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS c FROM v q, v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) - 1 AS pos FROM s)
SELECT query_id, CAST(pos AS INTEGER) AS pos, vec_id FROM r WHERE pos < 10
""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 100 = 0"), 10)


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS key, v.vec_id AS prod_idx, CAST(v.vec_id % 9 AS INTEGER) AS length, -CAST(abs(q.label - v.label) AS DOUBLE) AS lexical, round(list_cosine_similarity(q.e, v.e), 6) AS dense FROM v q, v WHERE q.vec_id % 100 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lexical DESC, prod_idx) - 1 AS lr, row_number() OVER (PARTITION BY key ORDER BY lexical DESC, prod_idx DESC) - 1 AS cr, row_number() OVER (PARTITION BY key ORDER BY dense DESC, prod_idx) - 1 AS dr FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cr < 75 DESC, lexical DESC, length, cr) - 1 AS again FROM a),
c AS (SELECT *, 1.0::DOUBLE / (61 + CASE WHEN cr < 75 THEN least(lr, again) ELSE lr END) + 1.0::DOUBLE / (61 + dr) AS fused FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fused DESC, prod_idx DESC) - 1 AS pos FROM c)
SELECT key, CAST(pos AS INTEGER) AS pos, CAST(prod_idx AS VARCHAR) AS product_id FROM d WHERE pos < 25
""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 to W4, T2 on a stated query set."""
    rows = table(spark, sf_dir, "embeddings")
    pairs = vectors.scored(rows, rows.where("vec_id % 100 = 0")).withColumnRenamed("vec_id", "prod_idx")
    labels = rows.select("vec_id", "label")
    both = pairs.join(labels.toDF("query_id", "query_label"), "query_id").join(labels.toDF("prod_idx", "label"), "prod_idx")
    scores = both.select(F.col("query_id").alias("key"), "prod_idx", F.col("prod_idx").cast("string").alias("id"), (F.col("prod_idx") % 9).cast("int").alias("length"), (-F.abs(F.col("query_label") - F.col("label"))).cast("double").alias("lexical"), F.round("cosine", 6).alias("dense"))
    return retrieval.fuse(scores)


@query()
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of neighbouring parts' names."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("g")).alias("ingredient"), F.col("p_type").alias("category"))
    other = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.initcap("ingredient").alias("name"))
    pairs = rows.join(other, "p_partkey")
    embedded = retrieval.embed(retrieval.embed(pairs, "ingredient", out="ing_emb"), "name", out="prod_emb").withColumn("score", F.lit(0.5))
    return scoring.features(embedded).select("p_partkey", F.array_join(F.transform("features", lambda x: F.round(x, 4).cast("string")), ",").alias("features"))


@query()
def match_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recipes, their roles and part names as lines, parts as products; a stand-in scorer."""
    part = table(spark, sf_dir, "part")
    products = part.groupBy("p_name").agg(F.min("p_partkey").alias("prod_idx"), F.min_by("p_type", "p_partkey").alias("cat1")).select("prod_idx", F.col("prod_idx").cast("string").alias("id"), F.col("p_name").alias("name"), "cat1", F.lit("").alias("cat2"))
    line = F.concat((F.col("p_partkey") % 5 + 1).cast("string"), F.lit(" kg "), "p_name")
    recipes = part.groupBy((F.col("p_partkey") % 40).alias("recipe_idx")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("raw")))), lambda x: x["raw"]).alias("I_raw")).withColumn("N", F.lit("n"))
    found = matcher.match(spark, recipes, products)
    return found.recipes.select("recipe_idx", F.posexplode("I").alias("pos", "i")).select("recipe_idx", "pos", "i.raw", F.array_join("i.product_ids", ",").alias("product_ids"))


@query("""
WITH t AS (SELECT quality, (n_chars % 100) / 100.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS lines, count(*) FILTER (score >= 0.5) AS matched, count(*) FILTER (score >= 0.5) / count(*)::DOUBLE AS rate, max(score) AS most, count(*) FILTER (score >= 0.5 AND quality = 1) AS good FROM t
""")
def threshold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, P16, A5, A6."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("quality", ((F.col("n_chars") % 100) / 100.0).alias("score"))
    hit = F.col("score") >= V.MIN_SCORE
    return rows.agg(F.count("*").alias("lines"), F.count_if(hit).alias("matched"), (F.count_if(hit) / F.nullif(F.count("*"), F.lit(0))).alias("rate"), F.max("score").alias("most"), F.count_if(hit & (F.col("quality") == 1)).alias("good"))


# Nested data


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, S6, S14."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, length(text) AS n_chars FROM conversations")
def unnest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists built in order and unnested again."""
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n_chars")))).alias("turns"))
    return lists.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.role", "t.n_chars")


@query()
def preprocess_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, F4 to F9 on lines made from orders; tested against stated lists."""
    made = F.concat(F.col("l_linenumber").cast("string"), F.element_at(F.array(F.lit(" kg "), F.lit(" EL "), F.lit(" ")), (F.col("l_linenumber") % 3 + 1).cast("int")), "p_name")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = lines.select(F.col("l_orderkey").alias("recipe_idx"), F.row_number().over(order).alias("ing_idx"), made.alias("raw"))
    return preprocess.preprocess(rows)[0].select("recipe_idx", F.array_join("ingredients", "; ").alias("ingredients"))


# Pages, dashboards, events


@query("""
WITH w AS (SELECT p_partkey, p_partkey % 500 AS hash, list_distinct(list_filter(list_transform(string_split(p_name, ' '), lambda t: regexp_replace(t, '(en|er|n|e|s)$', '')), lambda t: len(t) >= 2)) AS t FROM part),
s AS (
  SELECT a.hash, a.p_partkey AS row_id, b.p_partkey AS wanted_id, len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t))::DOUBLE AS o, len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::DOUBLE AS j
  FROM w a JOIN w b ON a.hash = b.hash AND a.p_partkey <> b.p_partkey AND list_has_any(a.t, b.t)),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY o DESC, j DESC, wanted_id) AS n FROM s)
SELECT p_partkey AS row_id, CAST(r.wanted_id AS VARCHAR) AS wanted_id, CASE WHEN r.wanted_id IS NULL THEN 'missing' ELSE 'swap' END AS action
FROM part LEFT JOIN (SELECT * FROM r WHERE n = 1 AND o >= 0.6) r ON row_id = p_partkey
""")
def page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the same mapping whose name fits best, other than the row's own."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 500).alias("hash"), F.col("p_name").alias("search_term"))
    wanted = part.select("hash", F.col("row_id").alias("pos"), F.col("search_term").alias("name"), F.col("row_id").alias("product_id"), F.lit(1).alias("amount"))
    best = pages.best_matches(part, wanted, own="row_id")
    shown = pages.action(F.col("wanted_id").isNotNull(), F.col("row_id"), F.lit(1), F.col("wanted_id"), F.col("wanted_amount"))
    return best.select("row_id", "wanted_id", shown.alias("action"))


@query("""
WITH t AS (
  SELECT o_custkey AS hash, CASE l_linenumber % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'skip' WHEN 2 THEN 'swap' ELSE 'amount' END AS action, l_returnflag = 'R' AS failed,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS page, CASE WHEN l_suppkey % 3 > 0 THEN CAST(round(l_extendedprice * 90) AS BIGINT) END AS ours, l_discount > 0.05 AS offer FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT *, failed AND action IN ('swap', 'amount') AS f, action <> 'missing' AND NOT failed AS done FROM t)
SELECT hash, count(*) FILTER (action IN ('swap', 'amount') AND NOT f) AS changed, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'missing') AS missing, count(*) FILTER (f) AS failed,
  count(*) FILTER (done AND ours IS NOT NULL AND offer) AS offers, CAST(coalesce(sum(page * 2 - ours * 2) FILTER (done AND ours IS NOT NULL), 0) AS BIGINT) AS saved_cents FROM u GROUP BY hash
""")
def page_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, ("missing", "skip", "swap", "amount"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = lines.select(
        F.col("o_custkey").alias("hash"), kind.alias("action"), (F.col("l_returnflag") == "R").alias("failed"), cents("l_extendedprice").alias("page_cents"), F.lit(2).alias("page_amount"),
        F.when(F.col("l_suppkey") % 3 > 0, F.round(F.col("l_extendedprice") * 90).cast("long")).alias("our_cents"), (F.col("l_discount") > 0.05).alias("our_on_offer"), F.lit(2).alias("wanted_amount"),
    )
    return pages.savings(rows)


@query("""
SELECT count(*) AS products, max(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS max_saving,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS sum_saving FROM lineitem
""")
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    full = cents("l_extendedprice") * 100
    return dashboards.kpis(table(spark, sf_dir, "lineitem"), full, full - cents("l_extendedprice") * cents("l_discount"))


@query("SELECT p_type, count(*) AS products FROM part GROUP BY 1")
def dashboard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return dashboards.by_group(table(spark, sf_dir, "part"), "p_type")


@query("SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS products FROM lineitem GROUP BY 1")
def dashboard_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return dashboards.by_day(table(spark, sf_dir, "lineitem"), "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount > 0 ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50")
def discount_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: a report of the 50 largest discounts."""
    return dashboards.top_discounts(table(spark, sf_dir, "lineitem"), "l_discount", 50, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation over all events at once; as a stream it is tested with late data."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT count(*) FILTER (url LIKE '%.net/%') AS mapped, count(*) AS pages FROM pages")
def page_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23."""
    return table(spark, sf_dir, "pages").agg(F.count_if(pages.is_mapping_page(F.col("url"), py_regex(r"\.net/"))).alias("mapped"), F.count("*").alias("pages"))


from larder.plans import shop_queries  # noqa: E402, F401 (registers its queries)

__all__ = ["ORACLES", "QUERIES"]
