"""Preprocessing of recipes' ingredient lines: split joined lines, merge lines of one ingredient, and log what was done."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import vocabulary as V
from larder.functions.quantity import ingredient_quantity
from larder.functions.regex import py_regex
from larder.functions.text import dedup_key, normalize, number, strip, vague_amount, without_amount

MARK = re.compile(rf"[()]|{V.ADDITIVE}", re.I)


def cut_line(raw: str) -> list[str]:
    """The parts of a line between additive words outside brackets; not after a hyphen, which stands for a word to come."""
    low = raw.lower()
    if any(p in low for p in V.NOT_ADDITIVE):
        return [raw]
    depth, last, parts = 0, 0, []
    for m in MARK.finditer(raw):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth = max(0, depth - 1)
        elif not depth and not raw[: m.start()].rstrip().endswith("-"):
            parts.append(raw[last : m.start()])
            last = m.end()
    parts = [p.strip() for p in (*parts, raw[last:]) if p.strip()]
    return parts if len(parts) > 1 else [raw]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_lines(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else cut_line(x))


def split_line(raw: Column) -> Column:
    """A line's parts; the line itself if any part has no name of its own."""
    parts = _cut_lines(raw)
    return F.when(F.exists(parts, lambda p: normalize(p) == ""), F.array(raw)).otherwise(parts)


@F.pandas_udf(T.StringType())
def shown_number(n: pd.Series) -> pd.Series:
    """Whole numbers without a point, others with up to six digits."""
    return n.map(lambda x: None if pd.isna(x) else str(int(x)) if float(x).is_integer() else f"{x:g}")


def classified(items: DataFrame) -> DataFrame:
    """Adds kind (dim, vague, plain or bare), unit, amount, name and shown (a vague unit as written) of each line."""
    exact, vague = ingredient_quantity(F.col("item")), vague_amount(F.col("item"))
    plain = py_regex(V.PLAIN_AMOUNT, ignore_case=True)
    fields = lambda kind, unit, amount, name, shown: F.struct(F.lit(kind).alias("kind"), unit.alias("unit"), amount.alias("amount"), name.alias("name"), shown.alias("shown"))
    none = F.lit(None).cast("string")
    made = (
        F.when(F.col("x").isNotNull(), fields("dim", F.col("x.dimension"), F.col("x.amount"), without_amount(F.col("item")), F.col("x.dimension")))
        .when(F.col("v").isNotNull(), fields("vague", F.col("v.unit"), F.col("v.amount"), F.col("v.name"), F.col("v.shown")))
        .when(F.col("item").rlike(plain), fields("plain", F.lit(""), number(F.regexp_extract("item", plain, 1)), strip(F.regexp_extract("item", plain, 2)), none))
        .otherwise(fields("bare", F.lit(""), F.lit(None).cast("double"), F.col("item"), none))
    )
    return items.withColumns({"x": exact, "v": vague}).withColumn("c", made).select(*items.columns, F.col("v").isNotNull().alias("has_vague"), "c.*")


def rendered() -> Column:
    """A summed signature as a line."""
    unit = F.when(F.col("shown") == "weight", "g ").when(F.col("shown") == "volume", "ml ").otherwise("")
    vague = strip(F.concat(F.col("number"), F.lit(" "), F.col("shown"), F.lit(" "), F.col("name")))
    return F.when(F.col("kind") == "dim", F.concat(F.col("number"), F.lit(" "), unit, F.col("name"))).when(F.col("kind") == "vague", vague).otherwise(strip(F.concat(F.col("number"), F.lit(" "), F.col("name"))))


def preprocess(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (recipe_idx, ing_idx, raw): (recipe_idx, ingredients array) and the log (recipe_idx, seq, type, members, result).

    Lines of one recipe with one key (name and form) are one ingredient. Amounts that can be bought decide: each of their
    kinds is summed, others go. Else one vague unit is summed; of several vague units the first line stays. Without any
    amount the first line stays. Split operations come first in the log.
    """
    parts = lines.select("recipe_idx", "ing_idx", "raw", split_line(F.col("raw")).alias("parts"))
    items = parts.select("recipe_idx", "ing_idx", F.posexplode("parts").alias("part", "item"))
    items = items.select("recipe_idx", F.struct("ing_idx", "part").alias("pos"), "item", dedup_key(F.col("item")).alias("key"))
    known = classified(items)
    sums = known.groupBy("recipe_idx", "key", "kind", "unit").agg(
        F.sum("amount").alias("total"), F.count("*").alias("n"), F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), F.min_by("shown", "pos").alias("shown"),
        F.collect_list(F.struct("pos", "item")).alias("items"), F.min(F.when(F.col("has_vague"), F.struct("pos", "item"))).alias("vague_item"),
    )
    sums = sums.withColumn("number", shown_number("total")).withColumn("line", rendered())
    both = sums.groupBy("recipe_idx", "key").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind").isin("dim", "plain"), F.struct("pos", "line", "n")))).alias("exact"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "vague", F.struct("pos", "line", "n")))).alias("vague"),
        F.sort_array(F.flatten(F.collect_list("items"))).alias("members"),
        F.min("vague_item").alias("vague_item"),
        F.min("pos").alias("pos"),
    ).withColumn("first_vague", F.col("vague_item.item"))
    first = F.col("members")[0]["item"]
    pick = lambda c: F.transform(c, lambda s: s["line"])
    several = F.size("members") > 1
    exact, vague = F.size("exact"), F.size("vague")
    pieces = F.when(~several, F.array(first)).when(exact > 0, pick("exact")).when(vague == 1, pick("vague")).when(vague > 1, F.array(F.coalesce("first_vague", first))).otherwise(F.array(first))
    summed = F.when(exact > 0, F.exists("exact", lambda s: s["n"] > 1)).when(vague == 1, F.exists("vague", lambda s: s["n"] > 1)).otherwise(False)
    kind = F.when((exact + vague == 0) | (F.size("pieces") != F.size("members")) & ~F.col("summed"), "dedup").when(F.size("pieces") == F.size("members"), "skip_ambiguous").otherwise("merge")
    chosen = both.withColumn("pieces", pieces).withColumn("summed", summed).withColumn("type", F.when(several, kind))
    out = chosen.groupBy("recipe_idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "pieces"))), lambda x: x["pieces"])).alias("ingredients"))
    splits = parts.where(F.size("parts") > 1).select("recipe_idx", F.struct(F.lit(0).alias("o"), F.struct("ing_idx", F.lit(0).alias("part")).alias("p")).alias("seq"), F.lit("split").alias("type"), F.array("raw").alias("members"), F.col("parts").alias("result"))
    merges = chosen.where("type IS NOT NULL").select("recipe_idx", F.struct(F.lit(1).alias("o"), F.col("pos").alias("p")).alias("seq"), "type", F.transform("members", lambda m: m["item"]).alias("members"), F.when(F.col("type") != "skip_ambiguous", F.col("pieces")).alias("result"))
    return out, splits.union(merges)
