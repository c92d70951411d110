"""Amounts in ingredient lines and products, and packages needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import vocabulary as V
from larder.functions.regex import py_regex
from larder.functions.text import number, strip

SINGLE = py_regex(rf"^{V.NUMBER}\s*(kg|g|l|ml)\b", ignore_case=True)
MULTI = py_regex(rf"^{V.NUMBER}\s*x\s*{V.NUMBER}\s*(kg|g|l|ml)\b", ignore_case=True)
WEIGHT = py_regex(rf"^{V.NUMBER}\s*(kg|g)\b", ignore_case=True)
VOLUME = py_regex(rf"^{V.NUMBER}\s*(l|liter|ml)\b", ignore_case=True)
COUNT = py_regex(rf"^{V.NUMBER}\s*([a-zäöüß.]+)", ignore_case=True)
PIECES = py_regex(rf"{V.NUMBER}\s*Stück\b", ignore_case=True)


def quantity(dimension: str | Column, amount: Column) -> Column:
    dimension = F.lit(dimension) if isinstance(dimension, str) else dimension
    return F.struct(dimension.alias("dimension"), amount.alias("amount"))


def measured(unit: Column, amount: Column) -> Column:
    """An amount of a unit in grams or millilitres."""
    unit = F.lower(unit)
    dimension = F.when(unit.isin("kg", "g"), "weight").otherwise("volume")
    return quantity(dimension, F.when(unit.isin("kg", "l", "liter"), amount * 1000).otherwise(amount))


def ingredient_quantity(raw: Column) -> Column:
    """(dimension weight, volume or count, amount in g, ml or pieces) at the start of a line; null if vague or missing."""
    text = strip(raw)
    word = F.regexp_replace(F.lower(F.regexp_extract(text, COUNT, 2)), r"\.+$", "")
    part = word.rlike("(?:" + "|".join(V.PART_ENDINGS) + r")\z")
    countable = text.rlike(COUNT) & ~word.isin([*V.VAGUE_UNITS, *V.EXACT_UNITS]) & ~part
    return (
        F.when(text.rlike(WEIGHT), measured(F.regexp_extract(text, WEIGHT, 2), number(F.regexp_extract(text, WEIGHT, 1))))
        .when(text.rlike(VOLUME), measured(F.regexp_extract(text, VOLUME, 2), number(F.regexp_extract(text, VOLUME, 1))))
        .when(countable, quantity("count", number(F.regexp_extract(text, COUNT, 1))))
    )


def pieces(text: Column) -> Column:
    return F.when(text.rlike(PIECES), quantity("count", number(F.regexp_extract(text, PIECES, 1))))


def product_quantity(grammage: Column, name: Column) -> Column:
    """What one package holds: several units together, one unit, or pieces named in the grammage or else in the name."""
    text = strip(grammage)
    total = number(F.regexp_extract(text, MULTI, 1)) * number(F.regexp_extract(text, MULTI, 2))
    return F.coalesce(
        F.when(text.rlike(MULTI), measured(F.regexp_extract(text, MULTI, 3), total)),
        F.when(text.rlike(SINGLE), measured(F.regexp_extract(text, SINGLE, 2), number(F.regexp_extract(text, SINGLE, 1)))),
        pieces(grammage),
        pieces(name),
    )


def package_count(raw: Column, grammage: Column, name: Column) -> Column:
    """(packages_needed, ingredient_amount, product_amount, dimension); null if amounts are missing or can't be compared."""
    return packages(ingredient_quantity(raw), product_quantity(grammage, name))


def packages(wanted: Column, held: Column) -> Column:
    needed = F.ceil(wanted["amount"] / F.nullif(held["amount"], F.lit(0.0))).cast("long")
    fields = F.struct(needed.alias("packages_needed"), wanted["amount"].alias("ingredient_amount"), held["amount"].alias("product_amount"), wanted["dimension"].alias("dimension"))
    return F.when((wanted["dimension"] == held["dimension"]) & (held["amount"] > 0), fields)
