"""Rules that veto pairs of ingredient and product: state, colour and form of spices."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import vocabulary as V
from larder.functions.regex import py_regex

FROZEN, CANNED, DRIED, FRESH, UNKNOWN = "tk", "konserve", "getrocknet_verarbeitet", "frisch", "unbekannt"


def says(text: Column, pattern: str) -> Column:
    return text.rlike(py_regex(pattern, ignore_case=True))


def holds(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is part of the text."""
    return F.lower(text).rlike("|".join(words))


def states(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def product_state(name: Column, category: Column) -> Column:
    """One state; category and name count alike, but only the name can say dried."""
    both = F.concat(category, F.lit(" "), name)
    return F.when(says(both, V.FROZEN), FROZEN).when(says(both, V.CANNED), CANNED).when(says(name, V.DRIED), DRIED).when(says(both, V.FRESH), FRESH).otherwise(UNKNOWN)


def ingredient_states(text: Column) -> Column:
    """The states that a product for this ingredient may have: what the text says, else what is usual."""
    return (
        F.when(says(text, V.FROZEN), states(FROZEN))
        .when(says(text, V.CANNED), states(CANNED))
        .when(says(text, V.DRIED), states(DRIED))
        .when(says(text, V.FRESH), states(FRESH))
        .when(holds(text, V.SPICES), states(DRIED))
        .when(holds(text, V.HERBS), states(FRESH, FROZEN, DRIED))
        .when(holds(text, V.CANNED_OR_FROZEN), states(CANNED, FROZEN, FRESH))
        .when(holds(text, V.FILLETS), states(FRESH, FROZEN))
        .when(says(text, V.CHOPPED), states(FRESH, FROZEN, CANNED))
        .otherwise(states(FRESH, FROZEN))
    )


def state_mismatch(text: Column, name: Column, category: Column) -> Column:
    state = product_state(name, category)
    return (state != UNKNOWN) & ~F.array_contains(ingredient_states(text), state)


def colours(text: Column) -> Column:
    """The colours that stand alone in the text, in the vocabulary's order."""
    return F.array_compact(F.array(*(F.when(says(text, rf"\b(?:{words})\b"), name) for name, words in V.COLOURS.items())))


def any_colour(text: Column) -> Column:
    return says(text, V.ANY_COLOUR)


def disjoint(a: Column, b: Column) -> Column:
    """Both sides say something, and nothing in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def colour_mismatch(text: Column, name: Column) -> Column:
    return ~any_colour(text) & disjoint(colours(text), colours(name))


def forms(text: Column) -> Column:
    return F.array_compact(F.array(F.when(says(text, V.GROUND), "gemahlen"), F.when(says(text, V.WHOLE), "ganz")))


def form_mismatch(text: Column, name: Column) -> Column:
    """Whole against ground, but not for what is ground at home anyway."""
    return ~says(text, V.GROUND_AT_HOME) & ~says(text, V.SOLD_WHOLE) & disjoint(forms(text), forms(name))


def name_column(pairs: DataFrame) -> Column:
    return F.col("product_name3" if "product_name3" in pairs.columns else "product_name").cast("string")


def add_state_columns(pairs: DataFrame) -> DataFrame:
    """ingredient_states, product_state and state_mismatch from ingredient_text, the product's name and category."""
    name, text = name_column(pairs), F.col("ingredient_text")
    category = F.col("category").cast("string") if "category" in pairs.columns else F.lit("")
    return pairs.withColumns({"ingredient_states": ingredient_states(text), "product_state": product_state(name, category), "state_mismatch": state_mismatch(text, name, category)})


def add_colour_columns(pairs: DataFrame) -> DataFrame:
    name, text = name_column(pairs), F.col("ingredient_text")
    return pairs.withColumns({"ingredient_colors": colours(text), "product_colors": colours(name), "color_mismatch": colour_mismatch(text, name)})


def add_form_columns(pairs: DataFrame) -> DataFrame:
    name, text = name_column(pairs), F.col("ingredient_text")
    return pairs.withColumns({"ingredient_forms": forms(text), "product_forms": forms(name), "form_mismatch": form_mismatch(text, name)})


def vetoed(text: Column, name: Column, category: Column) -> Column:
    """Whether any rule forbids the pair."""
    return state_mismatch(text, name, category) | colour_mismatch(text, name) | form_mismatch(text, name)
