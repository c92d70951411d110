"""Scores of ingredient and product pairs: pluggable scorers, the features of a boosted model, and filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import vocabulary as V
from larder.functions.regex import py_regex
from larder.functions.similarity import UDFS, weighted_ratio
from larder.functions.text import feature_text, feature_tokens, jaccard
from larder.operators.retrieval import cosine

PairScorer = Callable[[list[str], list[str]], np.ndarray]


def stand_in_scorer(raws: list[str], texts: list[str]) -> np.ndarray:
    """Deterministic stand-in for a cross-encoder: a fuzzy ratio in parts of one. It knows nothing of meaning."""
    return np.array([weighted_ratio(a.lower(), b.lower()) / 100 for a, b in zip(raws, texts, strict=True)])


def score_pairs(pairs: DataFrame, scorer: PairScorer = stand_in_scorer, *, raw: str = "raw", text: str = "text") -> DataFrame:
    """Adds score, by batches of pairs."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(np.asarray(scorer(a.tolist(), b.tolist()), dtype=float))

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pairs.withColumn("score", F.pandas_udf(run, "double")(raw, text))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rounded(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: None if xs is None else [round(float(x), 1) for x in xs])


def amounts(text: Column) -> Column:
    """Distinct (amount, dimension) named anywhere in a text, amounts rounded to one digit."""
    low = F.replace(F.lower(text), F.lit(","), F.lit("."))
    pattern = F.lit(py_regex(V.FEATURE_AMOUNT, ignore_case=True))
    units = F.transform(F.regexp_extract_all(low, pattern, 2), F.lower)
    values = F.transform(F.regexp_extract_all(low, pattern, 1), lambda x: x.try_cast("double"))
    scaled = _rounded(F.zip_with(values, units, lambda v, u: F.when(u.isin("kg", "l"), v * 1000).otherwise(v)))
    kind = lambda u: F.when(u.isin("kg", "g"), "mass").when(u.isin("l", "ml"), "vol").otherwise("count")
    return F.array_distinct(F.filter(F.zip_with(scaled, units, lambda v, u: F.struct(v.alias("amount"), kind(u).alias("dim"))), lambda s: s["amount"].isNotNull()))


def first_word(text: Column) -> Column:
    """The first word of a feature text; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.split(feature_text(text), " +"), lambda w: w != ""), 0), F.lit(""))


def features(pairs: DataFrame, *, ingredient: str = "ingredient", name: str = "name", category: str = "category", emb_a: str = "ing_emb", emb_b: str = "prod_emb", score: str = "score") -> DataFrame:
    """Adds features, an array of 17 numbers in the order that the boosted model was trained with."""
    a, b = F.col(ingredient), F.col(name)
    prepared = pairs.withColumns(
        {"_ta": feature_tokens(a), "_tb": feature_tokens(b), "_tc": feature_tokens(F.col(category)), "_ga": amounts(a), "_gb": amounts(b), "_fa": first_word(a), "_fb": first_word(b)}
        | {f"_{n}": UDFS[n](a, b) for n in ("token_sort_ratio", "token_set_ratio", "partial_ratio", "weighted_ratio")}
    )
    ta, tb, tc, ga, gb = (F.col(f"_{n}") for n in ("ta", "tb", "tc", "ga", "gb"))
    both = (F.size(ga) > 0) & (F.size(gb) > 0)
    values = [
        F.col("_token_sort_ratio"), F.col("_token_set_ratio"), F.col("_partial_ratio"), F.col("_weighted_ratio"),
        jaccard(ta, tb), F.size(F.array_intersect(ta, tb)), F.size(ta), F.size(tb),
        F.length(b) / F.greatest(F.length(a), F.lit(1)),
        F.when(both, F.arrays_overlap(ga, gb).cast("int")).otherwise(-1), F.size(ga) > 0, F.size(gb) > 0,
        jaccard(ta, tc), F.size(tc), (F.col("_fa") == F.col("_fb")) & (F.col("_fa") != ""),
        cosine(emb_a, emb_b), F.col(score),
    ]
    made = F.array(*(v.cast("double") for v in values))
    return prepared.withColumn("features", made).drop(*(c for c in prepared.columns if c.startswith("_")))


def boosted(pairs: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds gbm, the prediction of a model on the features, by batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(np.asarray(predict(np.stack(x.to_numpy())), dtype=float))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pairs.withColumn("gbm", F.pandas_udf(run, "double")("features"))


def passing(pairs: DataFrame, threshold: float = V.MIN_SCORE) -> DataFrame:
    """Pairs of at least the threshold by the boosted model where there is one, else by the score."""
    return pairs.where(F.col("gbm" if "gbm" in pairs.columns else "score") >= threshold)
