"""Nearest vectors of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096


def scored(rows: DataFrame, queries: DataFrame, *, top: int | None = None, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, cosine) of rows against the queries, which are taken in blocks of at most `block`.

    With `top`, each batch of rows passes on only its best for each query, so what is shuffled doesn't grow with all pairs.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    out = None
    part: list = []

    def one(part: list) -> DataFrame:
        ids = np.array([r[0] for r in part])
        matrix = np.array([r[1] for r in part], np.float64).reshape(len(part), -1)
        sent = spark.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, unit = sent.value
            for batch in batches:
                if not len(batch):
                    continue
                x = np.array(batch[vector].tolist(), np.float64)
                cosine = unit @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T
                keys = batch[key].to_numpy()
                n = len(keys) if top is None else min(top, len(keys))
                best = np.lexsort((np.broadcast_to(keys, cosine.shape), -np.round(cosine, 9)), axis=1)[:, :n]
                yield pd.DataFrame({"query_id": np.repeat(ids, n), key: keys[best].ravel(), "cosine": np.take_along_axis(cosine, best, 1).ravel()})

        return rows.select(key, vector).mapInPandas(run, f"query_id {kind}, `{key}` {kind}, cosine double")

    for r in queries.select(key, vector).toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == block:
            out = one(part) if out is None else out.union(one(part))
            part = []
    if part or out is None:
        out = one(part) if out is None else out.union(one(part))
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, pos, key) of the k nearest rows of every query by cosine; the smaller key goes first on ties."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), key)
    ranked = scored(rows, queries, top=k, key=key, vector=vector, block=block).withColumn("pos", F.row_number().over(best) - 1)
    return ranked.where(F.col("pos") < k).select("query_id", "pos", key)
