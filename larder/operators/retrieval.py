"""Hybrid retrieval of products for ingredients: lexical and dense ranks fused by reciprocal ranks.

The catalog is a stated set that each task reads in blocks of at most BLOCK products, while keys are dealt over all tasks, so
every key meets every product but no pairs are shuffled. Of each block only rows that can still be among the best go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.similarity import lexical_score
from larder.functions.vocabulary import RRF_K, TOP_K

BLOCK = 50_000
Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """A stand-in for a sentence encoder: hashed character trigrams, of length one. It is deterministic, not semantic."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        padded = f"  {t.lower()} "
        for k in range(len(padded) - 2):
            h = int.from_bytes(hashlib.blake2b(padded[k : k + 3].encode(), digest_size=4).digest(), "little")
            out[i, h % dim] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(rows: DataFrame, text: str, embedder: Embedder = hashed_embedding, out: str = "emb") -> DataFrame:
    """Adds an embedding column; the embedder is set up once for each Python worker's batch iterator."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder(texts.fillna("").tolist())))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(run, "array<float>")(text))


def cosine(a: str, b: str) -> F.Column:
    """Dot product of vectors of length one, in built-in expressions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rank_by(scores: np.ndarray) -> np.ndarray:
    """Ranks from 0, larger scores first, then smaller positions."""
    out = np.empty(len(scores), np.int64)
    out[np.lexsort((np.arange(len(scores)), -scores))] = np.arange(len(scores))
    return out


def fused_top(lexical: np.ndarray, lengths: np.ndarray, dense: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best products. Ties at cuts go to the larger position; among the lexically best 3k, short texts
    of one score may gain rank."""
    rank = rank_by(lexical)
    best = np.lexsort((-np.arange(len(lexical)), -lexical))[: 3 * k]
    again = best[np.lexsort((np.arange(len(best)), lengths[best], -lexical[best]))]
    rank[again] = np.minimum(rank[again], np.arange(len(again)))
    fused = 1 / (RRF_K + 1 + rank) + 1 / (RRF_K + 1 + rank_by(dense))
    return np.lexsort((-np.arange(len(fused)), -fused))[:k]


def retrieve(keys: DataFrame, products: DataFrame, *, k: int = TOP_K, max_products: int = BLOCK, score: Callable[[str, str], float] = lexical_score) -> DataFrame:
    """(key, pos, product_id) of the k best products of each key.

    keys: (key, query, emb); products: (prod_idx, id, norm, text, emb). A catalog of up to `max_products` rows, which is
    checked, is sent to the executors; a larger one goes by `retrieve_by_ranks`.
    """
    if products.limit(max_products + 1).count() > max_products:
        return retrieve_by_ranks(keys, products, k=k)
    rows = products.select("prod_idx", "id", "norm", F.length("text").alias("length"), "emb").toPandas().sort_values("prod_idx")
    norms, ids, lengths = rows.norm.tolist(), rows.id.tolist(), rows.length.to_numpy()
    matrix = np.stack(rows.emb.to_numpy()) if len(rows) else np.zeros((0, 1), np.float32)
    sent = keys.sparkSession.sparkContext.broadcast((norms, ids, lengths, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms, ids, lengths, matrix = sent.value
        for batch in batches:
            out = []
            for key, query, emb in zip(batch.key, batch["query"], batch.emb, strict=True):
                lexical = np.array([score(query, n) for n in norms])
                best = fused_top(lexical, lengths, matrix @ np.asarray(emb, np.float32), k) if len(norms) else []
                out += [(key, pos, ids[i]) for pos, i in enumerate(best)]
            yield pd.DataFrame(out, columns=["key", "pos", "product_id"])

    return keys.select("key", "query", "emb").mapInPandas(run, "key string, pos int, product_id string")


def product_blocks(products: DataFrame, block: int) -> Iterator[list]:
    """The catalog in lists of at most `block` products; the driver holds one at a time."""
    rows: list = []
    for row in products.select("prod_idx", "id", "norm", F.length("text").alias("length"), "emb").toLocalIterator():
        rows.append(row)
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


def by_blocks(keys: DataFrame, products: DataFrame, columns: list[str], fn: Callable[..., list[tuple]], schema: str, block: int, score: Callable[[str, str], float]) -> DataFrame:
    """Rows that `fn` makes of each key and each block of the catalog: fn(key row, block arrays, lexical, dense)."""
    spark = keys.sparkSession
    out = spark.createDataFrame([], schema)
    for part in product_blocks(products, block):
        sent = spark.sparkContext.broadcast(
            {"prod_idx": np.array([r.prod_idx for r in part]), "id": [r.id for r in part], "norm": [r.norm for r in part], "length": np.array([r.length for r in part]), "emb": np.array([r.emb for r in part], np.float32)}
        )

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            b = sent.value
            for batch in batches:
                rows = []
                for key in batch.itertuples(index=False):
                    lexical = np.array([score(key.query, n) for n in b["norm"]])
                    rows += fn(key, b, lexical, b["emb"] @ np.asarray(key.emb, np.float32))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

        out = out.union(keys.select(*columns).mapInPandas(run, schema))
    return out


PAIR_SCHEMA = "key string, prod_idx long, id string, length int, lexical double, dense double"


def score_pairs(keys: DataFrame, products: DataFrame, block: int = BLOCK, score: Callable[[str, str], float] = lexical_score) -> DataFrame:
    """(key, prod_idx, id, length, lexical, dense) of all pairs; for small catalogs and tests, since all pairs are made."""

    def every(key, b: dict, lexical: np.ndarray, dense: np.ndarray) -> list[tuple]:
        return [(key.key, int(i), d, int(n), float(x), float(y)) for i, d, n, x, y in zip(b["prod_idx"], b["id"], b["length"], lexical, dense, strict=True)]

    return by_blocks(keys, products, ["key", "query", "emb"], every, PAIR_SCHEMA, block, score)


def fuse(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """(key, pos, product_id) from scores of pairs, by windows over each key: the same result as `fused_top`.

    Ranks over the whole catalog may be given as lex_rank and dense_rank; else the pairs are the whole catalog.
    """
    by = Window.partitionBy("key")
    ranks = {"lex_rank": by.orderBy(F.desc("lexical"), "prod_idx"), "dense_rank": by.orderBy(F.desc("dense"), "prod_idx")}
    ranked = scores.withColumns({n: F.row_number().over(w) - 1 for n, w in ranks.items() if n not in scores.columns})
    ranked = ranked.withColumn("cut_rank", F.row_number().over(by.orderBy(F.desc("lexical"), F.desc("prod_idx"))) - 1)
    in_cut = F.col("cut_rank") < 3 * k
    ranked = ranked.withColumn("again", F.row_number().over(by.orderBy(F.desc(in_cut), F.desc("lexical"), "length", "cut_rank")) - 1)
    lex = F.when(in_cut, F.least("lex_rank", "again")).otherwise(F.col("lex_rank"))
    fused = ranked.withColumn("fused", 1 / (RRF_K + 1 + lex) + 1 / (RRF_K + 1 + F.col("dense_rank")))
    best = fused.withColumn("pos", F.row_number().over(by.orderBy(F.desc("fused"), F.desc("prod_idx"))) - 1).where(F.col("pos") < k)
    return best.select("key", "pos", F.col("id").alias("product_id"))


def retrieve_by_ranks(keys: DataFrame, products: DataFrame, *, k: int = TOP_K, block: int = BLOCK, score: Callable[[str, str], float] = lexical_score) -> DataFrame:
    """As `retrieve` for a catalog of any size, in two passes over its blocks.

    At least k products have a fused score over 1 / (RRF_K + k), so one among the best has a rank of at most 2k + RRF_K - 1
    in one of the two orders. The first pass finds these few for each key; the second counts, block by block, how many
    products go before each of them. No other pairs are made.
    """
    n = max(3 * k, 2 * k + RRF_K)

    def best(key, b: dict, lexical: np.ndarray, dense: np.ndarray) -> list[tuple]:
        i = b["prod_idx"]
        chosen = np.unique(np.concatenate([np.lexsort(o)[:n] for o in ((i, -lexical), (-i, -lexical), (i, -dense))]))
        return [(key.key, int(i[c]), b["id"][c], int(b["length"][c]), float(lexical[c]), float(dense[c])) for c in chosen]

    found = by_blocks(keys, products, ["key", "query", "emb"], best, PAIR_SCHEMA, block, score)
    by = Window.partitionBy("key")
    orders = {"a": (F.desc("lexical"), F.asc("prod_idx")), "b": (F.desc("lexical"), F.desc("prod_idx")), "c": (F.desc("dense"), F.asc("prod_idx"))}
    found = found.withColumns({f"_{x}": F.row_number().over(by.orderBy(*o)) for x, o in orders.items()}).where(F.least(*(f"_{x}" for x in orders)) <= n).drop(*(f"_{x}" for x in orders))
    asked = keys.join(found.groupBy("key").agg(F.collect_list(F.struct("prod_idx", "lexical", "dense")).alias("found")), "key")

    def before(key, b: dict, lexical: np.ndarray, dense: np.ndarray) -> list[tuple]:
        out = []
        for f in key.found:
            ranks = (int(((x > f[c]) | ((x == f[c]) & (b["prod_idx"] < f["prod_idx"]))).sum()) for c, x in (("lexical", lexical), ("dense", dense.astype(float))))
            out.append((key.key, f["prod_idx"], *ranks))
        return out

    counts = by_blocks(asked, products, ["key", "query", "emb", "found"], before, "key string, prod_idx long, lex_rank long, dense_rank long", block, score)
    ranks = counts.groupBy("key", "prod_idx").agg(F.sum("lex_rank").alias("lex_rank"), F.sum("dense_rank").alias("dense_rank"))
    return fuse(found.join(ranks, ["key", "prod_idx"]), k)
