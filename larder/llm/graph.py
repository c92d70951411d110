"""Connected components by alternating star operations (Kiveris et al. 2014), with lineage cut every round.

Each task first joins up a bounded share of the links by itself, so that only links between such shares take further rounds: a
long path within one share costs none.

The smallest neighbour of each node is aggregated and written before links are joined with it, so the join has a plain
shuffle on both sides, whose partitions Spark can split: the links of a node that has a large share of all are no one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from larder.llm.common import cut, drop_cut, in_arrow

#: Links that a task joins up by itself; it never holds more than some times as many.
SHARE = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the smallest node that it reaches by these links) for all nodes but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[left], least[right]
        if (x == y).all():
            break
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != least[least]).any():
            least = least[least]
    below = least != np.arange(len(nodes))
    return nodes[below], nodes[least[below]]


def joined_up(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, a share of them at a time put together as stars. `links` is a written table."""
    share = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) < share:
                continue
            a, b = stars(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            held = []
            if len(a) >= 4 * share:
                yield out()
                a = b = np.zeros(0, np.int64)
        a, b = stars(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
        yield out()

    return in_arrow(links.coalesce(max(1, -(-links.count() // share))), run, "a long, b long")


def state(links: DataFrame) -> Row:
    """What tells one set of links from another."""
    hashes = (F.sum(h.cast("decimal(38,0)")) for h in (F.hash("a", "b"), F.xxhash64("a", "b")))
    return links.agg(F.count("*"), *hashes).first()


def large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new links and what to drop. Each node's larger neighbours point to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), least


def small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new links and what to drop. Each node and its smaller neighbours point to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return cut(moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that can be reached.

    Nodes without links are not returned. Nulls on either side are dropped, as are loops.
    """
    links = cut(edges.where("a != b").select("a", "b").distinct())
    now = cut(joined_up(links))
    drop_cut(links)
    seen = state(now)
    while True:
        wide, *old = large_star(now)
        after, *more = small_star(wide)
        for x in (now, wide, *old, *more):
            drop_cut(x)
        now, last = after, seen
        seen = state(now)
        if seen == last:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(out.select(F.col("component").alias("node"), "component").distinct())
