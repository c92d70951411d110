r"""Chat formatting of reply trees.

Nodes point to the message that they answer. Iterative self-joins double the reach of every node's pointer, so paths from
root to leaf of any length are known after a logarithmic number of joins, with the depth and the summed score of each branch.
The best branches of a tree are ranked, the nodes on a chosen path are gathered by the same pointers, and each path is
formatted as one conversation:

    ### role: text</turn>

with a newline after each turn. Inside roles and texts a backslash is doubled, and one is set before the slash of `</`, before
each # that follows another #, and before a colon in a role; thus no control string can come from a text, and dropping each
first backslash of a pair restores it. The loss mask is the list of ranges (in code points) of the texts of one role.

Defined results: null roles and texts are empty; null ids of trees are one tree; a parent that doesn't exist makes its node a
root; nodes on a cycle, or below one, belong to no conversation; a tree without nodes has no row. Texts may have any length;
one conversation is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.common import cut, drop_cut, in_arrow, map_arrow, spread

END = "</turn>\n"
ESCAPES = re.compile(r"\\|(?<=<)/|(?<=#)#")
ROLE_ESCAPES = re.compile(r"\\|:|(?<=<)/|(?<=#)#")
TURN = re.compile(r"### ((?:[^:\\]|\\.)*+): (.*?)</turn>\n", re.S)
UNESCAPE = re.compile(r"\\(.)", re.S)
LOSS_ROLE = "assistant"


def escape(text: str, places: re.Pattern = ESCAPES) -> str:
    return places.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the ranges of its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, ROLE_ESCAPES)}: ", escape(text)
        if role == loss_role:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError if anything else stands in it."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def branches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """From (tree, node, parent, score): (tree, node, depth, total, leaf) of the nodes that have a root; pointers; old frames.

    The k-th frame of pointers is (tree, node, up), where up is 2^k answers above the node. Only nodes that haven't reached
    their root take part in a further join.
    """
    links = nodes.select("tree", "node", "parent", "score")
    exists = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = links.join(exists, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(0).alias("depth"), F.col("score").alias("total"))
    # depth and total: of the nodes from this one up to, and without, `up`; complete where up is null
    now = cut(links.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long")))
    n = now.count()
    done, open_ = now.where("up IS NULL"), now.where("up IS NOT NULL")
    pointers, old = [], [now]
    while open_.limit(1).count() and 1 << len(pointers) <= 2 * n:  # beyond that only cycles are open
        pointers.append(open_)
        above = done.union(open_).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        now = cut(open_.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")))
        old.append(now)
        done, open_ = done.union(now.where("up IS NULL")), now.where("up IS NOT NULL")
    parents = nodes.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    done = done.join(parents, ["tree", "node"], "left")
    return done.select("tree", "node", "depth", "total", F.col("inner").isNull().alias("leaf")), pointers, old


def best_paths(nodes: DataFrame, n_best: int) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, rank, node, depth) of the nodes on each tree's `n_best` best paths; and frames to drop at the end.

    Branches are ranked by their nodes' summed score, then by depth, then by the leaf's id.
    """
    found, pointers, old = branches(nodes)
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    leaves = found.where("leaf").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_best)
    marked = cut(leaves.select("tree", "rank", "node"))
    old.append(marked)
    for up in reversed(pointers):
        above = marked.join(up.select("tree", "node", "up"), ["tree", "node"]).select("tree", "rank", F.col("up").alias("node"))
        marked = cut(marked.union(above))
        old.append(marked)
    depth = found.select("tree", "node", "depth")
    return marked.join(depth, ["tree", "node"]), old


def format_trees(nodes: DataFrame, *, n_best: int = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Format the best paths of trees given as (tree long, node long, parent long, role, text, score double).

    Returns tree, rank, n_turns, formatted and loss (array of ranges start, stop in code points).
    """
    paths, old = best_paths(nodes, n_best)
    paths = cut(paths)
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = spread(paths.join(said, ["tree", "node"]), "tree").groupBy("tree", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "role", "text"))).alias("turns"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [format_turns([(t["role"], t["text"]) for t in turns], loss_role) for turns in batch.column(2).to_pylist()]
        ranges = pa.array([[{"start": a, "stop": b} for a, b in mask] for _, mask in made], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        sizes = pa.array([len(t) for t in batch.column(2)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array([f for f, _ in made], pa.string()), ranges], ["tree", "rank", "n_turns", "formatted", "loss"])

    out = map_arrow(turns.select("tree", "rank", "turns"), run, "tree long, rank int, n_turns long, formatted string, loss array<struct<start:long,stop:long>>")
    for x in old:
        drop_cut(x)
    return out


def chains(rows: DataFrame, *, tree: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text"), loss_role: str = LOSS_ROLE) -> DataFrame:
    """Nodes of conversations without branches: each row answers the one before it, in the order given.

    A null tree is the smallest long. The score is the length of the loss role's texts.
    """
    place = F.row_number().over(Window.partitionBy("tree").orderBy(*order)).cast("long")
    known = rows.select(F.coalesce(F.col(tree).cast("long"), F.lit(-(1 << 63))).alias("tree"), *order)
    score = F.when(F.col("role") == loss_role, F.length(F.coalesce("text", F.lit("")))).otherwise(0).cast("double")
    return known.withColumn("node", place).select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", score.alias("score"))


def digests(formatted: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """What is read back from formatted conversations: turns, and the text under the loss mask."""

    def row(text: str, loss: list[dict]) -> tuple:
        turns = read_turns(text)
        learnt = "".join(unescape(text[r["start"] : r["stop"]]) for r in loss)
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(t, m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    shape = f"`{key}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_arrow(formatted.select(F.when(F.col("tree") != -(1 << 63), F.col("tree")).alias(key), "formatted", "loss"), run, shape)
