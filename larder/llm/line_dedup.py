"""Removal of repeated runs of lines by a distributed suffix array over line ids.

A text's lines are its parts between newline characters, known by 128-bit ids. Prefix doubling sorts the suffixes of all line
sequences: at level k a place's rank is the place of its next 2^k lines among all such stretches in the order of ids, so equal
ranks are equal lines (runs never cross documents) and ranks are in suffix-array order to that depth. A level's ranks come
from sorting the pairs of the level before, as far as they are shared: a stretch that comes once stands between its neighbours
with a common prefix shorter than that, is in no interval of this depth, and goes no further, so unique text costs one level.

A line is removed if it lies in a run of lines, with at least `min_words` words altogether, that also starts earlier
(smaller doc_id, or earlier in the same document). An interval of suffixes whose longest common prefix is l lines or more is
named by two ranks of level log2 l, at a run's start and that many lines before its end; its first place in corpus order stays, the
runs at all others are later copies. Overlapping ones make the maximal repeated runs. The shortest runs with enough words from
each line onwards and up to each line have the same union as all (a longer run is covered by those inside it), so these
intervals are looked up, and levels end at the longest of them.

Defined results: a null text is empty and has one empty line; documents are ordered by doc_id, null first; rows that repeat
a doc_id with the same text are one document, and each row gets its result; texts that share a doc_id, or have none, but
differ are documents of their own, ordered by a hash of the text. A very long text is cut into lines as a whole. All columns are
kept, but for those named like the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, drop_cut, in_arrow, map_arrow, text_or_empty

MIN_WORDS = 4
NULL_ID = -(1 << 63)
RESULTS = ("n_lines", "n_lines_removed", "n_runs_removed")
PLACE = ["doc", "line"]


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run with `least` words from each line onwards, and up to each line; 0 where there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    stop = np.searchsorted(total, total[:-1] + least, "left")
    onwards = np.where(stop <= n, np.maximum(stop - np.arange(n), 1), 0)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    upto = np.where(start >= 0, np.maximum(np.arange(1, n + 1) - start, 1), 0)
    return onwards, upto


def document(text: str, key: str) -> Column:
    """What tells documents apart and orders them: the key, null first, and a hash of the text."""
    return F.struct(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text_or_empty(text)).alias("hash"))


def line_table(docs: DataFrame, text: str, key: str, min_words: int) -> DataFrame:
    """(doc, line, id, id2, onwards, upto): every line of every text, both halves of its id and the lengths of its runs; doc as
    `document` has it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, line, ids, after, before = [], [], [], [], []
        for t in batch.column(2).to_pylist():
            lines = t.split("\n")
            a, b = windows(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), min_words)
            size.append(len(lines))
            line.append(np.arange(len(lines)))
            ids.append(np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), "<i8").reshape(-1, 2))
            after.append(a)
            before.append(b)
        doc = [np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1)]
        arrays = [pa.array(x) for x in (*doc, np.concatenate(line), *np.ascontiguousarray(np.concatenate(ids).T), np.concatenate(after), np.concatenate(before))]
        return pa.RecordBatch.from_arrays(arrays, ["key", "hash", "line", "id", "id2", "onwards", "upto"])

    source = docs.select(document(text, key).alias("doc"), text_or_empty(text).alias("text")).select("doc.key", "doc.hash", "text")
    rows = map_arrow(source, run, "key long, hash long, line long, id long, id2 long, onwards long, upto long")
    return rows.select(F.struct("key", "hash").alias("doc"), "line", "id", "id2", "onwards", "upto")


def shared(rows: DataFrame, names: list[str], old: list[DataFrame]) -> DataFrame:
    """The rows whose (names) come at several places, with `rank`, in the order of names.

    Classes are aggregated, combined before the shuffle, sorted over all tasks and numbered in that order (numbers rise, with
    gaps), and written, so that rows and classes then meet over plain shuffles, whose partitions Spark can split: a line that
    makes up a large share of all is no one task's.
    """
    at = F.struct(*PLACE)
    classes = rows.groupBy(*names).agg(F.min(at).alias("first"), F.max(at).alias("final")).where("first != final")
    classes = cut(classes.select(*names).orderBy(*names).withColumn("rank", F.monotonically_increasing_id()))
    old.append(classes)
    return rows.join(classes, names)


def repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, first, stop): ranges of lines that lie in a run of at least `min_words` words that also starts earlier."""
    lines = cut(line_table(docs, text, key, min_words))  # used twice: for the classes and for what is joined with them
    old = [lines]
    ground = cut(shared(lines, ["id", "id2"], old).select(*PLACE, "rank", "onwards", "upto"))
    forward = ground.where("onwards > 0").select("doc", F.col("line").alias("first"), F.col("onwards").alias("size"))
    backward = ground.where("upto > 0").select("doc", (F.col("line") - F.col("upto") + 1).alias("first"), F.col("upto").alias("size"))
    runs = cut(forward.union(backward).distinct())
    longest = runs.agg(F.max("size")).first()[0] or 0
    levels = [ground]
    while 2 ** len(levels) <= longest:
        half = 1 << (len(levels) - 1)
        now = levels[-1].select(*PLACE, F.col("rank").alias("rank1"))
        later = now.select("doc", (F.col("line") - half).alias("line"), F.col("rank1").alias("rank2"))
        levels.append(cut(shared(now.join(later, PLACE), ["rank1", "rank2"], old).select(*PLACE, "rank")))
    found = None
    for k, level in enumerate(levels):
        ranks = level.select("doc", F.col("line").alias("first"), "rank")
        here = runs.where((F.col("size") >= 1 << k) & (F.col("size") < 2 << k)).join(ranks, ["doc", "first"])
        if k:
            ends = level.select("doc", (F.col("line") + (1 << k)).alias("stop"), F.col("rank").alias("rank2"))
            here = here.withColumn("stop", F.col("first") + F.col("size")).join(ends, ["doc", "stop"])
        else:
            here = here.withColumn("stop", F.col("first") + 1).withColumn("rank2", F.col("rank"))
        at = F.struct("doc", "first")
        here = here.select("doc", "first", "stop", "size", "rank", "rank2")
        earliest = cut(here.groupBy("rank", "rank2", "size").agg(F.min(at).alias("lead")))
        old.append(earliest)
        later = here.join(earliest, ["rank", "rank2", "size"]).where(at != F.col("lead")).select("doc", "first", "stop")
        found = later if found is None else found.union(later)
    out = cut(found.distinct())
    for x in (*levels, runs, *old):
        drop_cut(x)
    return out


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """The documents without their repeated lines.

    All columns are kept, the text being what is left (lines joined by newlines), and as `names` the numbers of lines before, of
    lines removed and of runs removed (maximal ones) are added. No document goes; one whose lines all go has an empty text.
    """
    kept = [c for c in docs.columns if c not in names]
    gone = repeats(docs, text=text, key=key, min_words=min_words).groupBy("doc").agg(F.collect_list(F.struct("first", "stop")).alias("ranges"))
    whole = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)))
    at = f"c{kept.index(text)}"
    rows = docs.select(document(text, key).alias("doc"), whole.alias("row"))
    rows = rows.join(gone, "doc", "left").select("row.*", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(at)
            left, n, removed, runs = [], [], [], []
            for t, ranges in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = (t or "").split("\n")
                keep = np.ones(len(lines), bool)
                for r in ranges or ():
                    keep[r["first"] : r["stop"]] = False
                n.append(len(lines))
                removed.append(int((~keep).sum()))
                runs.append(int((np.diff(keep.astype(np.int8), prepend=1) == -1).sum()))
                left.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k) if removed[-1] else t)
            columns = [pa.array(left, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n, removed, runs))], [*batch.schema.names[:-1], "n", "r", "u"])

    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)) + ", n long, r long, u long"
    return in_arrow(rows, run, schema).toDF(*kept, *names)
