"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits that differ in at most four bits differ in at most two bits of one of their halves. Each half is a
segment with a table of its own. Every fingerprint enters the table at all values within one bit of its segment, so two
fingerprints whose segments differ in at most two bits meet at a value between them; what meets is then verified over all 64
bits. A meeting place with more than BUCKET fingerprints (a dense cloud of near copies) is not compared pair by pair: its
fingerprints are joined through the centres of the whole 64-bit balls of radius two, which links exactly the same components
with rows in proportion to the fingerprints.

Nulls and texts without words have fingerprint zero and link like any other. Repeated rows share their fingerprint and
component. A null doc_id is kept; it is never the smallest of a component with other ids. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, drop_cut, in_arrow, map_arrow, spread, text_or_empty
from larder.llm.graph import components

MAX_DISTANCE = 4
#: Fingerprints that are compared pair by pair at one place of a table; above it balls are used, with the same links.
BUCKET = 4096
SMALL = 48
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """64-bit hashes of the text's shingles in order; one of all words if they are fewer, none without words."""
    found = WORD.findall(text.encode().translate(LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = (np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + np.arange(len(found))).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(words, len(ends)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, last, strict=False)], np.uint64)


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles; zero without words."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 4) -> DataFrame:
    """key and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key), text_or_empty(text).alias("text")), run, f"`{key}` {kind}, fp long")


def table_entries(fps: DataFrame) -> DataFrame:
    """(place, fp): each fingerprint at all values within one bit of each of its halves."""
    near = F.array(*(F.lit(x) for x in (0, *(1 << b for b in range(32)))))

    def places(segment: int, value: Column) -> Column:
        return F.transform(near, lambda m: F.lit(segment << 32).bitwiseOR(value.bitwiseXOR(m)))

    low = F.col("fp").bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned("fp", 32)
    return fps.select(F.explode(F.concat(places(0, low), places(1, high))).alias("place"), "fp")


def matches(place: np.ndarray, fp: np.ndarray, bucket: int = BUCKET, small: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between fingerprints at equal places (rows sorted by place), and the fingerprints of places too full for pairs.

    Of the places where a pair meets only one counts: its common value, else the smallest value between.
    """
    segment = (place >> np.uint64(32)) & np.uint64(1)
    mine = np.where(segment == 1, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
    value = place & np.uint64(0xFFFFFFFF)
    bounds = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
    sizes = np.diff(bounds)
    left, right, full = [], [], []

    def verified(i: np.ndarray, j: np.ndarray) -> None:
        both = mine[i] ^ mine[j]
        # the places where the pair meets are its values and, at two bits, the two values between
        d = np.bitwise_count(both)
        here = np.where(d == 0, mine[i] == value[i], np.where(d == 1, value[i] == np.minimum(mine[i], mine[j]), True))
        low_bit = both & (~both + np.uint64(1))
        a, b = mine[i] ^ low_bit, mine[j] ^ low_bit
        here = np.where(d == 2, value[i] == np.minimum(a, b), here)
        ok = here & (np.bitwise_count(fp[i] ^ fp[j]) <= MAX_DISTANCE)
        left.append(fp[i[ok]])
        right.append(fp[j[ok]])

    size_of = np.repeat(sizes, sizes)
    rows = np.flatnonzero((size_of > 1) & (size_of <= small))
    for shift in range(1, int(size_of[rows].max()) if len(rows) else 0):
        i = rows[rows + shift < len(place)]
        i = i[place[i] == place[i + shift]]
        if not len(i):
            break
        verified(i, i + shift)
    for k in np.flatnonzero((sizes > small) & (sizes <= bucket)):
        at = np.arange(bounds[k], bounds[k + 1])
        if (mine[at] == mine[at[0]]).all() and mine[at[0]] != value[at[0]]:
            continue  # one common value elsewhere: those pairs count there
        for lo in range(0, len(at), 512):
            i, j = np.meshgrid(at[lo : lo + 512], at, indexing="ij")
            keep = i < j
            verified(i[keep], j[keep])
    for k in np.flatnonzero(sizes > bucket):
        full.append(fp[bounds[k] : bounds[k + 1]])
    empty = np.zeros(0, np.uint64)
    return (*(np.concatenate([*x, empty]) for x in (left, right, full)),)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints that connect exactly those at up to four differing bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.uint64)  # the rows of a place that may go on in the next batch
        overfull = None  # a place that has proved too full, whose rows pass straight through

        def out(a: np.ndarray, b: np.ndarray, full: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([x, full]).view(np.int64) for x in (a, b))
            for lo in range(0, len(a), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part])], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in (0, 1)])
            rows = np.concatenate([held, rows], axis=1)
            if overfull is not None:
                stop = np.searchsorted(rows[0], overfull, "right")
                yield from out(rows[1, :0], rows[1, :0], rows[1, :stop])
                rows = rows[:, stop:]
                overfull = overfull if not rows.shape[1] else None
            if not rows.shape[1]:
                held = rows
                continue
            start = np.searchsorted(rows[0], rows[0, -1], "left")
            held, rows = rows[:, start:], rows[:, :start]
            if held.shape[1] > bucket:
                overfull = held[0, 0]
                yield from out(held[1, :0], held[1, :0], held[1])
                held = held[:, :0]
            if rows.shape[1]:
                yield from out(*matches(rows[0], rows[1], bucket))
        if held.shape[1]:
            yield from out(*matches(held[0], held[1], bucket))

    met = in_arrow(spread(table_entries(fps), "place").sortWithinPartitions("place"), run, "a long, b long")
    return met.distinct()


def ball_links(crowded: DataFrame) -> DataFrame:
    """Links among fingerprints of full places: all within two bits of a centre are within four bits of each other."""
    masks = [0, *(1 << b for b in range(64)), *((1 << a) | (1 << b) for a, b in combinations(range(64), 2))]
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    centres = crowded.select(F.explode(F.transform(signed, lambda m: m.bitwiseXOR(F.col("fp")))).alias("centre"), "fp")
    least = centres.groupBy("centre").agg(F.min("fp").alias("b"))
    return centres.join(least, "centre").select(F.col("fp").alias("a"), "b").where("a != b").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Fingerprint and component of every document.

    Returns key, fp (long), component_id: the smallest key that can be reached over links of at most four differing bits.
    """
    marked = cut(fingerprints(docs, text=text, key=key, words=words))
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("first")))
    found = cut(links(distinct.select("fp"), bucket))
    edges = found.where("a != b")
    crowded = found.where("a = b").select(F.col("a").alias("fp"))
    if crowded.limit(1).count():
        edges = edges.union(ball_links(crowded))
    roots = components(edges)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = cut(named)
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))
    of_fp = named.join(least, "root").select("fp", "component_id")
    out = cut(marked.join(of_fp, "fp").select(key, "fp", "component_id"))
    for x in (marked, distinct, found, roots, named, least):
        drop_cut(x)
    return out
