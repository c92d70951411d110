"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The test items are a stated query set, taken in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters; all documents
are read against each block, and nothing but the block's tables is broadcast. The score is the best local alignment's, in
parts of that of a verbatim copy.

Seeds are word pairs, adjacent or with one word between, in item and text. They miss nothing: an alignment with the score s
of an item with n words has m matches and E errors (inserted, left out or changed words), with 2 m - E >= 2 s n and m <= n. Of
its m - 1 steps from match to match, those with two errors or more number at most E / 2, so at least s n - 1 steps have one error
or none, and such a step is a seed of its first item word. Therefore each alignment
- has seeds of at least s n - 1 item words, and of at least three (or all) among the item's words that are left without the s n - 1 - 3
  whose pairs are the most frequent in the block: only these rare seeds are looked up in the texts;
- spans at most n + 2 (1 - s) n words of the text.
Stretches of text with enough rare seeds within that span go on to the count of all seeds and of words, and what can still
reach the score is aligned as a whole.

Words are runs of letters, digits and underscores in lower case, so punctuation and white space don't matter.

Defined results: null and empty texts hold nothing; items with fewer than three words, null ones too, are never found; repeated
rows (documents or items) give repeated rows; a null doc_id or item_id is kept. A very long text is searched as a whole, in
memory in proportion to it; its alignments run over overlapping windows, each longer than any alignment that counts. Extra
columns are ignored by `contaminated` and kept by `clean`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fresh, map_arrow, text_or_empty

LEAST_WORDS = 3
STEPS = (1, 2)
NEEDED = 3
MIN_SCORE = 0.5
BLOCK_ITEMS = 5_000
BLOCK_CHARS = 10_000_000
#: Cells of an alignment's row over which pairs are aligned together.
CELLS = 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def steps_needed(size: int, score: float) -> int:
    """Item words with a seed that an alignment of this score has at least."""
    return max(1, math.ceil(score * size - 1e-9) - 1)


class Items:
    """Word numbers and rare seeds of a block of test items."""

    def __init__(self, texts: list[str], score: float):
        vocabulary: dict[str, int] = {}
        self.score = score
        self.items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int64) for t in texts]
        self.vocabulary = vocabulary
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.span = self.size + np.ceil(2 * (1 - score) * self.size).astype(np.int64)
        pairs = [self.pairs(x) if len(x) >= LEAST_WORDS else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for x in self.items]
        codes, counts = np.unique(np.concatenate([*(c for _, c in pairs), np.zeros(0, np.int64)]), return_counts=True)
        owner, code = [], []
        for i, (place, c) in enumerate(pairs):
            if not len(c):
                continue
            often = np.zeros(len(self.items[i]), np.int64)  # of a word: how frequent its pairs are
            np.maximum.at(often, place, counts[np.searchsorted(codes, c)])
            starts = np.arange(len(often) - 1)  # the last word begins no pair
            left_out = max(0, steps_needed(len(often), score) - NEEDED)
            rare = np.zeros(len(often), bool)
            rare[starts[np.argsort(often[:-1], kind="stable")][: len(starts) - left_out]] = True
            c = np.unique(c[rare[place]])
            owner.append(np.full(len(c), i))
            code.append(c)
        empty = np.zeros(0, np.int64)
        code, owner = np.concatenate([*code, empty]), np.concatenate([*owner, empty])
        order = np.lexsort((owner, code))
        self.codes, first = np.unique(code[order], return_index=True)
        self.owner = owner[order]
        self.bounds = np.append(first, len(code))
        # rare seeds in a stretch, at least: no more than the alignment has, nor than the item's rare words
        self.needed = np.array([min(NEEDED, steps_needed(n, score)) for n in self.size], np.int64)

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the pairs of known words that are one or two places apart."""
        place, code = [], []
        for d in STEPS:
            a, b = numbers[:-d], numbers[d:]
            at = np.flatnonzero((a >= 0) & (b >= 0))
            place.append(at)
            code.append(a[at] << 32 | b[at])
        return np.concatenate(place), np.concatenate(code)

    def numbers(self, text: str) -> np.ndarray:
        found = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))

    def stretches(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, end word): where the text has enough rare seeds for an alignment, with room for all of it."""
        if not len(self.codes):
            return
        place, code = self.pairs(numbers)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = self.codes[at] == code
        place, at = place[same], at[same]
        count = self.bounds[at + 1] - self.bounds[at]
        total = int(count.sum())
        if not total:
            return
        item = self.owner[np.repeat(self.bounds[at], count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)]
        place = np.repeat(place, count)
        # a seed's first text word, once: pairs of the same word at both distances are one step
        key = np.unique(item * (len(numbers) + 1) + place)
        item, place = key // (len(numbers) + 1), key % (len(numbers) + 1)
        need, span = self.needed[item], self.span[item]
        far = np.arange(len(item)) + need - 1
        inside = far < len(item)
        far = np.minimum(far, len(item) - 1)
        good = np.flatnonzero(inside & (item[far] == item) & (place[far] - place < span))
        if not len(good):
            return
        new = np.ones(len(good), bool)
        new[1:] = (item[good[1:]] != item[good[:-1]]) | (place[good[1:]] - place[good[:-1]] > span[good[1:]])
        begin = np.flatnonzero(new)
        last = good[np.append(begin[1:] - 1, len(good) - 1)]
        begin = good[begin]
        lo = np.maximum(place[begin] - span[begin], 0)
        hi = np.minimum(place[last] + 2 * span[begin] + 1, len(numbers))
        for i, a, b in zip(item[begin].tolist(), lo.tolist(), hi.tolist(), strict=True):
            step = 3 * int(self.span[i])
            for start in range(a, max(a + 1, b - int(self.span[i])), step):  # windows that overlap by a whole alignment
                yield i, start, min(b, start + step + int(self.span[i]))


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of pairs of word numbers, and where in the text each ends (exclusive)."""
    height, width = max(map(len, items)), max(map(len, texts))
    a = np.full((len(items), height), -2)
    b = np.full((len(items), width), -3)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, : len(x)] = x
        b[i, : len(y)] = y
    ramp = -GAP * np.arange(width + 1)
    row = np.zeros((len(items), width + 1), np.int64)
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for k in range(height):
        gain = np.where(a[:, k, None] == b, MATCH, MISMATCH)
        now = np.maximum(row + GAP, 0)
        now[:, 1:] = np.maximum(now[:, 1:], row[:, :-1] + gain)
        now[:, 0] = 0
        row = np.maximum.accumulate(now + ramp, axis=1) - ramp
        row[a[:, k] == -2] = 0
        top = row.argmax(axis=1)
        value = row[np.arange(len(items)), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
    return best, end


def found_in(block: Items, text: str) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of the best alignment of each item that reaches the block's score in the text."""
    numbers = block.numbers(text)
    hopeful = []
    present = np.zeros(len(block.vocabulary) + 1, bool)  # the last place is an unknown word's
    for i, lo, hi in block.stretches(numbers):
        item, n = block.items[i], int(block.size[i])
        stretch = numbers[lo:hi]
        present[stretch] = True
        known = present[item]
        present[stretch] = False
        if known.sum() < block.score * n:
            continue
        place, code = block.pairs(item)
        seeds = place[np.isin(code, block.pairs(stretch)[1])]
        if len(np.unique(seeds)) >= steps_needed(n, block.score):
            hopeful.append((i, lo, hi))
    best: dict[int, tuple[float, int, int]] = {}
    hopeful.sort(key=lambda h: h[2] - h[1])
    start = 0
    while start < len(hopeful):
        stop = start + 1
        while stop < len(hopeful) and (stop + 1 - start) * (hopeful[stop][2] - hopeful[stop][1]) <= CELLS:
            stop += 1
        part = hopeful[start:stop]
        start = stop
        score, end = align([block.items[i] for i, _, _ in part], [numbers[lo:hi] for _, lo, hi in part])
        for (i, lo, _), s, e in zip(part, score.tolist(), end.tolist(), strict=True):
            n = int(block.size[i])
            value = (s / (MATCH * n), int(max(lo, lo + e - n)), int(lo + e))
            if value[0] < block.score - 1e-12:
                continue
            if i not in best or (-value[0], value[1]) < (-best[i][0], best[i][1]):
                best[i] = value
    return [(i, *v) for i, v in sorted(best.items())]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    min_score: float = MIN_SCORE, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(key, item_key, score, first_word, end_word): every item that aligns with a document by at least `min_score`."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, score double, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for rows in in_blocks(benchmark.select(F.col(item_key).alias("id"), text_or_empty(item_text).alias("text")), block_items):
        block = spark.sparkContext.broadcast(Items([r.text for r in rows], min_score))
        ids = [r.id for r in rows]

        def run(batch: pa.RecordBatch, block=block, ids=ids) -> pa.RecordBatch:
            found = [(i, *f) for i, t in enumerate(batch.column(1).to_pylist()) for f in found_in(block.value, t)]
            at, item, *rest = zip(*found, strict=True) if found else [[]] * 5
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([ids[i] for i in item], target), *(pa.array(x, t) for x, t in zip(rest, (pa.float64(), pa.int64(), pa.int64()), strict=True))]
            return pa.RecordBatch.from_arrays(columns, [key, item_key, "score", "first_word", "end_word"])

        target = pa.string() if item_kind == "string" else pa.int32() if item_kind == "int" else pa.int64()
        out = out.union(map_arrow(docs.select(F.col(key), text_or_empty(text).alias("text")), run, schema))
    return out


def in_blocks(items: DataFrame, size: int) -> Iterator[list]:
    """The rows in lists of at most `size` rows and BLOCK_CHARS characters (a longer item stands alone), so that the
    driver never holds, and no broadcast has, more than one list."""
    rows: list = []
    chars = 0
    for row in items.toLocalIterator():
        if rows and (len(rows) == size or chars + len(row.text) > BLOCK_CHARS):
            yield rows
            rows, chars = [], 0
        rows.append(row)
        chars += len(row.text)
    if rows:
        yield rows


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that hold no test item. Each row is judged by its own text, whatever rows share its key."""
    of_row = fresh("text_digest", [*docs.columns, *benchmark.columns])
    bad_digest = fresh("bad_digest", docs.columns)
    rows = docs.withColumn(of_row, F.md5(text_or_empty(text)))
    bad = contaminated(rows, benchmark, text=text, key=of_row, **options).select(F.col(of_row).alias(bad_digest)).distinct()
    return rows.join(bad, F.col(of_row) == F.col(bad_digest), "left_anti").select(*docs.columns)
