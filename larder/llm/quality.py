"""Quality classifier by co-training of two views.

One view sees a text's content (its words and their beginnings), the other the page's metadata: language, source, size, and
how the page is laid out (shapes of its tokens, variety of tokens and lines). Each view blends a logistic regression on
labelled documents with a naive Bayes classifier on labelled and pseudo-labelled ones, calibrated on held-out labelled rows. In
each round both views score all unlabelled documents, and each hands those on of which it is confident: the other's class
counts are made anew from the labelled rows and from what it was handed. What a view may hand on is measured: its least
(greatest) probability above (below) which held-out rows have the label with a precision of PRECISION; if no such probability
has MIN_ROWS rows, it hands none of that kind on. At last both calibrated views are combined, with weights of zero or more, and
all documents are scored. There is one such pair for the label quality and one for the label toxic; a document is kept if it is
probably good and probably not toxic.

Bounds: regressions are fitted on at most `n_labelled` labelled documents, those with the smallest hashes of their doc_id;
they come to the driver, at most one row for each id. Pseudo-labels and scoring cover all documents; of them only class counts
of a fixed length come to the driver. Pseudo-labelled documents of a kind weigh no more than the labelled ones of that kind.

Defined results: a text without words, null ones too, has the labels' share as its probability; null metadata is a value of its own; a document with several labels takes
their majority (a tie counts as 1), null labels don't count; of several texts under one labelled id the fit takes one; without
labels, or with labels of one kind only, the probability is the labels' share, or null without any, and a null one rejects
nothing. Repeated rows score alike. A very long text is handled as a whole, with memory in proportion to it. All columns are
kept, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, drop_cut, in_arrow, map_arrow, slices, text_or_empty

WORD_BITS, SHAPE_BITS, META_DIM = 18, 10, 1 << 12
WORD_DIM, SHAPE_DIM = 1 << WORD_BITS, 1 << SHAPE_BITS
N_LABELLED, ROUNDS = 6_000, 2
PRECISION, MIN_ROWS = 0.95, 10
#: Characters of texts whose tokens are found together, so that arrays stay in the processor's cache.
SLICE = 300_000
#: Columns of labels: probability of the value 1, and whether that value is the good one.
HEADS = {"quality": True, "toxic": False}
RESULTS = (*(f"p_{h}" for h in HEADS), "keep")
STEM = 4  # bytes of a word's beginning that are a feature of their own


def signs() -> np.ndarray:
    """For each byte the sign that stands for it in a token's shape: one each for capitals, small letters (bytes beyond ASCII
    among them) and digits, other characters themselves."""
    out = np.arange(256)
    out[ord("A") : ord("Z") + 1], out[ord("a") : ord("z") + 1], out[128:], out[ord("0") : ord("9") + 1] = 1, 2, 2, 3
    return out


SIGNS = signs()
LOWER = np.arange(256)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
INNER = ~np.isin(np.arange(256), list(b".,;:!?\"'()[] \t\n\x0b\x0c\r"))  # what a word may begin and end with
#: Hashes of bytes and signs, and of their places in a token.
_OF_BYTE, _OF_SIGN, _OF_PLACE = np.random.default_rng(11).integers(0, 1 << 63, (3, 256), np.int64).astype(np.uint64) | np.uint64(1)


def runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ranges, none of them empty: each place, its offset in the range, and where ranges begin among the places."""
    first = np.cumsum(size) - size
    offset = np.arange(int(size.sum())) - np.repeat(first, size)
    return np.repeat(start, size) + offset, offset, first


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token between white space: its start, hashes of its word (lower case, without punctuation at its ends) and of
    the word's beginning, 0 without a word, and of its shape (signs, runs as one, the first eight)."""
    inside = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return start, *(np.zeros(0, np.uint64),) * 3
    at, offset, first = runs(start, stop - start)
    sign = SIGNS[raw[at]]
    kept = (offset == 0) | (sign > 3) | (sign != np.concatenate([[0], sign[:-1]]))
    rank = np.cumsum(kept)
    rank -= np.repeat(rank[first], stop - start)
    shape = np.add.reduceat(np.where(kept & (rank < 8), _OF_SIGN[sign] * _OF_PLACE[np.clip(rank, 0, 255)], np.uint64(0)), first)
    inner = np.flatnonzero(INNER[raw])
    lo, hi = np.searchsorted(inner, start), np.searchsorted(inner, stop)
    has = np.flatnonzero(hi > lo)
    word, stem = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    if len(has):
        begin, size = inner[lo[has]], inner[hi[has] - 1] + 1 - inner[lo[has]]
        at, offset, first = runs(begin, size)
        part = _OF_BYTE[LOWER[raw[at]]] * _OF_PLACE[np.minimum(offset, 255)]
        word[has] = np.add.reduceat(part, first)
        begins = np.add.reduceat(np.where(offset < STEM, part, np.uint64(0)), first)
        stem[has] = np.where(size > STEM, begins + np.uint64(1), word[has])
    return start, word, stem, shape


def distinct(x: np.ndarray) -> np.ndarray:
    """In order; sorting is several times faster here than numpy's unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def features(texts: list[str], langs: list[str | None], sources: list[str | None], sizes: list[int | None]) -> tuple[Rows, Rows]:
    """The rows of both views: places of words and their beginnings; places and values of metadata."""
    words, meta = [], []
    for lo, hi in slices(texts, SLICE):
        data = [t.encode() for t in texts[lo:hi]]
        raw = np.frombuffer(b"\n".join(data), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
        start, word, stem, shape = tokens(raw)
        row = np.searchsorted(ends, start, "right")
        n = np.bincount(row, minlength=hi - lo)
        key = distinct(np.concatenate([row << WORD_BITS | mixed(word, WORD_BITS), row << WORD_BITS | mixed(stem, WORD_BITS)]))
        words.append((lo + (key >> WORD_BITS), key & (WORD_DIM - 1)))
        n_words = np.bincount(distinct(row << 40 | mixed(word, 40)) >> 40, minlength=hi - lo)
        key, count = np.unique(row * SHAPE_DIM + mixed(shape, SHAPE_BITS), return_counts=True)
        of = key // SHAPE_DIM
        named = []
        for i, t in enumerate(texts[lo:hi]):
            lines = t.split("\n")
            size = "?" if sizes[lo + i] is None else max(0, int(sizes[lo + i])).bit_length()
            variety = round(8 * n_words[i] / min(n[i], 400)) if n[i] else "none"
            names = (f"l={langs[lo + i]}", f"s={sources[lo + i]}", f"n={size}", f"ln={langs[lo + i]} {size}", f"v={variety}", f"r={round(8 * len(set(lines)) / len(lines))}", f"w={len(lines).bit_length()}")
            names += (f"t={round(len(t) / n[i]) if n[i] else 0}",)
            named.append([SHAPE_DIM + zlib.crc32(x.encode()) % (META_DIM - SHAPE_DIM) for x in names])
        rows = np.concatenate([of, np.repeat(np.arange(hi - lo), len(named[0]))])
        places = np.concatenate([key % SHAPE_DIM, np.array(named, np.int64).ravel()])
        values = np.concatenate([3 * np.sqrt(count / np.maximum(n[of], 1)), np.ones(len(places) - len(of))])
        order = np.argsort(rows, kind="stable")
        meta.append((lo + rows[order], places[order], values[order]))
    join = lambda parts, k: np.concatenate([*(p[k] for p in parts), np.zeros(0, np.int64)])
    return Rows(len(texts), WORD_DIM, join(words, 0), join(words, 1)), Rows(len(texts), META_DIM, join(meta, 0), join(meta, 1), join(meta, 2))


class Rows:
    """Sparse rows."""

    def __init__(self, n: int, dim: int, row: np.ndarray, place: np.ndarray, value: np.ndarray | None = None):
        self.n, self.dim, self.row, self.place = n, dim, row.astype(np.int32), place.astype(np.int32)
        self.value = np.ones(len(place), np.float32) if value is None else value.astype(np.float32)

    @classmethod
    def of(cls, places: list[np.ndarray], values: list[np.ndarray] | None, dim: int) -> Rows:
        row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
        return cls(len(places), dim, row, join(places), None if values is None else join(values))

    def each(self) -> list[slice]:
        """Where each row's places are."""
        bounds = np.searchsorted(self.row, np.arange(self.n + 1)).tolist()
        return [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.place], self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.value * e[self.row], self.dim)

    def narrowed(self, keep: np.ndarray, scale: np.ndarray) -> Rows:
        """With only the places in `keep`, numbered anew, and their values scaled."""
        at = keep[self.place]
        place = self.place[at]
        return Rows(self.n, int(keep.sum()), self.row[at], (np.cumsum(keep) - 1)[place], self.value[at] * scale[place])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, target: np.ndarray, weight: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows; the weights' penalty is l2, the offset has none."""
    w, b = np.zeros(rows.dim), 0.0
    m, v, mb, vb = np.zeros(rows.dim), np.zeros(rows.dim), 0.0, 0.0
    weight = weight / max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        e = weight * (sigmoid(rows.dot(w) + b) - target)
        g, gb = rows.back(e) + l2 * w, e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.08 * (1 - t / (steps + 1)) + 0.005
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def calibrate(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of zero or more for columns of logits, and an offset, by Newton steps with a small penalty."""
    free = list(range(logits.shape[1]))
    soft = target * (1 - 2 / (len(target) + 2)) + 1 / (len(target) + 2)
    while True:
        x = np.column_stack([np.clip(logits[:, free], -15, 15), np.ones(len(logits))])
        c = np.zeros(x.shape[1])
        penalty = np.diag([0.05] * (x.shape[1] - 1) + [0.001])
        for _ in range(50):
            p = sigmoid(x @ c)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(c)), x.T @ (p - soft) + penalty @ c)
            c -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if (c[:-1] >= 0).all():
            out = np.zeros(logits.shape[1] + 1)
            out[[*free, -1]] = c
            return out
        free.pop(int(c[:-1].argmin()))


def confident(p: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """(low, high): probabilities up to which, and from which on, a view is confident; -1 and 2 if it never is."""

    def least(p: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-p, kind="stable")
        n = np.arange(1, len(p) + 1)
        ok = (np.cumsum(y[order]) >= PRECISION * n) & (n >= MIN_ROWS) & np.append(p[order][1:] != p[order][:-1], True)
        return float(p[order][ok.nonzero()[0][-1]]) if ok.any() else 2.0

    high, low = least(p, target), 1 - least(1 - p, 1 - target)
    return min(low, 0.5 - 1e-9) if low >= 0 else -1.0, max(high, 0.5)


class View:
    """One view of one label: a regression's weights, log ratios of class counts, and how both are blended."""

    def __init__(self, rows: Rows, target: np.ndarray, base: np.ndarray, l2: float, steps: int, least: int):
        self.dim = rows.dim
        self.own = [rows.back(np.where(base & (target == y), 1.0, 0.0)) for y in (0, 1)]
        self.n_own = [int((base & (target == y)).sum()) for y in (0, 1)]
        self.learn([np.zeros(self.dim)] * 2, [0, 0])
        keep = np.bincount(rows.place, minlength=self.dim) >= least
        # features count by how much more often either kind of document has them
        scale = np.abs(self.ratio) if least > 1 else np.ones(self.dim)
        w, self.offset = fit(rows.narrowed(keep, scale), np.where(base, target, 0), base.astype(float), l2, steps)
        self.weight = np.zeros(self.dim)
        self.weight[keep] = w * scale[keep]

    def learn(self, counts: list[np.ndarray], n: list[int]) -> None:
        """Class counts of the labelled rows, and of `n` pseudo-labelled ones, which weigh no more than those."""
        total = [own + counts[y] * min(1.0, self.n_own[y] / max(n[y], 1)) for y, own in enumerate(self.own)]
        seen = ((total[0] + total[1]) > 0).sum()
        self.ratio = np.log(total[1] + 1) - np.log(total[1].sum() + seen) - np.log(total[0] + 1) + np.log(total[0].sum() + seen)

    def logits(self, rows: Rows) -> np.ndarray:
        size = np.sqrt(np.maximum(np.bincount(rows.row, rows.value, rows.n), 1))
        return np.column_stack([rows.dot(self.weight) + self.offset, rows.dot(self.ratio) / size])

    def calibrate(self, rows: Rows, target: np.ndarray, held: np.ndarray) -> None:
        logits = self.logits(rows)[held]
        # calibrated each by itself, so that the one which learns from the other view counts too where both know enough
        each = np.array([calibrate(logits[:, [k]], target[held])[0] for k in (0, 1)])
        whole = calibrate((np.clip(logits, -15, 15) @ each)[:, None], target[held])
        self.blend = np.append(whole[0] * each, whole[1])
        self.low, self.high = confident(self.probability(logits), target[held])

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip(logits, -15, 15) @ self.blend[:-1] + self.blend[-1])

    def sent(self, p: np.ndarray) -> list[np.ndarray]:
        """Rows that are handed on as 0 and as 1."""
        return [p <= self.low, p >= self.high]


class Model:
    """Both views of one label and how they are combined; or a constant where labels don't allow a fit."""

    def __init__(self, sides: tuple[Rows, Rows], target: np.ndarray):
        """target: 0, 1, or NaN if not known. A fifth of the labelled rows is held out for calibration."""
        labelled = np.flatnonzero(~np.isnan(target))
        self.share = float(target[labelled].mean()) if len(labelled) else None
        self.views: list[View] | None = None
        self.told: list[list[list[int]]] = []  # by round: rows that either view handed on, as 0 and as 1
        self.sides, self.target = sides, target
        self.held = np.random.default_rng(5).permutation(labelled)[: len(labelled) // 5]
        base = ~np.isnan(target)
        base[self.held] = False
        if len(self.held) < 10 or len(np.unique(target[self.held])) < 2 or len(np.unique(target[base])) < 2:
            return
        self.views = [View(sides[0], target, base, 2e-5, 150, 4), View(sides[1], target, base, 1e-3, 120, 1)]
        self.settle()

    def settle(self) -> None:
        for view, rows in zip(self.views, self.sides, strict=True):
            view.calibrate(rows, self.target, self.held)
        self.combine = calibrate(np.column_stack([v.logits(r)[self.held] for v, r in zip(self.views, self.sides, strict=True)]), self.target[self.held])

    def learn(self, counts: list[list[np.ndarray]], n: list[list[int]]) -> None:
        """counts and n by view that learns, then by label."""
        self.told.append([n[1], n[0]])
        for view, c, k in zip(self.views, counts, n, strict=True):
            view.learn(c, k)
        self.settle()

    def sendable(self) -> Model:
        """Without the rows that it was fitted on."""
        self.sides = self.target = self.held = None
        return self

    def probabilities(self, sides: tuple[Rows, Rows]) -> np.ndarray:
        if self.views is None:
            return np.full(sides[0].n, np.nan if self.share is None else self.share)
        logits = np.column_stack([v.logits(r) for v, r in zip(self.views, sides, strict=True)])
        p = sigmoid(np.clip(logits, -15, 15) @ self.combine[:-1] + self.combine[-1])
        return np.where(np.bincount(sides[0].row, minlength=sides[0].n) > 0, p, self.share)


def handed_on(views: list[View], sides: tuple[Rows, Rows]) -> tuple[list[list[np.ndarray]], list[list[int]]]:
    """What each view learns from the other about unlabelled rows: class counts and numbers of rows, by view that learns."""
    sent = [v.sent(v.probability(v.logits(r))) for v, r in zip(views, sides, strict=True)]
    counts = [[sides[k].back(chosen.astype(float)) for chosen in sent[1 - k]] for k in (0, 1)]
    return counts, [[int(chosen.sum()) for chosen in sent[1 - k]] for k in (0, 1)]


FEATURES = "words binary, meta binary"


def packed(batch: pa.RecordBatch, at: int) -> list[pa.Array]:
    """The columns of FEATURES from a text at `at` and the metadata after it."""
    pack = zstandard.ZstdCompressor(level=1).compress
    text, side = features(*(batch.column(at + i).to_pylist() for i in range(4)))
    words = [pack(np.diff(text.place[x], prepend=0).astype("<u4").tobytes()) for x in text.each()]
    meta = [side.place[x].astype("<u2").tobytes() + side.value[x].astype("<f4").tobytes() for x in side.each()]
    return [pa.array(words, pa.binary()), pa.array(meta, pa.binary())]


def unpacked(words: list[bytes], meta: list[bytes]) -> tuple[Rows, Rows]:
    unpack = zstandard.ZstdDecompressor().decompress
    places = [np.cumsum(np.frombuffer(unpack(x), "<u4"), dtype=np.int64) for x in words]
    size = [len(x) // 6 for x in meta]
    at = [np.frombuffer(x, "<u2", n) for x, n in zip(meta, size, strict=True)]
    values = [np.frombuffer(x, "<f4", n, 2 * n) for x, n in zip(meta, size, strict=True)]
    return Rows.of(places, None, WORD_DIM), Rows.of(at, values, META_DIM)


def metadata(docs: DataFrame) -> list:
    names = {"lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(n).cast(t) if n in docs.columns else F.lit(None).cast(t)).alias(f"m_{n}") for n, t in names.items()]


def summed(payloads: Iterator[bytes]) -> np.ndarray | None:
    out = None
    for x in payloads:
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<f4").astype(np.float64)
        out = part if out is None else out + part
    return out


def exchange(models: dict[str, Model], pool: DataFrame) -> None:
    """One round over all unlabelled rows (those of `pool` whose label is null): both views learn from each other."""
    open_heads = {h: m.views for h, m in models.items() if m.views}
    sent = pool.sparkSession.sparkContext.broadcast(open_heads)
    length = 2 * (WORD_DIM + META_DIM) + 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {h: np.zeros(length) for h in sent.value}
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, (h, views) in enumerate(sent.value.items()):
                rows = batch.filter(batch.column(2 + i).is_null())
                counts, n = handed_on(views, unpacked(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
                total[h] += np.concatenate([*counts[0], *counts[1], *n])
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(np.concatenate([*total.values()]).astype("<f4").tobytes())], pa.binary())], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = summed(x for batch in batches for x in batch.column(0).to_pylist())
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(out.astype("<f4").tobytes())], pa.binary())], ["counts"])

    # one row of counts for each task, added up by tasks as many as the square root, so that few rows come to the driver
    fan = math.isqrt(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    made = in_arrow(pool.select("words", "meta", *(f"y_{h}" for h in open_heads)), count, "counts binary")
    made = in_arrow(made.repartition(fan), add, "counts binary")
    total = summed(row.counts for row in made.toLocalIterator())
    if total is None:
        return
    for (_, model), x in zip(((h, models[h]) for h in open_heads), total.reshape(len(open_heads), length), strict=True):
        text, meta, n = np.split(x, [2 * WORD_DIM, length - 4])
        model.learn([list(text.reshape(2, -1)), list(meta.reshape(2, -1))], n.astype(np.int64).reshape(2, 2).tolist())


def trained(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", n_labelled: int = N_LABELLED, rounds: int = ROUNDS) -> dict[str, Model]:
    """A model for each label of HEADS."""
    ys = [f"y_{h}" for h in HEADS]
    majority = [(F.avg(F.col(h).cast("double")) >= 0.5).cast("double").alias(f"y_{h}") for h in HEADS]
    # written, so that the hot id of a skewed table can be split where documents meet labels
    known = cut(labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(*majority))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *packed(batch, 1)], ["k", "words", "meta"])

    source = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text"), *metadata(docs))
    rows = map_arrow(source, run, f"k {docs.schema[key].dataType.simpleString()}, {FEATURES}")
    # one plan at all sizes: labels that are broadcast on small tables would make the disk of large ones a surprise
    pool = cut(rows.join(known.hint("merge"), "k", "left").select("k", "words", "meta", *ys))
    labelled = pool.where(F.coalesce(*ys).isNotNull())
    n = labelled.agg(F.approx_count_distinct("k")).first()[0]
    if n > n_labelled:  # those with small hashes, some more than needed, so that few rows are put in order
        share = min(1.0, 1.3 * n_labelled / n)
        labelled = labelled.where(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < int(share * (1 << 40)))
    one = labelled.groupBy("k").agg(F.min(F.struct("words", "meta", *ys)).alias("r"))
    got = one.orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 40)), "k").limit(n_labelled).select("k", "r.*").toArrow().sort_by("k")
    sides = unpacked(got.column("words").to_pylist(), got.column("meta").to_pylist())
    models = {h: Model(sides, np.array(got.column(f"y_{h}").to_pylist(), dtype=float)) for h in HEADS}
    if any(m.views for m in models.values()):
        for _ in range(rounds):
            exchange(models, pool)
    for x in (known, pool):
        drop_cut(x)
    return {h: m.sendable() for h, m in models.items()}


def scored(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", names: tuple[str, ...] = RESULTS, **bounds: int) -> DataFrame:
    """All columns of the documents and, as `names`, the probabilities of quality and toxic, and whether to keep (boolean)."""
    models = trained(docs, labels, text=text, key=key, **bounds)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    kept = [c for c in docs.columns if c not in names]
    n = len(kept)
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), text_or_empty(text).alias("text"), *metadata(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = features(*(batch.column(n + i).to_pylist() for i in range(4)))
        keep, columns = np.ones(batch.num_rows, bool), []
        for h, good in HEADS.items():
            p = sent.value[h].probabilities(sides)
            columns.append(pa.array(p, mask=np.isnan(p)))
            keep &= ~((p < 0.5) if good else (p >= 0.5))
        return pa.RecordBatch.from_arrays([*batch.columns[:n], *columns, pa.array(keep)], [*(f"c{i}" for i in range(n)), "p0", "p1", "keep"])

    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]
    return map_arrow(rows, run, ", ".join([*kinds, "p0 double, p1 double, keep boolean"])).toDF(*kept, *names)
