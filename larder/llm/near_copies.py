"""Near copies by SimHash and exact shingle similarity: texts whose sets of word shingles have a Jaccard similarity of at least 0.8.

SimHash fingerprints of the shingles are linked by multi-index hashing (see `simhash`), each with the smallest one within
reach, and what they link is verified. At similarity 0.8 fingerprints of 64 bits lie about 10 bits apart, some pairs 18, and no
table of segments reaches that; so a prefix filter, which misses none, adds the pairs beyond that reach. With all shingles in
one global order, two sets of similarity t share one of the first n - ceil(t n) + 1 shingles of each. Any order is right; here
shingles that are common in a sample of the texts come last, so that a passage which many texts hold hardly makes pairs. The
sample decides the cost only.

Texts that share such a shingle are candidates if sizes and places in the order leave the similarity open. A candidate's sketches
(how many shingles have each value of their hashes' low bits) bound from above what the sets share; only pairs that this bound
leaves open are verified on their whole sets. Of a shingle that more than SMALL sets share, neighbours in a random order are verified
first, then all pairs that these links have not joined yet and the sketches leave open; where these are more than MANY for each set,
sets are compared in place, without a row for each pair: the components are those of all pairs.

Texts with equal sets (compared by 64-bit hashes, as shingles are) are one set from the start; so are texts without words,
null ones too. A text with fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, drop_cut, fresh, in_arrow, map_arrow, spread, text_or_empty
from larder.llm.graph import components
from larder.llm.simhash import ball_links, majority, shingle_hashes
from larder.llm.simhash import links as near_fingerprints

WORDS = 5
SIMILARITY = 0.8
#: Sets sharing a shingle that are compared pair by pair at once.
SMALL = 32
#: Open pairs for each set of a shingle that are verified as rows.
MANY = 8
#: The order of shingles: texts in the sample, how many of them make a shingle common, and how many common ones are told apart.
SAMPLE, COMMON, TOLD = 20_000, 8, 200_000


def digest(text: str = "text") -> Column:
    """With the key, what tells rows apart; rows equal in both are one."""
    return F.md5(text_or_empty(text))


def place(digest: Column, key: Column) -> Column:
    """Both as one column: rows joined by it lie as `dropDuplicates` by it wants them, so texts are shuffled once."""
    return F.md5(F.concat(digest, F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))))


def at_least(share: float, size: np.ndarray | int) -> np.ndarray:
    return np.ceil(share * np.asarray(size) - 1e-9).astype(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """How many of the shingles have each value of their hashes' low bits, some four each; 255 stands for that or more."""
    m = max(8, 1 << (max(1, len(found) // 4) - 1).bit_length())
    return np.minimum(np.bincount((found & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8)


def unfolded(x: bytes | np.ndarray) -> np.ndarray:
    counts = np.frombuffer(x, np.uint8).astype(np.int32)
    counts[counts == 255] = 1 << 16
    return counts


def folded(counts: np.ndarray, m: int) -> np.ndarray:
    return counts.reshape(-1, m).sum(axis=0)


def common_shingles(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in the sample, in order of their hashes, and how common."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(t, words)) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.select(text_or_empty(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counted = map_arrow(some, run, "token long").groupBy("token").count().where(F.col("count") >= COMMON)
    got = counted.orderBy(F.desc("count"), "token").limit(TOLD).toArrow()
    token, count = (got.column(i).to_numpy() for i in (0, 1))
    token = token.view(np.uint64)
    order = np.argsort(token)
    return token[order], count[order]


def marked(docs: DataFrame, text: str, key: str, words: int, similarity: float) -> DataFrame:
    """(key, digest, sid, n, prefix, sketch, fp) of each row: its set's hash and size, the first shingles in the global order, the
    set's sketch, and the text's fingerprint."""
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, words))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, often = order.value
        sids, sizes, prefixes, sketches, fps = [], [], [], [], []
        for t in batch.column(2).to_pylist():
            hashes = shingle_hashes(t, words)
            found = np.unique(hashes)
            n = len(found)
            sketches.append(sketch(found).tobytes())
            fps.append(majority(hashes))
            sids.append(xxhash.xxh3_64_intdigest(found.tobytes()))
            sizes.append(n)
            if n and len(token):
                at = np.minimum(np.searchsorted(token, found), len(token) - 1)
                found = found[np.lexsort((found, np.where(token[at] == found, often[at], 0)))]
            prefixes.append(found[: n - int(at_least(similarity, n)) + 1].tobytes())
        sids, fps = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sids, fps))
        columns = [sids, pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary()), fps]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["key", "digest", "sid", "n", "prefix", "sketch", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), digest(text).alias("digest"), text_or_empty(text).alias("text"))
    return map_arrow(rows, run, f"key {kind}, digest string, sid long, n long, prefix binary, sketch binary, fp long")


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets of one fingerprint, and sets whose fingerprints are within reach, in proportion to the sets: each with the
    smallest one only, as all others that are similar come from the prefix filter too."""
    of = cut(sets.where("n > 0").groupBy("fp").agg(F.min("sid").alias("first")))
    found = cut(near_fingerprints(of.select("fp")))
    near = found.where("a != b")
    crowded = found.where("a = b").select(F.col("a").alias("fp"))
    if crowded.limit(1).count():
        near = near.union(ball_links(crowded))
    near = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a").agg(F.min("b").alias("b"))
    between = near.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select("x", "y")
    within = sets.where("n > 0").join(of, "fp").select(F.col("sid").alias("x"), F.col("first").alias("y"))
    pairs = between.union(within).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = cut(pairs)
    for x in (of, found):
        drop_cut(x)
    return out


def places(sets: DataFrame) -> DataFrame:
    """(token, sid, n, at, label): each set under each shingle of its prefix, with the shingle's place in the order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        size = [len(x) for x in found]
        sid, n, label = (np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1, 3))
        at = np.concatenate([np.arange(k) for k in size])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(found), sid, n, at, label)], ["token", "sid", "n", "at", "label"])

    return map_arrow(sets.where("n > 0").select("sid", "n", "prefix", "label"), run, "token long, sid long, n long, at long, label long")


def by_token(rows: DataFrame, pairs: Callable[[np.ndarray, list[bytes]], list[np.ndarray]], schema: str) -> DataFrame:
    """`pairs` over whole tokens: a matrix (token, sid, n, at, label) of complete groups, ordered by token, at a time, and
    the sets of its rows if `rows` has them as a sixth column."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[pa.RecordBatch]:
            found = pairs(np.concatenate([t for t, _ in parts], axis=1), [g for _, x in parts for g in x])
            for lo in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in found], names)

        held: list[tuple[np.ndarray, list[bytes]]] = []
        for batch in batches:
            table = np.stack([batch.column(i).to_numpy() for i in range(5)])
            grams = batch.column(5).to_pylist() if batch.num_columns > 5 else []
            if not table.shape[1]:
                continue
            start = np.searchsorted(table[0], table[0, -1], "left")
            if start or (held and table[0, 0] != held[0][0][0, 0]):
                yield from out([*held, (table[:, :start], grams[:start])])
                held = []
            held.append((table[:, start:], grams[start:]))
        if held:
            yield from out(held)

    return in_arrow(spread(rows, "token").sortWithinPartitions("token"), run, schema)


def open_pairs(table: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may still be similar if the token is the first that both sets have."""
    n, at = table[2], table[3]
    ok = np.minimum(n[i] - at[i], n[j] - at[j]) >= at_least(similarity / (1 + similarity), n[i] + n[j])
    return i[ok], j[ok]


def ordered(table: np.ndarray, i: list[np.ndarray], j: list[np.ndarray]) -> np.ndarray:
    a, b = (table[1][np.concatenate([*x, np.zeros(0, np.int64)])] for x in (i, j))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def first_pairs(table: np.ndarray, similarity: float, small: int) -> list[np.ndarray]:
    """All candidates of tokens with up to `small` sets; of others a random path, and the token itself as `full`."""
    bounds = np.flatnonzero(np.concatenate([[True], table[0, 1:] != table[0, :-1], [True]]))
    sizes = np.diff(bounds)
    left, right = [], []
    of_size = np.repeat(sizes, sizes)
    rows = np.flatnonzero((of_size > 1) & (of_size <= small))
    for shift in range(1, int(of_size[rows].max()) if len(rows) else 0):
        i = rows[rows + shift < table.shape[1]]
        i = i[table[0, i] == table[0, i + shift]]
        i, j = open_pairs(table, i, i + shift, similarity)
        left.append(i)
        right.append(j)
    full = np.flatnonzero(sizes > small)
    for k in full:
        at = np.arange(bounds[k], bounds[k + 1])
        mixed = (table[1, at] ^ table[0, at]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = at[np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")]
        i, j = open_pairs(table, at[:-1], at[1:], similarity)
        left.append(i)
        right.append(j)
    a, b = ordered(table, left, right)
    none = np.zeros(len(full), np.int64)
    return [np.concatenate([a, none]), np.concatenate([b, none]), np.concatenate([np.zeros(len(a), np.int64), table[0, bounds[full]]]), np.repeat([False, True], [len(a), len(full)])]


def cross_links(table: np.ndarray, grams: list[bytes], similarity: float) -> list[np.ndarray]:
    """Links between similar sets of each token whose labels differ, one for each two labels that they join.

    Sets are compared where they are, so rows stay in proportion to the sets. Those of the most frequent label are compared
    with the others only.
    """
    bounds = np.flatnonzero(np.concatenate([[True], table[0, 1:] != table[0, :-1], [True]]))
    left, right = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        n, label = table[2, lo:hi], table[4, lo:hi].copy()
        _, flat = np.unique(np.frombuffer(b"".join(grams[lo:hi]), np.uint64), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(n)])
        mine = np.zeros(len(flat), bool)
        names, count = np.unique(label, return_counts=True)
        for i in np.flatnonzero(label != names[count.argmax()]):
            j = np.flatnonzero(label != label[i])
            j = open_pairs(table, np.full(len(j), lo + i), lo + j, similarity)[1] - lo
            if not len(j):
                continue
            size = n[j]
            ends = np.cumsum(size)
            words = flat[np.arange(ends[-1]) + np.repeat(starts[j] - ends + size, size)]
            own = flat[starts[i] : starts[i + 1]]
            mine[own] = True
            both = np.add.reduceat(mine[words].astype(np.int64), ends - size)
            mine[own] = False
            for k in j[both >= at_least(similarity / (1 + similarity), n[i] + size)]:
                if label[k] != label[i]:
                    left.append(np.array([lo + i]))
                    right.append(np.array([lo + k]))
                    label[label == label[i]] = label[k]
    return list(ordered(table, left, right))


def open_links(table: np.ndarray, sketches: list[bytes], similarity: float, many: int) -> list[np.ndarray]:
    """Pairs of each token whose labels differ and which sketches leave open; of a token with more than `many` for each set none but
    the token itself, as `again`."""
    bounds = np.flatnonzero(np.concatenate([[True], table[0, 1:] != table[0, :-1], [True]]))
    left, right, again = [], [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        label = table[4, lo:hi]
        size = np.array([len(x) for x in sketches[lo:hi]])
        # of two sketches the wider one is folded
        rows, place = {}, {}
        for m in np.unique(size):
            at = np.flatnonzero((size >= m) & (similarity * size <= 4 * m))
            rows[m] = np.stack([folded(unfolded(sketches[lo + k]), m) for k in at])
            place[m] = np.zeros(hi - lo, np.int64)
            place[m][at] = np.arange(len(at))
        names, count = np.unique(label, return_counts=True)
        major = label == names[count.argmax()]
        i_of, j_of, n_open = [], [], 0
        for i in np.flatnonzero(~major):
            j = np.flatnonzero((label != label[i]) & (major | (np.arange(hi - lo) > i)))
            j = open_pairs(table, np.full(len(j), lo + i), lo + j, similarity)[1] - lo
            for m in np.unique(size[j]):
                k = j[size[j] == m]
                level = min(m, size[i])
                shared = np.minimum(rows[level][place[level][i]], rows[level][place[level][k]]).sum(axis=1)
                k = k[shared >= at_least(similarity / (1 + similarity), table[2, lo + i] + table[2, lo + k])]
                i_of.append(np.full(len(k), lo + i))
                j_of.append(lo + k)
                n_open += len(k)
            if n_open > many * (hi - lo):
                break
        if n_open > many * (hi - lo):
            again.append(table[0, lo])
        else:
            left += i_of
            right += j_of
    a, b = ordered(table, left, right)
    none = np.zeros(len(again), np.int64)
    tokens = np.concatenate([np.zeros(len(a), np.int64), np.array(again, np.int64)])
    return [np.concatenate([a, none]), np.concatenate([b, none]), tokens, np.repeat([False, True], [len(a), len(again)])]


def sifted(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the sets' sketches leave open."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = at_least(similarity / (1 + similarity), batch.column(2).to_numpy() + batch.column(3).to_numpy())
        keep = []
        for x, y, k in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), least.tolist(), strict=True):
            m = min(len(x), len(y))
            keep.append(np.minimum(folded(unfolded(x), m), folded(unfolded(y), m)).sum() >= k)
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = sets.select("sid", "n", "sketch")
    rows = pairs.join(of.toDF("a", "m", "x"), "a").join(of.toDF("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
    return cut(map_arrow(rows, run, "a long, b long"))


def whole_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """(sid, grams): the whole sets of the sids in `wanted`."""

    def shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["sid", "grams"])

    need = wanted.distinct().join(sets.select("sid", "best"), "sid").select("sid", place(F.col("best.digest"), F.col("best.key")).alias("at"))
    texts = docs.select(place(digest(text), F.col(key)).alias("at"), text_or_empty(text).alias("text"))
    texts = texts.join(need, "at").dropDuplicates(["at"])
    return cut(map_arrow(texts.select("sid", "text"), shingled, "sid long, grams binary"))


def verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that are similar."""

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= at_least(similarity / (1 + similarity), len(x) + len(y)))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(grams.toDF("a", "x"), "a").join(grams.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return cut(map_arrow(rows, similar, "a long, b long").distinct())


def keep_one(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY, small: int = SMALL,
    many: int = MANY,
) -> DataFrame:
    """One row of each component of near copies: that of the smallest key, nulls last, then of the smallest text digest.

    A row is told apart by key and text together: texts that share a key, or have none, go only as near copies.
    """
    seen = cut(marked(docs, text, key, words, similarity))
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest")).alias("best")
    # texts with equal sets may repeat shingles unequally; any one of their fingerprints stands for the set
    rest = [F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp")]
    sets = cut(seen.groupBy("sid").agg(best, *rest).withColumn("label", F.col("sid")))
    drop_cut(seen)
    near = simhash_pairs(sets)
    met = cut(by_token(places(sets), lambda t, _: first_pairs(t, similarity, small), "a long, b long, token long, full boolean"))
    pairs = sifted(met.where("not full").select("a", "b").union(near).distinct(), sets, similarity)
    grams = whole_sets(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("sid")), text, key, words)
    links = verified(pairs, grams, similarity)
    for x in (near, pairs, grams):
        drop_cut(x)
    label = components(links)
    old = [sets, met, links, label]
    full = met.where("full").select("token")
    if full.limit(1).count():
        named = sets.drop("label").join(label.toDF("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        rows = cut(places(named).join(full, "token"))
        mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token")
        rows_mixed = cut(rows.join(mixed, "token").select(*rows.columns))
        drop_cut(rows)
        sketched = rows_mixed.join(sets.select("sid", "sketch"), "sid").select(*rows.columns, "sketch")
        left = cut(by_token(sketched, lambda t, g: open_links(t, g, similarity, many), "a long, b long, token long, again boolean"))
        pairs = cut(left.where("not again").select("a", "b").distinct())
        rows_again = cut(rows_mixed.join(left.where("again").select("token"), "token").select(*rows.columns))
        more = whole_sets(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("sid")).union(rows_again.select("sid")), text, key, words)
        in_place = by_token(rows_again.join(more, "sid").select(*rows.columns, "grams"), lambda t, g: cross_links(t, g, similarity), "a long, b long")
        open_ones = verified(pairs, more, similarity)
        found = cut(in_place.union(open_ones).distinct())
        for x in (rows_mixed, left, pairs, rows_again, more, open_ones):
            drop_cut(x)
        old.append(found)
        if found.limit(1).count():
            label = components(label.toDF("a", "b").union(found))
            old.append(label)
    named = sets.select("sid", "best").join(label.toDF("sid", "label"), "sid", "left").groupBy(F.coalesce("label", "sid").alias("label"))
    at = fresh("at", docs.columns)
    stay = cut(named.agg(F.min("best").alias("best")).select(place(F.col("best.digest"), F.col("best.key")).alias(at)))
    for x in old:
        drop_cut(x)
    rows = docs.withColumn(at, place(digest(text), F.col(key)))
    return rows.join(stay, at, "left_semi").dropDuplicates([at]).select(*docs.columns)
