import random

import pytest

import corpus_pipeline as cp
from larder.llm import near_copies


def plain_kept(rows, words=5, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return {min((rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}, len({find(i) for i in range(len(rows))})


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small", [32, 3])
def test_all_pairs_at_the_similarity_are_linked(spark, small):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, base = say(30), [say(rng.randint(60, 200)) for _ in range(12)]
    texts = [near(rng, b, e) for b in base for e in (0, 1, 2, 2, 3, 4, 5)]
    texts += [near(rng, base[0], rng.randint(1, 3)) for _ in range(40)]  # more than `small` sets share shingles
    texts += [say(20) + " " + passage + " " + say(20) for _ in range(40)] + ["a b", "A  b", "a c", "", None, base[1]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_copies.keep_one(docs, small=small).collect()
    want, n = plain_kept(rows)
    assert {(False, r.doc_id) for r in got} == want and len(got) == n < len(rows) - 40


def test_the_stage_drops_copies_that_fingerprints_miss(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(100)) for _ in range(20)]
    rows = list(enumerate(base + [near(rng, b, 2) for b in base]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(k for _, k in plain_kept(rows)[0]) and len(kept) < 25


def test_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    say = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    a, b = say(), say()
    rows = [(None, say()), (None, say()), (None, a), (3, say()), (3, say()), (3, b), (1, near(rng, a, 1)), (9, b), (3, "twice"), (3, "twice"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str(tuple(r)) for r in cp.drop_near_duplicates(spark, docs, "").collect())
    gone = [(None, a), (9, b), (3, "twice"), (None, None)]
    want = list(rows)
    for r in gone:
        want.remove(r)
    assert got == sorted(map(str, want))


def test_empty_table(spark):
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def passages(rng):
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = say(30)
    texts = [say(60) + " " + passage + " " + say(60) for _ in range(60)]
    return texts + [near(rng, t, 1) for t in texts[:5]]


def test_whole_sets_are_read_of_likely_pairs_only(spark, monkeypatch):
    rows = list(enumerate(passages(random.Random(3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked, real = [], near_copies.whole_sets

    def counted(docs, sets, wanted, *rest):
        asked.append(wanted.distinct().count())
        return real(docs, sets, wanted, *rest)

    monkeypatch.setattr(near_copies, "whole_sets", counted)
    assert {(False, r.doc_id) for r in near_copies.keep_one(docs, small=3).collect()} == plain_kept(rows)[0]
    assert 10 <= sum(asked) <= 20


def test_groups_with_many_open_pairs_are_compared_in_place(spark):
    rows = list(enumerate(passages(random.Random(4))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(False, r.doc_id) for r in near_copies.keep_one(docs, small=1, many=-1).collect()} == plain_kept(rows)[0]


def test_fingerprints_within_reach_make_pairs(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(base + [near(rng, b, 1) for b in base])), "doc_id long, text string")
    sets = near_copies.marked(docs, "text", "doc_id", 5, 0.8)
    fp = {r.sid: r.fp for r in sets.collect()}
    want = {tuple(sorted((a, b))) for a in fp for b in fp if a != b and ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() <= 4}
    assert {(r.a, r.b) for r in near_copies.simhash_pairs(sets).collect()} == want and len(want) > 10


def test_sketches_bound_what_sets_share():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m, shared in ((300, 240, 200), (5, 40, 3), (1000, 1, 1), (64, 64, 64)):
        pool = rng.integers(0, 1 << 63, n + m - shared).astype(np.uint64)
        x, y = (near_copies.unfolded(near_copies.sketch(np.unique(s)).tobytes()) for s in (pool[:n], pool[n - shared :]))
        k = min(len(x), len(y))
        assert np.minimum(near_copies.folded(x, k), near_copies.folded(y, k)).sum() >= shared
    same = near_copies.unfolded(near_copies.sketch(np.arange(1000, dtype=np.uint64) << np.uint64(32)).tobytes())
    assert same.max() >= 1000
