import random

import numpy as np
import pytest

from larder.llm import line_dedup as ld


def plain(rows, least):
    """Removed line numbers of each document, by trying every run of lines."""
    texts = dict(sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)))
    seen, gone = {}, {k: set() for k in texts}
    for key, text in texts.items():
        lines = text.split("\n")
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                lead = seen.setdefault(run, (key, i))
                if lead != (key, i) and sum(len(x.split()) for x in run) >= least:
                    gone[key].update(range(i, j))
    return gone


@pytest.mark.parametrize("seed,least", [(1, 4), (2, 7), (3, 1)])
def test_equals_brute_force(spark, seed, least):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 1, 2, 5]))) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"unique {rng.random()} of mine" for _ in range(rng.randint(1, 9))]
        rows.append((i * 2, "\n".join(lines)))
    rows += [(101, rows[4][1]), (1, None), (3, ""), (None, rows[7][1]), rows[9], (200, "\n".join(pool * 3))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, rank int, doc int, n_lines int").repartition(3)
    gone = plain(rows, least)
    got = ld.deduplicated(docs, min_words=least).collect()
    assert len(got) == len(rows)
    for r in got:
        lines = (dict(rows)[r.doc_id] or "").split("\n")
        assert r.n_lines_removed == len(gone[r.doc_id]), (r, gone[r.doc_id])
        assert (r.text or "") == "\n".join(x for i, x in enumerate(lines) if i not in gone[r.doc_id])
        assert (r.rank, r["doc"], r.n_lines) == (1, 2, len(lines))
        assert r.n_runs_removed == sum(i - 1 not in gone[r.doc_id] for i in gone[r.doc_id])


def test_texts_that_share_an_id_keep_their_own_lines(spark):
    rows = [(1, "a b c d"), (5, "a b c d\nq r s t"), (5, "e f g h\nu v w x"), (None, "i j k l\nm n o p"), (None, "y z y z"), (None, "m n o p\n1 2 3 4")]
    got = sorted((r.text, r.n_lines_removed) for r in ld.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert ("e f g h\nu v w x", 0) in got and ("q r s t", 1) in got and ("y z y z", 0) in got
    assert sum(n for _, n in got) == 2 and sum("m n o p" in t for t, _ in got) == 1


def test_ranks_are_in_suffix_order(spark):
    lines = ["a b", "c d", "a b", "c d", "e f", "a b", "c d", "e f", "x"]
    rows = spark.createDataFrame([((0, 0), i, ord(x[0]), 0) for i, x in enumerate(lines)], "doc struct<key: long, hash: long>, line long, id long, id2 long")
    ranks = {r.line: r.rank for r in ld.shared(rows, ["id", "id2"], []).collect()}
    order = sorted(ranks, key=lambda i: lines[i])
    assert sorted(ranks) == list(range(8)) and [ranks[i] for i in order] == sorted(ranks.values())
    assert all((ranks[i] == ranks[j]) == (lines[i] == lines[j]) for i in ranks for j in ranks)


def test_windows():
    a, b = ld.windows(np.array([0, 3, 0, 1, 5]), 4)
    assert a.tolist() == [4, 3, 3, 2, 1]
    assert b.tolist() == [0, 0, 0, 3, 1]


def test_empty_table(spark):
    assert ld.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
