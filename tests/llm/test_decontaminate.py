import random

import numpy as np
import pytest

from larder.llm import decontaminate as dc


def plain_score(item, text):
    a, b = dc.words(item), dc.words(text)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best / (dc.MATCH * len(a)) if a else 0


def edited(rng, text, share):
    out = []
    for w in text.split():
        x = rng.random()
        if x < share / 3:
            continue
        out.append("changed" if x < 2 * share / 3 else w)
        if share > x > 2 * share / 3:
            out.append("more")
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(15, 45))) for i in range(12)] + [(90, "two words"), (91, None), (92, "")]
    docs = []
    for i in range(80):
        x = rng.randrange(12)
        middle = {0: items[x][1], 1: edited(rng, items[x][1], 0.25).upper().replace(" ", ",  "), 2: ""}[i % 3]
        docs.append((i, f"{say(rng.randint(0, 60))}. {middle}; {say(rng.randint(0, 60))}"))
    docs += [(200, None), (201, ""), (None, items[3][1]), docs[0], (202, (say(30) + " " + items[2][1] + " ") * 40)]
    return docs, items


@pytest.mark.parametrize("block", [5, 100])
def test_equals_alignment_of_all_pairs(spark, corpus, block):
    docs, items = corpus
    d = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, score double").repartition(3)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = sorted((str(r.doc_id), r.item_id, round(r.score, 6)) for r in dc.contaminated(d, b, block_items=block).collect())
    want = sorted((str(k), i, round(s, 6)) for k, t in docs for i, x in items if len(dc.words(x or "")) >= 3 and (s := plain_score(x, t or "")) >= 0.5)
    assert got == want and len(got) > 50
    kept = {r.doc_id for r in dc.clean(d, b).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in docs if str(k) in {g[0] for g in got}}


def test_no_alignment_is_lost():
    """Heavy edits: insertions of up to the item's length, in one place or spread, and 10 to 60 % of words changed."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(150)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    n_found = 0
    for trial in range(400):
        items = [say(rng.randint(3, 40)) for _ in range(4)]
        x = rng.choice(items)
        kind = trial % 5
        if kind == 0:
            middle = edited(rng, x, rng.uniform(0.1, 0.6))
        elif kind == 1:
            w = x.split()
            at = rng.randint(1, len(w) - 1)
            middle = " ".join([*w[:at], say(rng.randint(1, len(w))), *w[at:]])
        elif kind == 2:
            middle = " ".join(w + (" new" if i % 2 else "") for i, w in enumerate(x.split()))
        elif kind == 3:
            middle = " ".join("other" if i % 3 == trial % 3 else w for i, w in enumerate(x.split()))
        else:
            middle = " ".join(w + " in" for w in x.split())
        text = f"{say(rng.randint(0, 50))} {middle} {say(rng.randint(0, 50))}"
        want = {i: s for i, y in enumerate(items) if (s := plain_score(y, text)) >= 0.5}
        got = {i: s for i, s, _, _ in dc.found_in(dc.Items(items, 0.5), text)}
        assert got == want, (kind, x, text)
        n_found += len(want)
    assert n_found > 250


def test_an_item_that_most_documents_hold_keeps_seeds(spark):
    item = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(i, f"a{i} {item} b{i}") for i in range(50)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert dc.contaminated(d, b).count() == 50
    assert dc.contaminated(d.limit(0), b).count() == 0
    assert dc.contaminated(d, b.limit(0)).count() == 0


def test_truncated_copies_of_a_frequent_item(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, f"a{i} {' '.join(words)} b{i}") for i in range(300)] + [(1000 + i, f"c{i} {' '.join(words[18:])} d{i}") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.score for r in dc.contaminated(d, b).collect()}
    assert got == {k: 0.55 if k >= 1000 else 1.0 for k, _ in rows}
    assert dc.clean(d, b).count() == 0


def test_align_pairs_of_unequal_sizes():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 5, n) for n in (1, 7, 30)]
    b = [rng.integers(0, 5, n) for n in (12, 1, 50)]
    got = dc.align(a, b)[0].tolist()
    say = lambda x: " ".join(f"w{v}" for v in x)
    assert got == [round(plain_score(say(x), say(y)) * 2 * len(x)) for x, y in zip(a, b)]


def test_rows_that_share_an_id_are_judged_each(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, f"a {item}"), (None, "clean one"), (None, None), (7, item), (7, "clean two"), (7, "clean three")]
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = dc.clean(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(r) for r in rows if item not in (r[1] or ""))
