import random

import numpy as np
import pytest

from larder.llm import quality as q

BAD = ["spam$$", "BUY!!", "win***", "CLICK##"]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        if not good:
            text = [t if rng.random() < 0.5 else rng.choice(BAD) for t in text]
        if toxic:
            text.insert(5, rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(text), "en", "src1" if good or rng.random() < 0.5 else "src2", len(" ".join(text))))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 900)
    extra = [(5000, None, None, None, None), (5001, "", "en", "src1", 0), (None, "word1", "en", "src1", 5), rows[0]]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows + extra], SCHEMA + ", keep string, c0 string")
    known = spark.createDataFrame([*labels[:500], (3, None, None), labels[4], (None, 1, 0), (99999, 1, 0)], LABELS)
    got = {r.doc_id: r for r in q.scored(docs, known).collect()}
    assert docs.count() == len(rows) + 4 and len(got) == len(rows) + 3 and got[7].c0 == "y"
    held = labels[500:]
    assert np.mean([(got[i].p_quality >= 0.5) == bool(y) for i, y, _ in held]) > 0.95
    assert np.mean([(got[i].p_toxic >= 0.5) == bool(t) for i, _, t in held]) > 0.95
    assert np.mean([got[i].keep == (bool(y) and not t) for i, y, t in held]) > 0.93
    assert all(r.keep is not None for r in got.values())


@pytest.mark.parametrize("labels,p", [([], None), ([(1, 1, 0), (2, 1, 0)], 1.0)])
def test_labels_that_allow_no_fit(spark, labels, p):
    docs = spark.createDataFrame(corpus(2, 5)[0], SCHEMA)
    got = q.scored(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert {r.p_quality for r in got} == {p} and all(r.keep for r in got)
    assert q.scored(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_each_view_learns_from_the_other(spark):
    """Sources of unlabelled documents come with labels only by the text view, words of others only by the metadata."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1600):
        y, known = rng.random() < 0.5, i < 400
        early = i % 2 or known  # words that labelled documents have too
        text = [rng.choice([f"neutral{k}" for k in range(200)]) for _ in range(30)]
        text += [f"{('good', 'bad', 'nice', 'evil')[(not y) + 2 * (not early)]}{rng.randrange(8)}" for _ in range(4)]
        right = y if rng.random() < 0.97 else not y
        source = f"{'fine' if right else 'poor'}{rng.randrange(3)}{'' if known or not early else 'new'}"
        rows.append((i, " ".join(text), "en", source, 100))
        labels.append((i, int(y), 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame(labels[:400], LABELS)
    truth = np.array([y for _, y, _ in labels[400:]])
    unseen = np.array([i % 2 == 1 for i in range(400, 1600)])
    sides = q.features(*map(list, list(zip(*rows[400:]))[1:]))
    right = {}
    for rounds in (0, 2):
        model = q.trained(docs, known, rounds=rounds)["quality"]
        right[rounds] = [(v.probability(v.logits(r)) >= 0.5) == truth for v, r in zip(model.views, sides)]
        assert (model.combine[:-1] >= 0).all() and all((v.blend[:-1] >= 0).all() for v in model.views)
    assert len(model.told) == 2 and all(n > 50 for r in model.told for view in r for n in view)
    # late words for the text view, new sources for the metadata view
    assert right[0][0][~unseen].mean() < 0.8 and right[2][0][~unseen].mean() > 0.9
    assert right[0][1][unseen].mean() < 0.8 and right[2][1][unseen].mean() > 0.85


def test_rows_that_repeat_a_labelled_id_do_not_reach_the_driver(spark, monkeypatch):
    rows, labels = corpus(4, 60)
    docs = spark.createDataFrame(rows + [rows[0]] * 3000, SCHEMA)
    sizes, plain = [], q.unpacked
    monkeypatch.setattr(q, "unpacked", lambda words, meta: sizes.append(len(words)) or plain(words, meta))
    q.trained(docs, spark.createDataFrame(labels, LABELS), n_labelled=40)
    q.trained(docs, spark.createDataFrame(labels, LABELS), n_labelled=100)
    assert sizes == [40, 60]


def plain_tokens(text):
    """Word, beginning and shape of each token."""
    out = []
    for t in text.split():
        word = t.strip(".,;:!?\"'()[]").lower()
        shape = ""
        for c in t:
            k = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
            if not shape or shape[-1] != k or k not in "Aa9":
                shape += k
        out.append((word, word[:4] + "-" if len(word) > 4 else word, shape[:8]))
    return out


def test_tokens_are_told_apart_as_by_a_plain_version():
    rng = random.Random(12)
    signs = "aAbB09.,!$ \n\t-"
    text = "".join(rng.choice(signs) for _ in range(3000)) + " ... longword longest LONGER! x1x1x1x1x1x1"
    found = [x.tolist() for x in q.tokens(np.frombuffer(text.encode(), np.uint8))[1:]]
    for got, want in zip(found, zip(*plain_tokens(text))):
        assert len(got) == len(want) and len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_features_do_not_depend_on_batches():
    rows, _ = corpus(8, 40)
    rows += [(90, "", None, None, None), (91, " \n ", "en", "s", 3), (92, "ünïcode É\x00 x" * 50, "de", None, -5)]
    columns = list(map(list, list(zip(*rows))[1:]))
    for whole, parts in zip(q.features(*columns), zip(*(q.features(*([c[i]] for c in columns)) for i in range(len(rows))))):
        for at, one in zip(whole.each(), parts):
            assert whole.place[at].tolist() == one.place.tolist() and np.allclose(whole.value[at], one.value)


def test_confidence_is_measured():
    p = np.linspace(0, 1, 101)
    low, high = q.confident(p, (p > 0.5).astype(float))
    assert high == 0.5 or abs(high - 0.49) < 0.05
    assert q.confident(p, np.tile([0.0, 1.0], 51)[:101]) == (-1.0, 2.0)
    weights = q.calibrate(np.column_stack([p - 0.5, 0.5 - p]) * 8, (p > 0.4).astype(float))
    assert weights[0] > 0 and weights[1] == 0
