import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from larder.llm import suffix_dedup as sd


def plain(rows):
    """Results by comparing every string of 100 bytes in corpus order: by id, null first, then by a hash of the text."""
    seen, out = {}, {}
    tag = lambda t: np.uint64(xxhash.xxh64_intdigest(t or "", 42)).astype(np.int64)
    for key, text in sorted(set((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tag(r[1]))):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.setdefault(s, (key, i))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[key, text] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return [(k, *out[k, t or ""]) for k, t in rows]


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(rng.randint(15, 120)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else say(rng.randint(1, 60)) for _ in range(rng.randint(0, 6))]
        text = "\n".join(parts)
        if rng.random() < 0.2:
            text = text + "x" * rng.randint(90, 260)
        rows.append((i * 3, text))
    rows += [(500, rows[3][1]), (501, rows[3][1][:-1]), (7, None), (8, ""), (10, "ab" * 300), (-4, rows[5][1]), (None, rows[6][1] + "q"), rows[10]]
    rows += [(33, say(80)), (33, shared[0] + say(30)), (33, "z" + shared[0]), (None, say(50)), (None, shared[1] + say(9)), (None, shared[1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,crowd", [(1, 256), (2, 2), (3, 0)])
def test_equals_brute_force(spark, seed, crowd):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, gram string").repartition(5)
    got = sd.remove_repeats(docs, crowd=crowd).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))


def test_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a" * 150)], "doc_id long, text string")
    row = sd.remove_repeats(docs, with_kept=True).first()
    assert (row.n_removed, row.n_spans, bytes(row.kept)) == (149, 1, b"a")
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_texts_without_an_id_keep_what_is_theirs_alone(spark):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = say(200)
    rows = [(None, say(100) + shared + say(50) + shared + say(60)), (None, say(600)), (7, say(500)), (7, say(300)), (7, say(400)), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in sd.remove_repeats(docs).collect())
    first = rows[0][1]
    at = first.rfind(shared)
    want = [(len(t), 0, hashlib.sha256(t.encode()).hexdigest()) for _, t in rows[1:]]
    want.append((len(first), 200, hashlib.sha256((first[:at] + first[at + 200 :]).encode()).hexdigest()))
    assert got == sorted(want)


def test_suffix_array_is_in_lexicographic_order():
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 99, 150, np.uint8))
    pieces = [base, base[:130], bytes(rng.integers(97, 99, 140, np.uint8)), b"\0" * 120, base[20:]]
    piece, offset, new = sd.suffix_array(pieces)
    got = [pieces[p][o : o + sd.LENGTH] for p, o in zip(piece, offset)]
    want = sorted((x[o : o + sd.LENGTH], p, o) for p, x in enumerate(pieces) for o in range(len(x) - sd.LENGTH + 1))
    assert got == [w[0] for w in want] and list(zip(piece, offset)) == [w[1:] for w in want]
    assert new.tolist() == [True] + [a != b for a, b in zip(got[1:], got)]


def test_resolve_does_not_depend_on_batches():
    rng = np.random.default_rng(8)
    rows = []
    for gram in range(40):
        for _ in range(rng.integers(1, 30)):
            kind = rng.choice([sd.BEACON, sd.PHRASE, sd.PHRASE, sd.PHRASE, sd.MET]) if gram % 3 else sd.PHRASE
            whole = rng.integers(0, 1 + gram % 4) if kind != sd.BEACON else 0
            place = (0, 0, 0, 0) if kind == sd.BEACON else (rng.integers(0, 5), 0, rng.integers(0, 50), 60)
            rows.append((gram, gram, whole, *place, kind))
    table = np.array(sorted(rows, key=lambda r: (r[0], r[1], r[7], r[2], *r[3:6])), np.int64).T

    def run(size):
        cut = [table[:, i : i + size] for i in range(0, table.shape[1], size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in x], [str(i) for i in range(8)]) for x in cut]
        got = [r for b in sd.resolve(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        covered = {(r[1], i) for r in got if r[5] == sd.RANGE for i in range(r[3], r[4])}
        return covered, sorted(r for r in got if r[5] == sd.MET)

    assert run(1) == run(3) == run(17) == run(10_000) and run(5)[1] and run(5)[0]


def test_long_texts_are_parsed_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 5000, np.uint8))
    whole = sd.parse([text])
    monkeypatch.setattr(sd, "PIECE", 700)
    pieces = sd.parse([text])
    strings = lambda p: sorted(s for a, b in zip(p[3], p[4]) for s in range(a, b + 1))
    assert strings(whole) == strings(pieces) == list(range(4901))


def test_compare_holds_few_rows_of_a_frequent_string():
    a, b = b"x" * 100, b"y" * 100
    rows = [(1, d, 0, 0, 0, a if d % 2 else b) for d in range(100)] + [(2, 200, 0, 5, 5, a)]
    names = ["route", "doc", "tag", "first", "last", "piece"]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i : i + 7])], names) for i in range(0, len(rows), 7)]
    got = [r for out in sd.compare(iter(batches), 20) for r in zip(*(c.to_pylist() for c in out.columns))]
    assert sorted(set(got)) == [(d, 0, 0, 100) for d in range(2, 100)]
