import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import simhash
from larder.llm.graph import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", "   \n", "a", "A b\tc", "one Two three four five ÄÖ six one two three four", "x y \x1f z " * 30, None])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def cloud(seed, n):
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    out = []
    for _ in range(n):
        fp = centres[int(rng.integers(0, 12)) if rng.random() < 0.6 else 0]
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            fp ^= 1 << int(b)
        out.append(fp)
    return out


@pytest.mark.parametrize("bucket,small", [(4096, 48), (4096, 3), (20, 5), (2, 1)])
def test_components_equal_brute_force(spark, monkeypatch, bucket, small):
    monkeypatch.setattr(simhash.matches, "__defaults__", (bucket, small))
    fps = cloud(bucket + small, 220)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(x,) for x in set(signed)], "fp long")
    found = simhash.links(frame, bucket)
    edges = found.where("a != b").union(simhash.ball_links(found.where("a = b").select(F.col("a").alias("fp"))))
    got = {r.node: r.component for r in components(edges).collect()}
    least = {}
    for i, f in enumerate(signed):
        c = got.get(f, f)
        least[c] = min(least.get(c, i), i)
    assert [least[got.get(f, f)] for f in signed] == plain_components(fps, list(range(len(fps))))


def test_documents_with_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, base, "x"), (5, base, "x"), (5, base, "x"), (7, None, "x"), (8, "", None), (9, "solo", "x"), (None, "other words here", "x"), (3, base + " tail", "x"), (12, base * 200, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    ids = [i if i is not None else 10**9 for i, _, _ in rows]
    want = [(i, f - (1 << 64) if f >> 63 else f, c if c < 10**9 else None) for (i, _, _), f, c in zip(rows, fps, plain_components(fps, ids))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
