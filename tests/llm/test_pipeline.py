"""The pipeline against a plain version of each stage on a small fixture."""

import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from larder.llm import bpe, quality
from test_decontaminate import plain_score
from test_line_dedup import plain as plain_lines
from test_simhash import plain_components, plain_fingerprint


def fixture(folder, spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(25)) for i in range(4)]
    shared = [say(12) for _ in range(3)]
    docs = []
    for i in range(500):
        lines = [say(rng.randint(30, 50)) for _ in range(3)]
        if rng.random() < 0.3:
            lines.insert(1, rng.choice(shared))
        if i % 10 == 3:
            lines = ["SPAM$$ BUY!! " * 20, *lines]
        if i % 10 == 4:
            lines[0] += " idiot"
        if i % 10 == 5:
            lines[2] += " " + items[i % 4][1]
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
    docs += [(900, docs[0][1], "en", "s0", 0), (901, docs[1][1] + " end", "en", "s0", 0), (902, None, None, None, None), docs[2]]
    labels = [(d[0], int(d[0] % 10 != 3), int(d[0] % 10 == 4)) for d in docs[:480]]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return items


def test_stages_equal_plain_versions(spark, tmp_path):
    items = fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    kept = cp.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    keep = {r.doc_id for r in quality.scored(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("keep").collect()}
    assert {k for k, _ in rows if k % 10 not in (3, 4)} - keep == set() and not {3, 13, 4, 14} & keep
    rows = [r for r in rows if r[0] in keep]

    kept = cp.STAGES[1][1](spark, kept, str(tmp_path))
    gone = plain_lines(rows, 4)
    rows = [(k, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[k])) for k, t in rows]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted(rows)

    kept = cp.STAGES[2][1](spark, kept, str(tmp_path))
    least = plain_components([plain_fingerprint(t) for _, t in rows], [k for k, _ in rows])
    rows = sorted({r for r, c in zip(rows, least) if r[0] == c})
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == rows

    kept = cp.STAGES[3][1](spark, kept, str(tmp_path))
    rows = [r for r in rows if all(plain_score(x, r[1]) < 0.5 for _, x in items)]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == rows and len(rows) > 150

    path = public_tokenizers.path(cp.VOCABULARY)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.load(path).ranks, special_tokens={})
    want = sorted((k, coder.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in rows)
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in cp.run(spark, str(tmp_path)).collect()) == want


def test_unrelated_documents_without_an_id_of_their_own_stay(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts = [say(40) for _ in range(5)]
    rows = [(None, texts[0], 1), (None, texts[1], 2), (None, texts[2], 3), (5, texts[3], 4), (5, texts[4], 5), (5, texts[4], 5), (6, texts[4] + " end", 6)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, n, n, n) for k, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, keep int, n_lines int, kept_key int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:4]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep", "n_lines", "kept_key"], name
    assert sorted((r.text, r.keep) for r in docs.collect() if r.text) == sorted((t, n) for t, n in zip(texts, (1, 2, 3, 4, 5)))
