import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
VOCAB = bpe.Vocabulary.load(PATH)
CODER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=VOCAB.ranks, special_tokens={})
TEXTS = ["", " ", "a" * 3000, " " * 2000 + "x", "日本語テキスト😀🎉\n\n\n\t x", "<|endoftext|>", "!?" * 400, "x  y\r\n\r\n z", "\x85a\x1cb\x00", "l'été d'hiver 12345678901234567890", "Straßenüberführung " * 50]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_equals_the_library():
    coder = bpe.Encoder(VOCAB, P.PATTERN)
    for t, data in zip(TEXTS, coder.encode(TEXTS), strict=True):
        assert ids_of(data) == CODER.encode_ordinary(t) and coder.decode(data) == t.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    coder = bpe.Encoder(VOCAB, P.PATTERN)
    assert ids_of(coder.encode([t])[0]) == CODER.encode_ordinary(t)


def test_long_pieces():
    rng = random.Random(7)
    for n in (256, 257, 1000, 4097):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "é😀x"):
            t = "".join(rng.choice(letters) for _ in range(n))
            assert ids_of(bpe.encode_long(t.encode(), VOCAB)) == CODER._encode_single_piece(t)
            small = t[:100].encode()
            assert bpe.encode_long(small, VOCAB) == bpe.encode_equal([small], 1 << (len(small) - 1).bit_length(), VOCAB)[0]
    began = time.time()
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    data = bpe.Encoder(VOCAB, P.PATTERN).encode([t])[0]
    assert bpe.Encoder(VOCAB, P.PATTERN).decode(data) == t.encode() and time.time() - began < 60


def test_leftmost_minimum_on_ties():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 300}
    vocab = bpe.Vocabulary(ranks)
    assert [ids_of(x) for x in bpe.encode_pieces([b"aaaaa", b"aa", b"baaab"], vocab)] == [[256, 300], [256], [98, 300, 98]]
    with pytest.raises(ValueError, match="single byte"):
        bpe.encode_pieces([b"xyz"], bpe.Vocabulary({b"x": 0, b"y": 1}))


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    rng = random.Random(2)
    coder = bpe.Encoder(VOCAB, P.PATTERN)
    for _ in range(30):
        texts = [" ".join(rng.choice(["Haus", "maison", "casa", f"w{rng.random()}"]) for _ in range(10)) for _ in range(3)]
        assert [ids_of(x) for x in coder.encode(texts)] == [CODER.encode_ordinary(t) for t in texts]
        assert len(coder.known) + len(coder.older) < 200


def test_frames(spark):
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, None, "a b c " * 100_000])] + [(0, "", 1), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = bpe.tokenize(docs, PATH, P.PATTERN).collect()
    want = []
    for k, t, _ in rows:
        ids = CODER.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.tokenize(docs.limit(0), PATH, P.PATTERN, with_ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
