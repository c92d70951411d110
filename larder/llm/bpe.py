"""Byte-level BPE encoding and decoding.

Each piece of a text owns a segment tree over its byte positions. A leaf holds the rank of the pair that starts at the
live token of that position (NONE where there is no such pair); an inner node holds the smaller rank below it, so that a
descent that prefers the left child finds the leftmost minimum. A merge changes two leaves and their logarithmically many
ancestors. The trees of many short pieces lie side by side in one numpy array, and all pieces take their next merge together; a
long piece has a tree of its own in a list, so that a megabyte without a break takes seconds.

Nulls and empty texts: no tokens. Repeated rows: one result each. Very long texts are encoded as a whole, their pieces (of any
length) one by one. A null key is kept. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_arrow, slices, text_or_empty

NONE = np.int64(1 << 40)
#: A worker keeps the ids of up to twice this many recent pieces. It bounds memory, not results.
CACHE_PIECES = 120_000
#: Pieces of at least this many bytes have a tree of their own.
LONG = 256


class Vocabulary:
    """Ranks of byte strings, and the pairs of ranks that join into another rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(values, np.int64)[order], NONE)
        self._joined: dict[int, int] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def joined(self) -> dict[int, int]:
        """The pairs that join and their ranks, made when first needed."""
        if not self._joined:
            self._joined = dict(zip(self.pair_keys[:-1].tolist(), self.pair_ranks[:-1].tolist(), strict=True))
        return self._joined

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined tokens; NONE where a token is missing (negative) or the pair doesn't join."""
        keys = left << 32 | np.maximum(right, 0)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), self.pair_ranks[at], NONE)


def encode_equal(pieces: list[bytes], width: int, vocab: Vocabulary) -> list[bytes]:
    """Token ids, as little-endian 32-bit bytes, of pieces of up to `width` bytes; width is a power of two."""
    n = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    size = np.fromiter(map(len, pieces), np.int64, n)
    place = np.arange(width)
    live = place < size[:, None]
    token = np.where(live, vocab.single[raw], -1)
    if (token[live] < 0).any():
        raise ValueError("the vocabulary lacks a single byte")
    after = np.where(live, place + 1, width)  # the next live position
    before = np.where(live, place - 1, -1)
    tree = np.full((n, 2 * width), NONE)
    follow = np.concatenate([token[:, 1:], np.full((n, 1), -1)], axis=1)
    tree[:, width:] = vocab.pair_rank(token, follow)
    for lo in (1 << k for k in range(width.bit_length() - 2, -1, -1)):
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        node = np.ones(len(rows), np.int64)
        while node[0] < width:
            node = 2 * node + (tree[rows, 2 * node] > tree[rows, 2 * node + 1])
        i = node - width
        j = after[rows, i]
        token[rows, i] = tree[rows, node]
        token[rows, j] = -1
        k = after[rows, j]
        after[rows, i] = k
        inner = k < width
        before[rows[inner], k[inner]] = i[inner]
        right = np.where(inner, token[rows, np.minimum(k, width - 1)], -1)
        p = before[rows, i]
        left = np.where(p >= 0, token[rows, np.maximum(p, 0)], -1)
        update(tree, rows, width + j, NONE)
        update(tree, rows, width + i, vocab.pair_rank(token[rows, i], right))
        has = p >= 0
        update(tree, rows[has], width + p[has], vocab.pair_rank(left, token[rows, i])[has])
        rows = rows[tree[rows, 1] < NONE]
    kept = token >= 0
    data = token[kept].astype("<u4").tobytes()
    ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode_long(piece: bytes, vocab: Vocabulary) -> bytes:
    """Token ids, as little-endian 32-bit bytes, of one piece, by the same tree in plain integers."""
    n, none = len(piece), int(NONE)
    width = 1 << (n - 1).bit_length()
    token = vocab.single[np.frombuffer(piece, np.uint8)]
    if (token < 0).any():
        raise ValueError("the vocabulary lacks a single byte")
    leaves = np.full(width, none)
    leaves[: n - 1] = vocab.pair_rank(token[:-1], token[1:])
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [none, *(x for level in levels[::-1] for x in level.tolist())]
    token, after, before = token.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    joined = vocab.joined()

    def put(node: int, value: int) -> None:
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            if other < value:
                value = other
            if tree[node] == value:
                return
            tree[node] = value

    while (least := tree[1]) < none:
        node = 1
        while node < width:
            node *= 2
            node += tree[node] != least  # the left child if it has the least rank
        i = node - width
        j = after[i]
        k = after[i] = after[j]
        token[i], token[j] = least, -1
        put(width + j, none)
        if k < n:
            before[k] = i
            put(width + i, joined.get(least << 32 | token[k], none))
        else:
            put(width + i, none)
        if (p := before[i]) >= 0:
            put(width + p, joined.get(token[p] << 32 | least, none))
    return np.array([t for t in token if t >= 0], "<u4").tobytes()


def update(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
    """Set one leaf of each row and renew the nodes above it."""
    if not len(rows):
        return
    tree[rows, node] = value
    while node[0] > 1:
        node = node >> 1
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Token ids of each piece, as little-endian 32-bit bytes. A piece that is a token is taken whole."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if (r := vocab.ranks.get(p)) is not None:
            out[i] = r.to_bytes(4, "little")
        elif len(p) >= LONG:
            out[i] = encode_long(p, vocab)
        else:
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
    for width, at in by_width.items():
        step = max(1, (1 << 19) // width)
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            for i, ids in zip(part, encode_equal([pieces[i] for i in part], width, vocab), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts; keeps the ids of recent pieces as little-endian 32-bit bytes."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.pattern, self.known, self.older = vocab, regex.compile(pattern), {}, {}
        self.decoded = [vocab.bytes_of.get(i, b"") for i in range(max(vocab.bytes_of) + 1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        found = [self.pattern.findall(t) for t in texts]
        wanted = set()
        for x in found:
            wanted.update(x)
        if len(self.known) + len(wanted) > CACHE_PIECES:  # what isn't wanted before the next turn goes
            self.known, self.older = {}, self.known
        new = []
        for x in wanted:
            if x not in self.known:
                if (ids := self.older.get(x)) is not None:
                    self.known[x] = ids
                else:
                    new.append(x)
        for x, ids in zip(new, encode_pieces([x.encode() for x in new], self.vocab), strict=True):
            self.known[x] = ids
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[str, Encoder] = {}


def coder_of(name: str, vocab, pattern: str) -> Encoder:
    """A worker's coder, which lives on between its tasks."""
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Encoder(vocab.value, pattern)
    return _CODERS[name]


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns key, n_tokens, ids_sha256, decoded_sha256 and, with `with_ids`, the ids themselves (array<int>). A null text
    counts as empty and gives no tokens. The vocabulary (its size is fixed by its file) is read once and sent to each
    executor once.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(ranks_path))
    name = uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = coder_of(name, vocab, pattern)
        texts = batch.column(1).to_pylist()
        n, sha, back, all_ids = [], [], [], []
        for lo, hi in slices(texts):
            for ids in coder.encode(texts[lo:hi]):
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(key), text_or_empty(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_arrow(source, run, schema)
