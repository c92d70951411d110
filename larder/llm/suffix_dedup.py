"""Exact removal of repeated byte strings by prefix-free parsing.

Every string of LENGTH bytes is assigned to the trigger inside it: the leftmost smallest rolling hash among its GRAM-byte
windows, which depends on the string alone. The strings that share a trigger form a phrase, a stretch of text from its first
string's start to its last string's end, so phrases overlap by LENGTH - 1 bytes and no phrase is a proper prefix of the
continuation of another. The distinct phrases are the dictionary, their sequence over all texts is the parse.

1. The parse is sorted by phrase, then corpus order (document, place). Strings end inside their phrase, so the order of parse
   suffixes is needed for their first phrase only. All occurrences of a phrase but the first are covered as wholes.
2. The dictionary's suffixes are sorted lexicographically by their first LENGTH bytes (its suffix array, cut off at that
   depth). A neighbour with a common prefix of LENGTH bytes belongs to the same interval; the intervals of the two arrays
   combine into corpus order: of a string's occurrences in all phrases, each at its first place in the parse, the first stays.

Equal strings have equal triggers at equal offsets, so the suffix array is made in parts, one for each trigger gram, and only for
grams that begin several phrases: a phrase alone with its gram shares no string with any other. A gram that begins more than
`crowd` phrases (near copies of one text) has its part dealt out once more, by the strings themselves.

Phrases are taken for equal by 128 bits of hashes, strings in step 2 by their bytes.

Defined results: a null text is empty. A document is a doc_id and a text: rows equal in both are one document, and each row gets
its result; texts that share a doc_id, or have none, are documents of their own. Documents are ordered by doc_id, null
first, then by a hash of the text. Texts below LENGTH bytes lose nothing; a very long text is parsed in pieces. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, drop_cut, in_arrow, map_arrow, slices, spread, text_or_empty

LENGTH = 100
GRAM = 40
#: Longer texts are parsed in pieces of this many string starts.
PIECE = 1_000_000
#: A trigger gram that begins more phrases than this has its strings dealt out one by one.
CROWD = 256
#: Phrases whose suffixes are sorted at once, and rows of one frequent string that are held.
CHUNK = 5_000
NULL_ID = -(1 << 63)
PLACE_BITS = np.uint64(32)
ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLES = np.random.default_rng(20240607).integers(0, 1 << 64, (2, 256), np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2^64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        n = max(n, PIECE + 4 * LENGTH)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        for name, base in (("up", ODD), ("down", inverse)):
            _POWERS[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefix_sums(raw: np.ndarray, table: int) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLES[table][raw] * up[: len(raw)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mixed((sums[stop] - sums[start]) * _POWERS["down"][start] + (stop - start).astype(np.uint64))


def phrases(raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of concatenated texts that end at the places `stop`: gram hash, phrase hash, first and last string's start."""
    n = len(raw)
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    sums = prefix_sums(raw, 0)
    at = np.arange(n - GRAM + 1)
    gram = range_hash(sums, at, at + GRAM)
    # one number for hash and place, with a fixed share of each, so that a string's trigger is the same in any batch
    least = (gram >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    span, width = 1, LENGTH - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    trigger = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)  # of each string's start
    start = np.arange(len(trigger))
    owner = np.searchsorted(stop, start, "right")
    inside = start + LENGTH <= stop[owner]
    start, trigger, owner = start[inside], trigger[inside], owner[inside]
    if not len(start):
        return gram[:0], gram[:0], start, start
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])]))
    first, last = start[new], start[np.append(new[1:] - 1, len(start) - 1)]
    whole = range_hash(prefix_sums(raw, 1), first, last + LENGTH)
    return gram[trigger[new]], whole, first, last


def parse(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Phrases of whole texts: gram hash, phrase hash, text number, first, last; places are bytes from the text's start."""
    found: list[tuple[np.ndarray, ...]] = []

    def take(at: int, parts: list[bytes], base: int) -> None:
        stop = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        gram, whole, first, last = phrases(np.frombuffer(b"".join(parts), np.uint8), stop)
        owner = np.searchsorted(stop, first, "right")
        shift = base - np.concatenate([[0], stop[:-1]])[owner]
        found.append((gram, whole, at + owner, first + shift, last + shift))

    for lo, hi in slices(texts, PIECE // 2):
        if len(texts[lo]) > PIECE:
            for base in range(0, len(texts[lo]), PIECE):
                take(lo, [texts[lo][base : base + PIECE + LENGTH - 1]], base)
        else:
            take(lo, texts[lo:hi], 0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


RANGE, BEACON, PHRASE, MET = 0, 1, 2, 3  # kinds of rows
PARSED = "route long, gram long, whole long, doc long, tag long, first long, last long, kind int"


def rows_of(*columns: np.ndarray | int, names: str) -> pa.RecordBatch:
    n = max(len(c) for c in columns if isinstance(c, np.ndarray))
    arrays = []
    for c in columns:
        c = np.full(n, c) if not isinstance(c, np.ndarray) else c
        arrays.append(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c))
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in names.split(", ")])


def in_order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys differs from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def leads(new: np.ndarray) -> np.ndarray:
    """For each row the last row, up to itself, that is new."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def moved(lead: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether a row is another place than its lead."""
    return np.logical_or.reduce([x != x[lead] for x in place])


def merged(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of ranges within each document."""
    if not len(doc):
        return doc, tag, start, stop
    order = in_order(doc, tag, start)
    doc, tag, start, stop = doc[order], tag[order], start[order], stop[order]
    new_doc = starts(doc, tag)
    group = np.cumsum(new_doc) - 1
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * wide) - group * wide  # the furthest stop so far in the document
    new = new_doc.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], tag[at], start[at], reach[np.append(at[1:] - 1, len(doc) - 1)]


def parse_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The phrases of a batch of texts. Those met before in the batch become ranges at once; a gram that begins several
    phrases here sends its phrases on as met, with a beacon for the other batches."""
    texts = [t.encode() for t in batch.column(2).to_pylist()]
    gram, whole, text, first, last = parse(texts)
    doc, tag = (batch.column(i).to_numpy()[text] for i in (0, 1))
    order = in_order(gram, whole, doc, tag, first)
    gram, whole, doc, tag, first, last = (x[order] for x in (gram, whole, doc, tag, first, last))
    new_gram, new = starts(gram), starts(gram, whole)
    group = np.cumsum(new_gram) - 1
    several = (np.bincount(group, new) > 1)[group] if len(gram) else new
    again = moved(leads(new), doc, tag, first)
    r = merged(doc[again], tag[again], first[again], last[again] + LENGTH)
    alone, met, beacon = new & ~several, new & several, new_gram & several
    parts = [
        (r[0] * 31 + r[2], 0, 0, *r, RANGE),
        (gram[beacon], gram[beacon], 0, 0, 0, 0, 0, BEACON),
        (gram[alone], gram[alone], whole[alone], doc[alone], tag[alone], first[alone], last[alone], PHRASE),
        (gram[met] + whole[met], gram[met], whole[met], doc[met], tag[met], first[met], last[met], MET),
    ]
    made = [rows_of(*(c.view(np.int64) if isinstance(c, np.ndarray) else c for c in p[:-1]), np.full(len(p[0]), p[-1], np.int32), names=PARSED) for p in parts]
    return pa.Table.from_batches(made).combine_chunks().to_batches()[0]


RESOLVED = "gram long, doc long, tag long, first long, last long, kind int"


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by route, gram, kind, phrase and corpus order: ranges (kind RANGE, `last` being the stop) and the
    first places of phrases to compare (MET).

    A gram may go on over many batches, however frequent its phrases are: what goes over to the next batch is its beacon, the
    first place of its first phrase and that of its last one, each with a mark whether it has been dealt with.
    """
    held = np.zeros((9, 0), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy().astype(np.int64) for c in batch.columns]
        x = np.concatenate([held, np.stack([*rows, np.zeros(batch.num_rows, np.int64)])], axis=1)
        route, gram, whole, doc, tag, first, last, kind, done = x
        group = np.cumsum(starts(route, gram)) - 1
        new = starts(route, gram, kind, whole)
        several = np.bincount(group, (new & (kind == PHRASE)) + 2 * (kind == BEACON)) > 1
        again = (kind >= PHRASE) & moved(leads(new), doc, tag, first)
        send = new & (done == 0) & ((kind == MET) | ((kind == PHRASE) & several[group]))
        ready = kind == RANGE
        r = merged(*(np.concatenate([c[ready], c[again]]) for c in (doc, tag, first)), np.concatenate([last[ready], last[again] + LENGTH]))
        n, m = len(r[0]), int(send.sum())
        columns = [np.concatenate([np.zeros(n, np.int64), gram[send]]), *(np.concatenate([c, d[send]]) for c, d in zip(r, (doc, tag, first, last), strict=True))]
        columns.append(np.repeat(np.array([RANGE, MET], np.int32), [n, m]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "doc", "tag", "first", "last", "kind"])
        keep = np.flatnonzero(new & (group == group[-1]) & (kind != RANGE))
        phrase = keep[kind[keep] == PHRASE]
        held = x[:, np.unique(np.concatenate([keep[kind[keep] == BEACON][:1], phrase[:1], keep[-1:]]))]
        held[8] = (held[7] != PHRASE) | several[-1]


PIECES = "route long, doc long, tag long, first long, last long, piece binary"


def cut_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The bytes of the phrases to compare: whole phrases by gram, or string by string for crowded grams.

    Of a crowded gram's strings that come several times in the batch only the first goes on; the others are ranges (piece null).
    """
    unpack = zstandard.ZstdDecompressor().decompress
    rows: list[tuple] = []
    seen: dict[bytes, tuple[int, int, int]] = {}
    for doc, tag, packed, met in sorted(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True), key=lambda r: r[:2]):
        text = unpack(packed)
        for m in sorted(met, key=lambda m: m["first"]):
            if not m["crowded"]:
                rows.append((m["gram"], doc, tag, m["first"], m["last"], text[m["first"] : m["last"] + LENGTH]))
                continue
            for s in range(m["first"], m["last"] + 1):
                string = text[s : s + LENGTH]
                before = seen.setdefault(string, (doc, tag, s))
                if before == (doc, tag, s):
                    route = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                    rows.append((route, doc, tag, s, s, string))
                else:
                    rows.append((doc, doc, tag, s, s + LENGTH, None))
    types = [pa.int64()] * 5 + [pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["route", "doc", "tag", "first", "last", "piece"])


def suffix_array(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of at least LENGTH bytes in lexicographic order of their first LENGTH bytes: piece, offset, and whether
    the common prefix with the suffix before is shorter than LENGTH. Equal ones stay in the order of the pieces."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    count = size - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + offset
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[at])
    words = strings[:, :8].copy().view(">u8").ravel().astype(np.uint64)
    order = np.argsort(words, kind="stable")
    # runs with equal first bytes are few, and are put in order by the rest
    new = starts(words[order])
    tied = ~new
    tied[:-1] |= ~new[1:]
    among = order[tied]
    rest = strings[among].view(f"S{LENGTH}").ravel()
    order[tied] = among[np.lexsort((among, rest))] if len(among) else among
    new[1:] = (strings[order[1:]] != strings[order[:-1]]).any(axis=1)
    return piece[order], offset[order], new


def suffix_repeats(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tag, start) of the strings in pieces that also start earlier; pieces of equal strings are in corpus order."""
    piece, offset, new = suffix_array(pieces)
    place = doc[piece], tag[piece], first[piece] + offset
    again = moved(leads(new), *place)
    return tuple(x[again] for x in place)


def compare(batches: Iterator[pa.RecordBatch], most: int = 2 * CHUNK) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by route, document and place: the ranges of strings that start earlier too.

    Single strings (of crowded grams) that fill over `most` rows of one route are compared at once, and only the first of
    each goes on, so memory is bounded however often a string comes.
    """

    def out(table: pa.Table) -> pa.RecordBatch:
        route, doc, tag, first, last = (table.column(i).to_numpy() for i in range(5))
        ready = table.column(5).is_null().to_numpy()
        found = [merged(doc[ready], tag[ready], first[ready], last[ready])]
        route, doc, tag, first = route[~ready], doc[~ready], tag[~ready], first[~ready]
        pieces = table.column(5).drop_null().to_pylist()
        bounds = np.append(np.flatnonzero(starts(route)), len(route)) if len(route) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(bounds) - 1:  # some routes at a time; strings of different routes are never equal
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK, "right")) - 1)
            part = slice(bounds[lo], bounds[hi])
            d, t, s = suffix_repeats(doc[part], tag[part], first[part], pieces[part])
            found.append(merged(d, t, s, s + LENGTH))
            lo = hi
        columns = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "tag", "first", "last"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        route = batch.column(0).to_numpy()
        start = int(np.flatnonzero(route == route[-1])[0])
        if held and held[-1].column(0)[-1].as_py() == route[-1]:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows > most and set(map(len, table.column(5).drop_null().to_pylist())) == {LENGTH}:
                yield out(table)
                table = table.filter(pc.is_valid(table.column(5)))
                strings = table.column(5).to_pylist()
                held = table.take(sorted({x: i for i, x in reversed(list(enumerate(strings)))}.values())).to_batches()
            continue
        ready = pa.Table.from_batches([*held, batch.slice(0, start)])
        if ready.num_rows:
            yield out(ready)
        held = [batch.slice(start)]
    if held:
        yield out(pa.Table.from_batches(held))


def union_ranges(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The result rows from (doc, text compressed, its ranges)."""
    unpack = zstandard.ZstdDecompressor().decompress
    n, removed, spans, sha, kept_texts = [], [], [], [], []
    for packed, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        text = unpack(packed)
        joined: list[list[int]] = []
        for a, b in sorted((r["first"], r["last"]) for r in ranges or ()):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        kept, at = [], 0
        for a, b in joined:
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        left = b"".join(kept)
        n.append(len(text))
        removed.append(len(text) - len(left))
        spans.append(len(joined))
        sha.append(hashlib.sha256(left).hexdigest())
        kept_texts.append(left)
    longs = [pa.array(x, pa.int64()) for x in (n, removed, spans)]
    return pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(sha, pa.string()), pa.array(kept_texts, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", with_kept: bool = False, crowd: int = CROWD) -> DataFrame:
    """Remove each byte of the texts that a string of LENGTH bytes covers which also starts earlier.

    Returns key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with `with_kept`, the remaining bytes.
    """
    document = F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text_or_empty(text)).alias("tag")
    source = docs.select(*document, text_or_empty(text).alias("text"))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["doc", "tag", "packed"])

    parsed = map_arrow(source, parse_batch, PARSED)
    order = ["route", "gram", "kind", "whole", "doc", "tag", "first"]
    resolved = cut(in_arrow(spread(parsed, "route").sortWithinPartitions(*order), resolve, RESOLVED))
    met = resolved.where(F.col("kind") == MET)
    # written, so that Spark knows how few they are, and can split the shuffle of what they are joined with
    crowds = cut(met.groupBy("gram").count().where(F.col("count") > crowd).select("gram", F.lit(True).alias("crowded")))
    met = met.join(crowds, "gram", "left").select("doc", "tag", F.struct("gram", "first", "last", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("m"))
    texts = spread(map_arrow(source, packed, "doc long, tag long, packed binary"), "doc", "tag")
    pieces = map_arrow(texts.join(met.groupBy("doc", "tag").agg(F.collect_list("m").alias("met")), ["doc", "tag"]).select("doc", "tag", "packed", "met"), cut_pieces, PIECES)
    compared = in_arrow(spread(pieces, "route").sortWithinPartitions("route", "doc", "tag", "first"), compare, "doc long, tag long, first long, last long")
    ranges = resolved.where(F.col("kind") == RANGE).select("doc", "tag", "first", "last").union(compared)
    ranges = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    made = map_arrow(texts.join(ranges, ["doc", "tag"], "left").select("doc", "packed", "ranges"), union_ranges, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])]
    out = made.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias(key), *names)
    if with_kept:  # read when the result is; they stay in the checkpoint folder
        return out
    out = cut(out)
    for x in (resolved, crowds):
        drop_cut(x)
    return out
