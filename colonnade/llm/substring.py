"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

A window is ``window`` consecutive words. The least hash among the phrases (``phrase`` words) of a window is its
anchor; a run of windows with one anchor is a block. Equal windows have equal anchors, so every window that another
one equals is in a block whose anchor the corpus has more than once; an exchange of anchor hashes finds these.

Those blocks of all documents, with their words, are the reference, indexed by anchor. In each bucket a block is parsed
from left to right: at a window that occurs elsewhere it takes the longest factor that any reference block has, and
goes on behind it. Where a factor ends, the windows across its boundary are looked up on their own, so no repeat that
straddles two factors is missed. A factor names its reference (document and word), and its words are compared, as
words, with those of the reference. Factors that go on in the same reference are joined; all are of a window at least
and are the duplicate spans.

Equal blocks of a task are sent once; the others take the first one as their reference. Anchors with very many blocks
are dealt by window instead, each distinct window once per task, so no bucket grows with one passage or phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLACE_BITS, Spool, keyed, partitions, tune
from .exchange import Answers, ByFile, among, exchange

WINDOW, PHRASE = 35, 8
#: Blocks of one anchor that are compared together; anchors with more are dealt by window.
HOT_BLOCKS = 20_000
#: Windows that a task parses at once, and bytes of blocks that a task remembers as sent.
CHUNK, SEEN_BYTES = 200_000, 64 << 20
#: Blocks that a document is expected to have, for the size of the exchange only.
_PER_DOCUMENT = 50
_RUN = 32
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair."""
    x = a * _A + (b ^ (b >> np.uint64(31))) * _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            out = power if out is None else mix(out[: len(h) - done - size + 1], power[done : done + len(h) - done - size + 1])
            done += size
        if done == n:
            return out[: len(h) - n + 1]
        power = mix(power[: len(power) - size], power[size:])
        size *= 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def blocks(words: list[list[bytes]], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, length, anchor, whether its anchor stands in it more than once) of each block of documents' words."""
    lengths = np.array([len(w) for w in words], np.int64)
    h = word_hashes([x for w in words if len(w) >= window for x in w])
    lengths[lengths < window] = 0
    doc = np.repeat(np.arange(len(words)), lengths)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, h, np.zeros(0, bool)
    grams = gram_hashes(h, phrase)
    anchors = sliding_min(grams, window - phrase + 1)
    at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    anchors, own = anchors[at], doc[at]
    start = at - (np.cumsum(lengths) - lengths)[own]
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    first = np.flatnonzero(inside % _RUN == 0)
    lens, anchor = np.diff(first, append=len(at)), anchors[first]
    # windows of one block can equal each other, where its anchor stands in it again
    spans = lens + window - phrase
    begin = np.cumsum(spans) - spans
    places = np.repeat(at[first] - begin, spans) + np.arange(int(spans.sum()))
    twice = np.add.reduceat((grams[places] == np.repeat(anchor, spans)).astype(np.int32), begin) > 1
    return own[first], start[first], lens, anchor, twice


def _split(texts: list) -> list[list[bytes]]:
    return [bytes(t or b"").split() for t in texts]


#: A block of n windows with its words, or, without words, a factor: n windows that stand at ref_start of ref_row, too.
_SENT = {"key": pa.int64(), "row": pa.int64(), "start": pa.int32(), "n": pa.int32(), "ref_row": pa.int64(), "ref_start": pa.int32(), "body": pa.binary()}
_FACTOR = ("row", "start", "n", "ref_row", "ref_start")
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _batch(rows: list[tuple], names) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, _SENT[n]) for x, n in zip(columns, names)], list(names))


def _send(batches: Iterator[pa.RecordBatch], answers: Answers, window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """Blocks whose anchors the corpus has more than once, each distinct one once, and factors for those that are equal to one sent."""
    seen: dict[bytes, list] = {}
    held = 0
    for b in batches:
        rows, words = b.column(0).to_numpy(), _split(b.column(1).to_pylist())
        own, start, lens, anchor, _ = blocks(words, window, phrase)
        row = rows[own]
        file, short = row >> PLACE_BITS, anchor >> np.uint64(16)
        shared, often = np.zeros(len(own), bool), np.zeros(len(own), bool)
        for f in np.unique(file).tolist():
            here = file == f
            shared[here], often[here] = (among(short[here], t) for t in answers.of(f))
        out = []
        for i in np.flatnonzero(shared).tolist():
            w, r, s, n = words[own[i]], int(row[i]), int(start[i]), int(lens[i])
            hot = bool(often[i])
            for at in range(s, s + n) if hot else (s,):
                size = 1 if hot else n
                body = b" ".join(w[at : at + size + window - 1])
                first = seen.get(body)
                if first is None:
                    key = xxhash.xxh64_intdigest(body) if hot else int(anchor[i])
                    out.append((key - (1 << 64) if key >> 63 else key, r, at, size, None, None, body))
                    seen[body] = [r, at, False]
                    held += len(body)
                    continue
                # the words are equal; a factor travels by no anchor
                out.append((hash((r, at)), r, at, size, first[0], first[1], None))
                if not first[2]:
                    first[2] = True
                    out.append((hash((r, at, 1)), first[0], first[1], size, r, at, None))
        if held > SEEN_BYTES:
            seen.clear()
            held = 0
        yield _batch(out, list(_SENT))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks, in order; equal only where both are."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _window_ids(words: np.ndarray, window: int) -> np.ndarray:
    """A number for the ``window`` words from each place on, equal only where all words are."""
    size, rank = 1, words
    while size * 2 <= window:
        rank = _pairs(rank[: len(rank) - size], rank[size:])
        size *= 2
    return _pairs(rank[: len(rank) - (window - size)], rank[window - size :]) if window > size else rank


def _parse(rows: np.ndarray, starts: np.ndarray, lens: np.ndarray, bodies: list[bytes], window: int) -> list[tuple]:
    """The factors of blocks, each against all the others and itself: (row, start, n, ref_row, ref_start).

    Windows are numbered by their words. The windows from each place on, up to the first that occurs nowhere else, are
    sorted as sequences; the longest match of a place is that of one of its neighbours.
    """
    words = pa.array(b" ".join(bodies).split(b" "), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    offsets = np.cumsum(lens + window - 1) - (lens + window - 1)
    block = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum(lens) - lens
    inside = np.arange(len(block)) - first[block]
    ids = _window_ids(words, window)[offsets[block] + inside]
    again = np.bincount(ids)[ids] > 1
    at = np.flatnonzero(again)
    if not len(at):
        return []
    # places that go on: the next window is of the same block and occurs elsewhere, too
    block, inside, ids = block[at], inside[at], ids[at]
    count = len(at)
    last = np.ones(count, bool)
    last[:-1] = (at[1:] != at[:-1] + 1) | (block[1:] != block[:-1])
    run = np.arange(count)
    ends = np.flatnonzero(last)
    avail = ends[np.searchsorted(ends, run)] - run + 1
    ranks = [_pairs(ids, np.zeros(count, np.int64)) + 1]
    size = 1
    while size < int(avail.max()):
        rank = ranks[-1]
        follow = np.zeros(count, np.int64)
        go = run[avail > size]
        follow[go] = rank[go + size]
        ranks.append(_pairs(rank, follow) + 1)
        size *= 2
    order = np.lexsort((starts[block] + inside, rows[block], ranks[-1]))
    x, y = order[:-1], order[1:]
    common = np.zeros(count - 1, np.int64)
    limit = np.minimum(avail[x], avail[y])
    for k in range(len(ranks) - 1, -1, -1):
        ok = common + (1 << k) <= limit
        ok[ok] = ranks[k][(x + common)[ok]] == ranks[k][(y + common)[ok]]
        common[ok] += 1 << k
    before, after = np.concatenate([[0], common]), np.concatenate([common, [0]])
    length, ref = np.empty(count, np.int64), np.empty(count, np.int64)
    length[order] = np.maximum(before, after)
    ref[order] = np.where(before >= after, np.concatenate([[0], x]), np.concatenate([y, [0]]))
    out, goal = [], -1
    row, place = rows[block].tolist(), (starts[block] + inside).tolist()
    lengths, refs, begins = length.tolist(), ref.tolist(), np.concatenate([[True], last[:-1]]).tolist()
    for i in range(count):
        if begins[i] or i >= goal:
            out.append((row[i], place[i], lengths[i], row[refs[i]], place[refs[i]]))
            goal = i + lengths[i]
    return out


def _look_up(t: pa.Table, window: int) -> pa.RecordBatch:
    """The factors that came and those of the blocks of whole buckets."""
    t = t.combine_chunks()
    known = t.filter(pa.compute.is_null(t["body"]))
    sent = t.filter(pa.compute.is_valid(t["body"]))
    found = list(zip(*(known[n].to_pylist() for n in _FACTOR)))
    if sent.num_rows:
        found += _parse(*(sent[n].to_numpy().astype(np.int64) for n in ("row", "start", "n")), sent["body"].to_pylist(), window)
    return _batch(found, _FACTOR)


def _buckets(parts: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Looks up whole buckets of a partition sorted by key, about CHUNK windows at a time."""
    held: list[pa.RecordBatch] = []
    windows = 0
    for b in parts:
        if not b.num_rows:
            continue
        held.append(b)
        windows += int(b.column(3).to_numpy().sum())
        if windows >= CHUNK:
            t = pa.Table.from_batches(held)
            keys = t["key"].to_numpy()
            end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if end:
                yield _look_up(t.slice(0, end), window)
                held = t.slice(end).to_batches()
                windows = int(t["n"].to_numpy()[end:].sum())
    if held:
        yield _look_up(pa.Table.from_batches(held), window)


def factors(found: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """The parse of a document from (start, n, ref_row, ref_start) of its blocks: (first word, words, ref_row, ref_start) by start.

    What an earlier factor has is not taken again, and factors that go on in the same reference are one.
    """
    out: list[list[int]] = []
    for start, n, row, at in sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3])):
        if out:
            done = out[-1][0] + out[-1][1]
            if start < done:
                start, n, at = done, n - (done - start), at + done - start
            if n <= 0:
                continue
            if start == done and row == out[-1][2] and at == out[-1][3] + out[-1][1]:
                out[-1][1] += n
                continue
        out.append([start, n, row, at])
    return [(s, n + window - 1, r, a) for s, n, r, a in out]


class Spans(ByFile):
    """The factors by document of the files that a task reads."""

    file: int | None = None

    def of(self, key: int) -> list[tuple[int, int, int, int]]:
        if key >> PLACE_BITS != self.file:
            self.file, t = key >> PLACE_BITS, self.table(key >> PLACE_BITS)
            columns = [t[n].to_numpy() if t is not None else np.zeros(0, np.int64) for n in _FACTOR]
            order = np.argsort(columns[0], kind="stable")
            self.rows, *self.rest = (c[order] for c in columns)
        a, z = np.searchsorted(self.rows, [key, key + 1])
        return list(zip(*(c[a:z].tolist() for c in self.rest))) if a < z else []


def substring_dedup(docs: DataFrame, carry: tuple = ("doc_id",), text: str = "text", window: int = WINDOW, phrase: int = PHRASE, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: the carried columns, __row, n_words, n_removed, factors, kept (text).

    A word is removed if a window of ``window`` words that covers it has the same words as a window that starts
    anywhere else, in the same or another document; both are removed. ``factors`` are (start, length, ref_row, ref_start)
    in words: the same words stand at ref_start of the document whose __row is ref_row. Null and empty texts and texts
    shorter than a window lose nothing; very long texts are many blocks; repeated rows remove each other's windows; an
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    if not 1 <= phrase < window:
        raise ValueError("phrase must be shorter than window")
    spark = docs.sparkSession
    tune(spark)
    rows = keyed(docs, *[f"`{c}`" for c in carry], F.col(text).cast("binary").alias("__text"))
    texts = rows.select("__row", "__text")

    def anchors(b):
        own, _, _, anchor, twice = blocks(_split(b.column(1).to_pylist()), window, phrase)
        return np.concatenate([b.column(0).to_numpy()[x] for x in (own, own[twice])]), np.concatenate([anchor, anchor[twice]]) >> np.uint64(16)

    spool, answers = exchange(texts, anchors, texts.count() * _PER_DOCUMENT, hot_blocks)
    sent = texts.mapInArrow(lambda parts: _send(parts, answers, window, phrase), ", ".join(f"{n} {_SQL[t]}" for n, t in _SENT.items()))
    index = sent.repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = index.mapInArrow(lambda parts: _buckets(parts, window), ", ".join(f"{n} {_SQL[_SENT[n]]}" for n in _FACTOR))
    found = found.withColumn("file", F.shiftright("row", PLACE_BITS)).repartition(partitions(spark), "file")
    # read with the result, so it stays until the session ends
    spans = Spans(Spool(found, "factors", by="file").drop_at_exit().path)
    spool.drop()
    piece = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_row", pa.int64()), ("ref_start", pa.int32())])
    names = [f.name for f in piece]
    n = len(carry)

    def parse(parts):
        for b in parts:
            out = []
            for key, words in zip(b.column(n).to_pylist(), _split(b.column(n + 1).to_pylist())):
                parsed = factors(spans.of(key), window)
                kept, at, removed = [], 0, 0
                for s, size, *_ in parsed:
                    kept += words[at:s]
                    removed += max(0, s + size - max(at, s))
                    at = max(at, s + size)
                kept += words[at:]
                out.append((len(words), removed, [dict(zip(names, x)) for x in parsed], b" ".join(kept)))
            columns = zip(*out) if out else [[]] * 4
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(piece), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], *arrays], [*carry, "__row", "n_words", "n_removed", "factors", "kept"])

    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(*x) for x in (("__row", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("factors", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ref_row", T.LongType()), T.StructField("ref_start", T.IntegerType())]))), ("kept", T.BinaryType())))])
    return rows.select(*[f"`{c}`" for c in carry], "__row", "__text").mapInArrow(parse, schema).withColumn("kept", F.col("kept").cast("string"))
