"""LM scoring: an interpolated modified Kneser-Ney model of order 3 or 2, counted in Spark, stored as sorted hash arrays
in the shared folder and memory-mapped by the workers that score.

Words in ASCII lower case are counted by their XXH64 hashes and numbered, the more frequent ones first. An n-gram's key is
a 64-bit hash of its words' numbers. Its counts are summed within a chunk of some million tokens, then sent to the owner of
a key range, and each level is counted from the one above: owners of triples send what their first two and their last two
words need to the owners of pairs, and those what words need to the owners of words. No owner gets more than one entry per
key and sender, so frequent words, pairs and contexts are no load on one task. What is sent is sorted numbers of words, as
differences, byte planes and zstd.

As is usual, a pair's count below order 3 is the number of distinct words before it, but pairs that begin a text keep
their own counts; the first word of a text is predicted from the start alone.

An owner's file holds, sorted within buckets of some 8 to 16 keys by the upper bits, the lower 32 bits of each key. So a
look-up takes an absent n-gram for one that is there with a probability of about 16 in 2**32 at any size of the corpus.
Words are told apart by all 64 bits.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, shared_dir, tune
from .substring import mix

#: Another seed than that of words, so no word in a text is the end.
END = np.uint64(xxhash.xxh64_intdigest(b"end", 1))
#: Numbers of words begin at 1; the start of a text, and any word that the model does not have.
START, UNKNOWN = 0, 1 << 62
#: Tokens whose counts are summed before they are sent: as words, as n-grams.
WORD_CHUNK, CHUNK = 2_000_000, 1_500_000
#: Owners are as many as shuffle partitions, or one for so many bytes of text.
OWNER_BYTES = 24 << 20
_HALF = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, an end after each; and the number of tokens of each."""
    words = [bytes(t or b"").lower().split() for t in texts]
    n = np.array([len(w) + 1 for w in words], np.int64)
    h = np.empty(int(n.sum()), np.uint64)
    last = np.cumsum(n) - 1
    inner = np.ones(len(h), bool)
    inner[last] = False
    h[inner] = np.fromiter((xxhash.xxh64_intdigest(x) for w in words for x in w), np.uint64, int(inner.sum()))
    h[last] = END
    return h, n


def _shifted(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value before each; ``start`` at the places of ``first``."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = start
    return out


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the values of each, after a place of each."""
    order = np.argsort(key)
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order[first], k[first], *[np.add.reduceat(v[order], first) if len(k) else v for v in values]


def _counts(c: np.ndarray) -> list[np.ndarray]:
    """What a context needs of the counts of what follows it: to be summed, how many are 1, 2 and more."""
    return [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)]


def _code(number: np.ndarray) -> np.ndarray:
    """Numbers, scrambled one to one, for hashes of n-grams."""
    x = number.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _key(*words: np.ndarray) -> np.ndarray:
    """Keys of n-grams of numbered words."""
    key = _code(words[0])
    for w in words[1:]:
        key = mix(key, _code(w))
    return key


def _by_pair(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of numbers in order and the sums of the values of each."""
    if len(a) and max(a.max(), b.max()) >= 1 << 31:
        order = np.lexsort((b, a))
    else:
        order = np.argsort(a << 32 | b)
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], *[np.add.reduceat(v[order], first) if len(a) else v for v in values]


def _place(key: np.ndarray, shards: int) -> np.ndarray:
    """A key's place among the shards, as a number with 32 binary places; rises with the key."""
    return (key >> _HALF) * np.uint64(shards)


# --- messages


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, by byte planes."""
    shape, planes = [], []
    for c in columns:
        top = int(c.max()) if len(c) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        shape += [len(c), width]
        planes.append(np.ascontiguousarray(c.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes())
    return struct.pack(f"<I{len(shape)}Q", len(columns), *shape) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    (k,) = struct.unpack_from("<I", data)
    shape = struct.unpack_from(f"<{2 * k}Q", data, 4)
    sizes = list(zip(shape[::2], shape[1::2]))
    raw = np.frombuffer(pa.decompress(data[4 + 16 * k :], decompressed_size=sum(n * w for n, w in sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for n, w in sizes:
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(f"<u{w}"))
        at += n * w
    return out


def _send_keys(kind: str, key: np.ndarray, shards: int, values: list[np.ndarray]) -> list[tuple]:
    """One row per shard with some of the sorted distinct keys, and their values."""
    edges = np.searchsorted(_place(key, shards) >> _HALF, np.arange(shards + 1, dtype=np.uint64)).tolist()
    return [
        (kind, s, _pack(np.diff(key[lo:hi], prepend=np.uint64(0)), *[v[lo:hi] for v in values]))
        for s, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi
    ]


def _receive_keys(blobs: list[bytes], n_values: int) -> list[np.ndarray]:
    """Distinct keys of all messages in order and the sums of their values."""
    got = [_unpack(b) for b in blobs]
    key = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(g[0], dtype=np.uint64) for g in got]])
    values = [np.concatenate([np.zeros(0, np.int64), *[g[i + 1].astype(np.int64) for g in got]]) for i in range(n_values)]
    return list(summed(key, *values)[1:])


def _send_grams(kind: str, key: np.ndarray, shards: int, words: list[np.ndarray], values: list[np.ndarray]) -> list[tuple]:
    """One row per shard with some of the n-grams, which must rise by the numbers of their words, and their values."""
    shard = (_place(key, shards) >> _HALF).astype(np.uint16 if shards < 1 << 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    out = []
    for s, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if lo == hi:
            continue
        same, sent = np.ones(hi - lo, bool), []
        for c in words:
            c = c[order[lo:hi]]
            sent.append(np.where(same, np.diff(c, prepend=0), c))
            same &= np.concatenate([[False], c[1:] == c[:-1]])
        out.append((kind, s, _pack(*sent, *[v[order[lo:hi]] for v in values])))
    return out


def _receive_grams(blobs: list[bytes], n: int, n_values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Numbers of the words and values of the n-grams of all messages, one message after another."""
    out = [[np.zeros(0, np.int64)] for _ in range(n + n_values)]
    for b in blobs:
        got = _unpack(b)
        same = np.ones(len(got[0]), bool)
        for i, x in enumerate(got):
            if i < n:
                runs = np.cumsum(x, dtype=np.int64)
                begin = ~same
                begin[0] = True
                x = runs - (runs - x.astype(np.int64))[begin][np.cumsum(begin) - 1]
                same &= np.concatenate([[False], x[1:] == x[:-1]])
            out[i].append(x.astype(np.int64))
    out = [np.concatenate(x) for x in out]
    return out[:n], out[n:]


# --- files in the shared folder


def _local(path: str) -> str | None:
    """The path on a mounted folder, None for one in another kind of store."""
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def _store(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays into one new file; its path and where each is."""
    import pyarrow.fs as fs

    path = f"{folder}/{name}-{uuid.uuid4().hex}.bin"
    if (own := _local(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        out = open(own, "wb")
    else:
        store, inner = fs.FileSystem.from_uri(path)
        out = store.open_output_stream(inner)
    parts, at = [], 0
    with out:
        for key, a in arrays.items():
            parts.append(f"{key},{a.dtype.str},{len(a)},{at}")
            out.write(a.tobytes())
            out.write(bytes(-a.nbytes % 8))
            at += a.nbytes + -a.nbytes % 8
    return f"{path}\t{';'.join(parts)}"


def _map(path: str, parts: str) -> dict[str, np.ndarray]:
    """Memory-maps the arrays of a file; one that is not on a mounted folder is copied first and its copy unlinked."""
    import pyarrow.fs as fs

    own = _local(path)
    copy = None
    if own is None:
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner) as src, tempfile.NamedTemporaryFile(delete=False) as dst:
            while block := src.read(1 << 22):
                dst.write(block)
        own = copy = dst.name
    whole = np.asarray(np.memmap(own, np.uint8, "r"))
    out = {}
    for key, dtype, n, at in (x.split(",") for x in parts.split(";")):
        out[key] = whole[int(at) : int(at) + int(n) * np.dtype(dtype).itemsize].view(dtype)
    if copy:
        os.unlink(copy)
    return out


def _columns(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Counts as single bytes; the places and values of those that need more stand beside them."""
    out = {}
    for name, x in values.items():
        large = np.flatnonzero(x >= 255)
        out |= {name: np.minimum(x, 255).astype(np.uint8), f"{name} at": large.astype("<u4"), f"{name} is": x[large].astype("<u8")}
    return out


def _value(arrays: dict[str, np.ndarray], name: str, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    out[there] = arrays[name][at[there]]
    if f"{name} is" in arrays:
        large = np.flatnonzero(out == 255)
        out[large] = arrays[f"{name} is"][np.searchsorted(arrays[f"{name} at"], at[large])]
    return out


def _hashed(key: np.ndarray, shards: int, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays for the sorted keys of one shard: where buckets begin, the lower halves of the keys in each, the values."""
    bits = (len(key) >> 4).bit_length()
    bucket = _bucket(key, shards, bits)
    order = np.argsort(bucket << _HALF | key & _LOW)
    begins = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4")
    return {"begins": begins, "half": (key[order] & _LOW).astype("<u4"), **_columns({k: v[order] for k, v in values.items()})}


def _bucket(key: np.ndarray, shards: int, bits: int) -> np.ndarray:
    return (_place(key, shards) & _LOW) >> np.uint64(32 - bits)


def _look_up(key: np.ndarray, shards: int, arrays: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the arrays of its shard, and whether it is there."""
    if "word" in arrays:
        table = arrays["word"]
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return at, table[at] == key
    begins, half = arrays["begins"], arrays["half"]
    bucket, want = _bucket(key, shards, (len(begins) - 1).bit_length() - 1).astype(np.int64), (key & _LOW).astype(np.uint32)
    lo, end = begins[bucket].astype(np.int64), begins[bucket + 1].astype(np.int64)
    hi, last = end, len(half) - 1
    for _ in range(int((hi - lo).max()).bit_length()):
        mid = (lo + hi) >> 1
        right = (lo < hi) & (half[np.minimum(mid, last)] < want)
        lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, mid)
    at = np.minimum(lo, last)
    return at, (lo < end) & (half[at] == want)


def interpolated(count, total, n1, n2, n3, discounts, lower) -> np.ndarray:
    """Probabilities from discounted counts and those of the order below; the latter where the context is not known."""
    d = np.array([0.0, *discounts])
    safe = np.maximum(total, 1)
    p = np.maximum(count - d[np.minimum(count, 3)], 0) / safe + (d[1] * n1 + d[2] * n2 + d[3] * n3) / safe * lower
    return np.where(total > 0, p, lower)


_CONTEXT = ("total", "n1", "n2", "n3")


@dataclass
class Files:
    """One file per shard and level, None for an empty one."""

    shards: int
    files: dict[str, list]
    _maps: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_maps": {}}

    def _find(self, level: str, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Values of any keys, 0 where a key is not in the model, shard by shard."""
        keys, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(keys), np.int64) for _ in names]
        shard = (_place(keys, self.shards) >> _HALF).astype(np.int64)
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
            s = int(shard[lo])
            if self.files[level][s] is None:
                continue
            if (level, s) not in self._maps:
                self._maps[level, s] = _map(*self.files[level][s])
            arrays = self._maps[level, s]
            at, there = _look_up(keys[lo:hi], self.shards, arrays)
            for o, name in zip(out, names):
                o[lo:hi] = _value(arrays, name, at, there)
        return [o[back] for o in out]

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, training count) of each word hash."""
        rank, count = self._find("word", h, ("rank", "count"))
        shard = (_place(h, self.shards) >> _HALF).astype(np.int64)
        return np.where(count > 0, rank * self.shards + shard + 1, UNKNOWN), count


@dataclass
class Model(Files):
    """Numbers of the model; its files are those of words, of what follows a word, of pairs and of triples."""

    order: int = 3
    n_tokens: int = 0
    n_words: int = 0
    n_pairs: int = 0
    #: of triples, pairs, words
    discounts: tuple = ()
    #: How many words stand after 1, 2 and more distinct ones.
    low_counts: tuple = ()
    folder: str = ""

    def probabilities(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(model probability, training count) of each token of texts with ``n`` tokens each."""
        first = np.cumsum(n) - n
        word, w = np.unique(h, return_inverse=True)
        number, count = self.numbers(word)
        code = _code(np.append(number, START))
        met, *context = self._find("follow", code, ("met", *_CONTEXT))
        v = _shifted(w, first, len(word))
        e = np.array([0.0, *self.discounts[2]])
        base = max(1, self.n_pairs)
        spare = sum(x * y for x, y in zip(self.discounts[2], self.low_counts)) / base if self.n_pairs else 1.0
        p = np.maximum(met - e[np.minimum(met, 3)], 0) / base + spare / (self.n_words + 1)
        pair = mix(code[v], code[w])
        c, *after = self._find("pair", pair, ("count", *_CONTEXT))
        p = interpolated(c, *[x[v] for x in context], self.discounts[1], p[w])
        if self.order == 3:
            # a token's context is the pair that ends before it; the first has none
            (c,) = self._find("triple", mix(_shifted(pair, first, 0), code[w]), ("count",))
            p = interpolated(c, *[_shifted(x, first, 0) for x in after], self.discounts[0], p)
        return p, count[w]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1 to 4; fixed ones where those are too few."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k
        out.append(min(max(d, 0.0), float(k)) or 0.5 * k)
    return tuple(out)


_ROW = "kind string, shard int, data binary"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kind, shard, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(shard, pa.int32()), pa.array(data, pa.binary())], ["kind", "shard", "data"])


def _chunks(parts, most: int):
    """Tokens of the texts and how many each text has, about ``most`` at a time."""
    held, size = [], 0
    for b in parts:
        if b.num_rows:
            held.append(tokens(b.column(0).to_pylist()))
            size += len(held[-1][0])
        if size > most:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _count_chunk(files: Files, h: np.ndarray, n: np.ndarray, order: int) -> list[tuple]:
    """The distinct n-grams of some texts, for their owners."""
    h, place = np.unique(h, return_inverse=True)
    number, _ = files.numbers(h)
    words, back = np.unique(np.append(number, START), return_inverse=True)
    first, k, code = np.cumsum(n) - n, len(words), _code(words)
    w = back[place]
    v = _shifted(w, first, 0)
    pair, place = np.unique(v * k + w, return_inverse=True)
    rows = []
    if order == 3:
        inner = np.ones(len(w), bool)
        inner[first] = False
        triple, c = np.unique(place[inner] * k + _shifted(v, first, 0)[inner], return_counts=True)
        a, (b, z) = triple % k, np.divmod(pair[triple // k], k)
        rows = _send_grams("triple", mix(mix(code[a], code[b]), code[z]), files.shards, [words[b], words[z], words[a]], [c])
        place = place[first]
    c = np.bincount(place, minlength=len(pair))
    b, z = np.divmod(pair[c > 0], k)
    c = c[c > 0]
    return rows + _send_grams("pair", mix(code[b], code[z]), files.shards, [words[b], words[z]], [c, *[np.zeros_like(c)] * 4])


def _owned(rows: DataFrame, kind: str, merge) -> DataFrame:
    """Merges what the owners get of this kind; other rows pass."""

    def run(key, t):
        if not key[0].as_py():
            return t.select(["kind", "shard", "data"])
        return pa.Table.from_batches([_table(merge(key[1].as_py(), t["data"].to_pylist()))])

    return rows.groupBy((F.col("kind") == kind).alias("__own"), "shard").applyInArrow(run, _ROW)


def train(texts: DataFrame, text: str = "text", order: int = 3) -> Model:
    """Counts the texts and writes the model's files below the shared folder; ``drop`` deletes them."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = texts.sparkSession
    tune(spark)
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(partitions(spark), -(-size // OWNER_BYTES))
    folder = f"{shared_dir(spark)}/colonnade-lm-{uuid.uuid4().hex}"
    words = Files(shards, {})

    def file(level: str, shard: int, arrays: dict, *facts: int) -> tuple:
        return "file", shard, "\t".join([level, _store(folder, f"{level}-{shard}", arrays), *map(str, facts)]).encode()

    def spread(c: np.ndarray) -> list[int]:
        return [len(c), *[int((c == i).sum()) for i in (1, 2, 3, 4)], int((c > 2).sum())]

    def count_words(parts):
        for h, _ in _chunks(parts, WORD_CHUNK):
            word, times = np.unique(h, return_counts=True)
            yield _table(_send_keys("count", word, shards, [times]))

    def number(shard: int, blobs: list) -> list[tuple]:
        word, c = _receive_keys(blobs, 1)
        rank = np.empty(len(word), "<u4")
        rank[np.argsort(-c, kind="stable")] = np.arange(len(word))
        return [file("word", shard, {"word": word, "rank": rank, **_columns({"count": c})}, int(c.sum()), len(word))]

    def count_grams(parts):
        for h, n in _chunks(parts, CHUNK):
            yield _table(_count_chunk(words, h, n, order))

    def triples(shard: int, blobs: list) -> list[tuple]:
        (v, w, u), (c,) = _receive_grams(blobs, 3, 1)
        at, key, c = summed(_key(u, v, w), c)
        u, v, w = u[at], v[at], w[at]
        rows = [file("triple", shard, _hashed(key, shards, {"count": c}), *spread(c))]
        # pairs get the number of words before them, and the counts of those after them
        none, one = np.zeros(len(c), np.int64), np.ones(len(c), np.int64)
        a, b, *values = _by_pair(np.concatenate([v, u]), np.concatenate([w, v]), np.concatenate([one, none]), *[np.concatenate([none, x]) for x in _counts(c)])
        return rows + _send_grams("pair", _key(a, b), shards, [a, b], values)

    def pairs(shard: int, blobs: list) -> list[tuple]:
        (v, w), values = _receive_grams(blobs, 2, 5)
        at, key, c, *context = summed(_key(v, w), *values)
        v, w = v[at], w[at]
        rows = [file("pair", shard, _hashed(key, shards, {"count": c, **dict(zip(_CONTEXT, context))}), *spread(c))]
        # and words the number of words before them, and the counts of those after them
        none, one = np.zeros(len(c), np.int64), np.ones(len(c), np.int64)
        _, word, *values = summed(np.concatenate([w, v]), np.concatenate([one, none]), *[np.concatenate([none, x]) for x in _counts(c)])
        return rows + _send_grams("follow", _key(word), shards, [word], values)

    def follow(shard: int, blobs: list) -> list[tuple]:
        (word,), values = _receive_grams(blobs, 1, 5)
        _, key, met, *context = summed(_key(word), *values)
        return [file("follow", shard, _hashed(key, shards, {"met": met, **dict(zip(_CONTEXT, context))}), *spread(met))]

    facts = {}

    def collect(rows: DataFrame, levels: dict[str, int]) -> None:
        """Where the files are, and the sums of their facts: one row per shard and level. What is in no row has no file."""
        for level, n in levels.items():
            words.files[level], facts[level] = [None] * shards, np.zeros(n, np.int64)
        for r in rows.collect():
            level, path, parts, *numbers = bytes(r["data"]).decode().split("\t")
            words.files[level][r["shard"]] = (path, parts)
            facts[level] += np.array([int(x) for x in numbers])

    source = texts.select(F.col(text).cast("binary"))
    collect(_owned(source.mapInArrow(count_words, _ROW), "count", number), {"word": 2})
    grams = source.mapInArrow(count_grams, _ROW)
    if order == 3:
        grams = _owned(grams, "triple", triples)
    grams = _owned(_owned(grams, "pair", pairs), "follow", follow)
    collect(grams, {"triple": 6, "pair": 6, "follow": 6})
    n_tokens, n_words = facts["word"].tolist()
    d = tuple(discounts(facts[level][1:5].tolist()) for level in ("triple", "pair", "follow"))
    low = facts["follow"]
    return Model(shards, words.files, order=order, n_tokens=n_tokens, n_words=n_words, n_pairs=int(facts["pair"][0]), discounts=d, low_counts=(int(low[1]), int(low[2]), int(low[5])), folder=folder)


def drop(spark, model: Model) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(model.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def score(docs: DataFrame, model: Model, carry: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the carried columns, n_tokens, n_known, base_score, score (log10 probability of the text), perplexity.

    Null and empty texts are one end token; repeated rows are rows of their own; an empty table gives no rows.
    Columns not carried are not read, whatever their names; a text of any length is scored whole.
    """
    tune(docs.sparkSession)
    n_carry = len(carry)

    def run(parts):
        for b in parts:
            if not b.num_rows:
                continue
            h, n = tokens(b.column(n_carry).to_pylist())
            p, c = model.probabilities(h, n)
            first = np.cumsum(n) - n
            base = np.log10((c + 1) / (model.n_tokens + model.n_words + 1))
            score = np.add.reduceat(np.log10(p), first)
            known = np.add.reduceat((c > 0).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n_carry], pa.array(n), pa.array(known), pa.array(np.add.reduceat(base, first)), pa.array(score), pa.array(10 ** np.minimum(300, -score / n))],
                [*carry, "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text).cast("binary").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, held: int = 2, order: int = 3) -> DataFrame:
    """Learns from the documents outside one fold and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A document's fold is the CRC-32 of its id as text, modulo ``parts``; a null id counts as the empty text. With
    nothing to learn from, every token has the probability of an unknown one.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts
    rows = docs.select(F.col(doc_id), (fold == held).alias("held_out"), F.col(text).cast("binary").alias("text"))
    model = train(rows.filter(~F.col("held_out")), order=order)
    out = score(rows, model, (doc_id, "held_out"))
    out = cut(out.withColumn("train_tokens", F.lit(model.n_tokens).cast("long")))
    drop(spark, model)
    return out
