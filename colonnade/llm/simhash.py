"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most r bits differ in at most r // m bits
of one of m segments, so each fingerprint looks up the small Hamming ball around each of its segments in a table
of segments, and the complete distance of what it finds is verified.

Near copies by the similarity of their shingle sets are looked up so by long fingerprints of the sets, and what is
near is compared by its shingles. Pairs that look-ups miss, as they do near the least similarity, are found by prefixes
of the sets, among what isn't linked already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_EDGES, Spool, components, cut, keyed, released, small, tune
from .substring import mix

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)

#: Shingles that are counted at once when common ones are sought, and how many common ones are kept; both change costs only, no result.
CHUNK = 1 << 22
#: Fingerprints with one segment that are compared with each other; more are told apart by their other bits first.
DENSE = 200
COMMON = 200_000
#: Rounds in which documents are compared with the best linked one of a shingle before all that is left is compared.
HUBS = 1
#: Segments looked up before the first and the second time that links are made; the others pass over what these linked.
ROUNDS = (2, 8)
#: Fingerprints that one owner of segments has, on average, and nodes that a task sends at once.
OWNED = 1 << 18
SENT = 1 << 15


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """Word shingles of the text in ASCII lower case, repeats included; the whole sequence if it is shorter."""
    words = bytes(text or b"").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, lowest first."""
    byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACE
    return (np.bincount(byte.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def simhash(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if over half of the shingles' XXH64 have it. No words: 0."""
    found = shingles(text, size)
    if not found:
        return 0
    counts = bit_counts(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in found), np.uint64, len(found)))
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""
    tune(docs.sparkSession)
    field = docs.schema[key]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fp = np.fromiter((simhash(x, size, seed) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(batches, f"key {field.dataType.simpleString()}, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def hamming_links(nodes: DataFrame, radius: int = 2, segments: int = 2, dense: int = DENSE) -> DataFrame:
    """(a, b) of all pairs of distinct values in column ``fp`` that differ in 1 to ``radius`` bits; a pair may come twice.

    Of the two ends of a link, the one with 0 at the lowest bit in which the segments differ enumerates it, so
    half of a ball is looked up. Where more than ``dense`` values have the same segment, the bits outside of it are cut
    into radius + 4 parts, of which two ends of a link have some four in common: values there meet only in such fours.
    """
    if segments < 2:
        raise ValueError("a fingerprint has two segments at least")
    width = 64 // segments
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius // segments)])

    def segment(i: int) -> Column:
        return F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def fours(i: int, fp: str) -> Column:
        """(number, bits) of each four of the parts outside of segment i."""
        outside = [x for x in range(64) if not i * width <= x < (i + 1) * width]
        parts = np.array_split(np.array(outside), radius + 4)
        found = [sum(1 << int(x) for p in c for x in p) for c in combinations(parts, 4)]
        return F.array(*[F.struct(F.lit(n).alias("four"), F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("bits")) for n, m in enumerate(found)])

    def in_fours(rows: DataFrame, fp: str) -> DataFrame:
        chosen = F.coalesce(*[F.when(F.col("seg") == i, fours(i, fp)) for i in range(segments)])
        return rows.withColumn("__f", F.explode(chosen)).select("*", "__f.four", "__f.bits").drop("__f")

    table = nodes.select("fp", F.posexplode(F.array(*[segment(i) for i in range(segments)])).alias("seg", "value"))
    crowded = cut(table.groupBy("seg", "value").count().filter(F.col("count") > dense).select("seg", "value"))
    probes = table.select(F.col("fp").alias("a"), "seg", F.col("value").alias("own"), F.explode(masks).alias("mask"))
    probes = probes.filter("(own & mask & -mask) = 0").selectExpr("a", "seg", "own ^ mask as value", "mask")
    near = f"a <> fp and (mask <> 0 or a < fp) and bit_count(a ^ fp) <= {radius}"
    if crowded.isEmpty():
        found = probes.join(table, ["seg", "value"])
    else:
        there = small(crowded)
        found = probes.join(table.join(there, ["seg", "value"], "left_anti"), ["seg", "value"])
        some, rest = (in_fours(x.join(there, ["seg", "value"], "left_semi"), fp) for x, fp in ((probes, "a"), (table, "fp")))
        packed = some.join(rest, ["seg", "value", "four", "bits"]).filter(near)
        found = found.select("a", "fp", "mask").unionByName(packed.select("a", "fp", "mask"))
    return found.filter(near).select("a", F.col("fp").alias("b"))


def _differ(similarity: float) -> float:
    """The chance that a bit of two fingerprints differs: the angle between their shingle sets, over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n_docs: int, similarity: float, recall: float = 0.99) -> tuple[int, int, int, int]:
    """(segments, bits of each, distance up to which a pair is taken, distance up to which it is compared exactly).

    Two sets of like size with Jaccard J have the cosine 2J / (1 + J); a bit differs with the probability of its angle
    over pi. Segments have six bits more than number the documents, 30 at least, so a look-up finds few strangers at any
    size; there are as many as find a pair halfway between the least similarity and 1 with the probability ``recall``
    when one bit of a segment may differ. Distances from two standard deviations below the one that the least
    similarity makes likely to three above it are in doubt. Below that halfway point such look-ups miss pairs, and
    distances say too little of short sets: ``near_duplicate_classes`` takes no pair by its distance, and finds those
    missed by other means.
    """
    width = min(48, max(30, max(1, n_docs).bit_length() + 6))
    p = _differ((1 + similarity) / 2)
    hit = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    segments = max(8, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
    bits, p = segments * width, _differ(similarity)
    deviation = math.sqrt(bits * p * (1 - p))
    return segments, width, math.floor(bits * p - 2 * deviation), math.ceil(bits * p + 3 * deviation)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of the distinct shingles, ascending."""
    found = set(shingles(text, size))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in found), np.uint64, len(found)))


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 times ``words`` bits; each 64 count another mix of the hashes. No hashes: all 0."""
    salts = np.arange(1, words + 1, dtype=np.uint64)[:, None]
    place = (np.arange(words * 8) * 256).reshape(words, 1, 8)
    seen = np.zeros(words * 8 * 256, np.int64)
    for i in range(0, len(hashes), 4096):
        byte = mix(hashes[None, i : i + 4096], salts).astype("<u8").view(np.uint8).reshape(words, -1, 8)
        seen += np.bincount((byte + place).ravel(), minlength=len(seen))
    counts = seen.reshape(words * 8, 256).astype(np.float64) @ _BITS.astype(np.float64)
    return np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view("<i8")


def segment_values(fingerprints: np.ndarray, segments: int, width: int) -> np.ndarray:
    """The segments of each row of signed words, as numbers."""
    bits = np.unpackbits(np.ascontiguousarray(fingerprints, "<i8").view(np.uint8), axis=1, count=segments * width, bitorder="little")
    return (bits.reshape(-1, segments, width) @ np.exp2(np.arange(width))).astype(np.int64)


def best_in_balls(value: np.ndarray, node: np.ndarray, part: np.ndarray, links: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): for each entry a that has one, the best entry b whose value is its own under one of the masks.

    Best is the one with most links, then the least; b is better than a and of another part. So an entry is in one pair
    at most as a, however many have its value, and of two that meet nobody else one finds the other.
    """
    order = np.lexsort((node, -links))
    value, node, part = value[order], node[order], part[order]  # an entry's place is its rank
    by_value = np.argsort(value, kind="stable")
    distinct, start, group = np.unique(value[by_value], return_index=True, return_inverse=True)
    first = by_value[start]
    none = len(value)
    other = np.flatnonzero(part[by_value] != part[first][group])[::-1]
    second = np.full(len(distinct), none)
    second[group[other]] = by_value[other]  # the last one written is the best
    entry_group = np.empty(none, np.int64)
    entry_group[by_value] = group
    best = np.full(none, none)
    for m in masks:
        sought = distinct ^ m
        at = np.minimum(np.searchsorted(distinct, sought), len(distinct) - 1)
        hit = np.flatnonzero((distinct[at] == sought)[entry_group])
        there = at[entry_group[hit]]
        found = np.where(part[first[there]] != part[hit], first[there], second[there])
        best[hit] = np.minimum(best[hit], found)
    a = np.flatnonzero(best < np.arange(none))
    return node[a], node[best[a]]


def ball_hits(nodes: DataFrame, shape: tuple[int, int], looked_up: range, owners: int) -> DataFrame:
    """(a, b) of nodes (id, w, part, links) whose fingerprints share one of those segments but for one bit; of each ball the best.

    Two segments that differ in one bit have their lower or their upper half in common. A segment is sent to two owners,
    by either half, and each looks up the part of the ball that leaves its half as it is. What moves grows with the
    nodes, not with the look-ups.
    """
    segments, width = shape
    low = width // 2
    fields = "value binary, node binary, part binary, links binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def messages() -> Iterator[pa.RecordBatch]:
            values, *rest = (np.concatenate(x) for x in zip(*held))
            for s in looked_up:
                for half, same in enumerate((values[:, s] & ((1 << low) - 1), values[:, s] >> low)):
                    owner = (mix(same.astype(np.uint64), np.uint64(half)) % np.uint64(owners)).astype(np.int64)
                    order = np.argsort(owner, kind="stable")
                    ends = np.searchsorted(owner[order], np.arange(owners + 1))
                    some = np.flatnonzero(np.diff(ends))
                    columns = [[x[order[ends[o] : ends[o + 1]]].tobytes() for o in some] for x in (values[:, s], *rest)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((s * 2 + half) * owners + some, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["owner", "value", "node", "part", "links"]
                    )

        for b in batches:
            if not b.num_rows:
                continue
            words = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            held.append((segment_values(words, segments, width), *(b.column(i).to_numpy() for i in (0, 2, 3))))
            n += b.num_rows
            if n >= SENT:
                yield from messages()
                held, n = [], 0
        if held:
            yield from messages()

    def answer(key: tuple, sent: pa.Table) -> pa.Table:
        half = key[0].as_py() // owners % 2
        masks = [0, *(1 << i for i in range(low, width))] if half == 0 else [1 << i for i in range(low)]
        arrays = (np.frombuffer(b"".join(sent[c].to_pylist()), np.int64) for c in ("value", "node", "part", "links"))
        return pa.table(dict(zip("ab", best_in_balls(*arrays, masks))))

    sent = nodes.select("id", "w", "part", "links").mapInArrow(send, f"owner long, {fields}")
    return sent.groupBy("owner").applyInArrow(answer, "a long, b long").distinct()


def fingerprint_links(rows: DataFrame, nodes: DataFrame, key: str, text: str, size: int, similarity: float, shape: tuple[int, int], farthest: int) -> DataFrame:
    """(a, b) of nodes (id, w) that are similar by their shingles, found by multi-index hashing of their fingerprints w.

    The segments are looked up in three rounds. In each, the complete distance of what is found is taken, each node is
    compared by its shingles with the nearest that it found, if within ``farthest`` bits, and later look-ups pass over
    what is in one component then. So a large group of near copies is never expanded into pairs.
    """
    owners = -(-nodes.count() // OWNED)
    links = nodes.sparkSession.createDataFrame([], "a long, b long")
    if not owners:
        return links
    rounds = [0, *(r for r in ROUNDS if r < shape[0]), shape[0]]
    for since, to in zip(rounds, rounds[1:]):
        if since:
            placed = nodes.join(small(_standing(links), 32), F.col("id") == F.col("node"), "left")
            placed = placed.select("id", "w", F.coalesce("component", "id").alias("part"), F.coalesce("links", F.lit(0)).alias("links"))
        else:
            placed = nodes.select("id", "w", F.col("id").alias("part"), F.lit(0).cast("long").alias("links"))
        hits = cut(ball_hits(placed, shape, range(since, to), owners))
        x, y = nodes.selectExpr("id as a", "w as x"), nodes.selectExpr("id as b", "w as y")
        distance = F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)")
        near = x.join(small(hits, 16), "a").join(y, "b").select("a", "b", distance.alias("d")).filter(F.col("d") <= farthest)
        near = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("c")).select("a", "c.b")
        links = cut(links.unionByName(_similar(rows, key, text, near, size, similarity)))
    return links


def common_shingles(rows: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, documents counted) of shingles of many documents, ascending; counted where a chunk of a partition has three or more."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def chunk() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            value, times = value[times > 2], times[times > 2]
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["value", "n"])

        for b in parts:
            for x in b.column(0).to_pylist():
                held.append(shingle_hashes(x, size))
                n += len(held[-1])
                if n > CHUNK:
                    yield chunk()
                    held, n = [], 0
        yield chunk()

    counted = rows.select(text).mapInArrow(batches, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "value").limit(COMMON).toArrow()
    value = found["value"].to_numpy().view(np.uint64)
    order = np.argsort(value)
    return value[order], found["n"].to_numpy()[order]


def prefix(hashes: np.ndarray, common: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes in one order of all shingles, common ones last: two sets of that similarity share one of these."""
    n = len(hashes)
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        count = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.lexsort((hashes, count))][: n - math.ceil(similarity * n - 1e-9) + 1]


def _similar(rows: DataFrame, key: str, text: str, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts' distinct shingles have that Jaccard similarity. Texts move, which compress well, and shingles are compared as such."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set[bytes]] = {}

        def shingled(i: int, t: bytes) -> set[bytes]:
            if i not in known:
                if len(known) > 16:
                    known.clear()
                known[i] = set(shingles(t, size))
            return known[i]

        for batch in parts:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = shingled(a, x), shingled(b, y)
                both = len(x & y)
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = Spool(pairs.distinct(), "pairs")
    pairs = asked.read()
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())
    held = Spool(rows.join(small(ids, 8), key, "left_semi").select(F.col(key).alias("id"), F.col(text).alias("t")), "texts")
    x, y = held.read().selectExpr("id as a", "t as x"), held.read().selectExpr("id as b", "t as y")
    found = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    held.drop()
    asked.drop()
    return found


def _standing(links: DataFrame) -> DataFrame:
    """(node, component, links) of each node with links: its component and how many links it has."""
    part = components(links, few=FEW_EDGES).selectExpr("node", "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return cut(part.join(degree, "node"))


def _parted(entries: DataFrame, links: DataFrame) -> tuple[DataFrame, Spool]:
    """The entries (value, id, n, pos) with the component and the number of links of each id; drop the spool when they have been read."""
    known = _standing(links)
    out = entries.join(small(known, 32), F.col("id") == F.col("node"), "left")
    spool = Spool(out.select("value", "id", "n", "pos", F.coalesce("component", "id").alias("part"), F.coalesce(known["links"], F.lit(0)).alias("links")), "parts")
    return spool.read(), spool


def near_duplicate_classes(rows: DataFrame, key: str = "__row", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, keep) of each row: ``keep`` is the least key among all rows that links lead to, its own if there are none.

    Links are exactly the pairs whose distinct shingles have that Jaccard similarity. Equal sets are one node. Nodes are
    first linked by multi-index hashing of their fingerprints, see ``fingerprint_links``. By ``plan`` that finds a pair
    with the probability 0.99 halfway between the least similarity and 1, but 0.7 at 0.8. What it misses is found for
    sure: of each set a prefix in one order of all shingles is looked up; similar sets share a shingle of their
    prefixes, and the first that they share leaves room for the overlap that they need. Every pair found so, whose ends
    aren't in one component already, is compared by its shingles: first each node with the least of those with a
    shingle, then with the one of them that has most links, then all that is left. So a large group of near copies isn't expanded into pairs, and no link between
    components is lost.
    """
    tune(rows.sparkSession)
    rows = rows.select(key, F.col(text).cast("binary").alias(text))
    segments, width, _, farthest = plan(rows.count(), similarity)
    words = -(-segments * width // 64)
    listed = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, text, size))  # 16 bytes for each of COMMON

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = [shingle_hashes(x, size) for x in b.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
            n = pa.array([len(x) for x in found], pa.int32())
            first = pa.array([prefix(x, *listed.value, similarity).view(np.int64) if len(x) else [] for x in found], pa.list_(pa.int64()))
            w = pa.array([long_fingerprint(x, words) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), digests, n, first, w], ["key", "s", "n", "first", "w"])

    kept = Spool(rows.mapInArrow(batches, "key long, s binary, n int, first array<long>, w array<long>"), "prefixes")
    prints = kept.read()
    nodes = cut(prints.groupBy("s").agg(F.min("key").alias("id")))
    single = prints.join(small(nodes.select(F.col("id").alias("key")), 8), "key", "left_semi").withColumnRenamed("key", "id")
    held = Spool(single.filter("n > 0").select("id", "w"), "fingerprints")
    links = fingerprint_links(rows, held.read(), key, text, size, similarity, (segments, width), farthest)
    held.drop()

    entries = single.select("id", "n", F.posexplode("first").alias("pos", "value"))
    # entries move once; most shingles stand in one set only
    bucket = Window.partitionBy("value")
    entries = entries.withColumn("c", F.min(F.struct("id", "n", "pos")).over(bucket)).withColumn("count", F.count("*").over(bucket))
    met = Spool(entries.filter("count > 1").selectExpr("value", "id", "n", "pos", "c.id as b", "c.n as m", "c.pos as place"), "shared")
    entries = met.read()
    # what may follow the first common shingle suffices for the overlap of similar sets
    fits = f"least(n - pos, m - place) + 1e-9 >= {similarity / (1 + similarity)!r}D * (n + m)"

    part, pairs = _standing(links), cut(entries.filter(f"id <> b and {fits}").selectExpr("id as a", "b").distinct())
    for end in "ab":
        pairs = pairs.join(small(part.selectExpr(f"node as {end}", f"component as of_{end}"), 16), end, "left")
    pairs = pairs.filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    links = cut(links.unionByName(_similar(rows, key, text, pairs, size, similarity)))
    # copies of one text may each be too far from the least of them, but near the text itself: the one with most links
    for _ in range(HUBS):
        parted, drop = _parted(entries, links)
        met.drop()
        hubs = parted.withColumn("c", F.max(F.struct("links", F.expr("-id as less"), "id", "n", "pos", "part")).over(bucket))
        hubs = hubs.selectExpr("id as a", "c.id as b", "n", "pos", "part", "c.n as m", "c.pos as place", "c.part as other")
        links = cut(links.unionByName(_similar(rows, key, text, hubs.filter(f"part <> other and {fits}").selectExpr("least(a, b) as a", "greatest(a, b) as b"), size, similarity)))
        entries, met = parted, drop
    entries, parts = _parted(entries, links)
    met.drop()

    # of a bucket each look-up meets components first, then the members of those that aren't its own
    probes = entries.selectExpr("value", "id as a", "n as m", "pos as place", "part as part_a")
    others = probes.join(entries.select("value", "part").distinct(), "value").filter("part < part_a").drop("part_a")
    pairs = others.join(entries, ["value", "part"]).filter(fits).selectExpr("least(a, id) as a", "greatest(a, id) as b")
    found = components(links.unionByName(_similar(rows, key, text, pairs, size, similarity)), few=FEW_EDGES)
    parts.drop()
    # all rows of a node are copies of its least row
    out = prints.select("key", "s").join(nodes.select("s", "id"), "s").join(found, F.col("id") == F.col("node"), "left")
    out = cut(out.select(F.col("key").alias(key), F.coalesce("component", "id").alias("keep")))
    kept.drop()
    return out


def without_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns kept.

    The first row of a group stays. Null and empty texts are one group, repeated rows are copies; an empty table
    gives no rows.
    """
    names = docs.columns
    rows = keyed(docs, *[f"`{c}`" for c in names])
    with released(docs.sparkSession):
        classes = near_duplicate_classes(rows, size=size, similarity=similarity)
        gone = cut(classes.filter("__row <> keep").select("__row"))
    return rows.join(small(gone, 8), "__row", "left_anti").select([f"`{c}`" for c in names])


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    id reachable (null only where no id of the component is known). Null and empty texts have fingerprint zero,
    linked like any other. Equal fingerprints are one node, so groups of copies never expand into pairs; very long
    texts are one fingerprint like others, of repeated rows each has its own row. An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    prints = cut(fingerprints(docs, doc_id, text, size))
    nodes = cut(prints.groupBy("fp").agg(F.min("key").alias("least")))
    found = components(hamming_links(nodes, radius, segments))
    nodes = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = nodes.join(least, "component").select("fp", "component_id")
    out = prints.join(classes, "fp")
    return out.select(F.col("key").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
