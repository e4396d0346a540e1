"""Secret scans: patterns propose candidates; how many repositories and owners share a value tells copied examples
from credentials of one owner."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool, cut, keyed, small, tune

#: Fixed patterns and lengths of the contract. All they match is ASCII, so they read UTF-8 bytes.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Runs of fewer than 16 are dropped anyway; a run is matched whole.
HEX = re.compile(rb"[0-9a-f]{16,}")
#: What the method looks at besides: long tokens of mixed characters.
LOOSE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "owned")
LEAST_BITS = 3.5
#: A value of more owners than this is a copied example.
MOST_OWNERS = 2


def bits_per_char(value: bytes) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _mixed(value: bytes) -> bool:
    return bool(re.search(rb"[0-9]", value) and re.search(rb"[a-z]", value) and re.search(rb"[A-Z]", value)) and bits_per_char(value) >= LEAST_BITS


def candidates(text: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, start, end, value) with byte offsets, by start; of the loose kind only what no base span overlaps."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    found.sort(key=lambda x: x[1])
    # the furthest end of the base spans up to each, so one look tells whether any of them reaches a place
    starts, reach = [x[1] for x in found], list(accumulate((x[2] for x in found), max))
    loose = []
    for m in LOOSE.finditer(text):
        before = bisect_left(starts, m.end())
        if not (before and reach[before - 1] > m.start()) and _mixed(m[0]):
            loose.append(("owned", m.start(), m.end(), m[0]))
    return sorted(found + loose, key=lambda x: x[1]) if loose else found


def in_code_points(text: bytes, spans: list[tuple[str, int, int, bytes]]) -> list[tuple[str, int, int, bytes]]:
    """The spans, which come by start and are ASCII, with places in code points; what lies between starts is decoded once."""
    if text.isascii():
        return spans
    out, at, points = [], 0, 0
    for kind, start, end, value in spans:
        points += len(text[at:start].decode("utf-8", "replace"))
        at = start
        out.append((kind, points, points + end - start, value))
    return out


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: tuple = ("source", "lang"), owner: str = "source", most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end, value_hash, repositories, owners, live).

    Spans come by start, then kind (assign, access, hex, owned); places count code points, ``end`` is exclusive.
    A value is ``live`` if at most ``most_owners`` owners have it; base kinds are reported either way, the loose
    kind ``owned`` only where live. A null repository or owner counts as one of its own. Null and empty texts
    have no spans; of very long texts all is read, in time in proportion to length and matches; repeated rows are
    rows of their own and raise no count of owners; an empty table gives no rows; other columns, whatever their names,
    are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = keyed(docs, F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__text"), F.struct(*[F.col(c).cast("string") for c in repository]).alias("__repo"), F.col(owner).cast("string").alias("__owner"))

    def scan(parts):
        for b in parts:
            at, got = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                t = bytes(t or b"")
                for kind, start, end, value in in_code_points(t, candidates(t)):
                    at.append(i)
                    got.append((kind, start, end, hashlib.sha256(value).digest()))
            kind, start, end, value = zip(*got) if got else ((), (), (), ())
            row, repo, own = (b.column(j).take(pa.array(at, pa.int64())) for j in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([row, repo, own, pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.binary())], ["row", "repo", "owner", "kind", "start", "end", "value"])

    found = rows.select("__row", "__text", F.to_json("__repo").alias("repo"), F.col("__owner").alias("owner"))
    found = found.mapInArrow(scan, "row long, repo string, owner string, kind string, start int, end int, value binary")
    # the candidates are few; written once, so that texts are scanned once
    spool = Spool(found, "secrets")
    found = spool.read()
    # one row per value, repository and owner before the counts: a widely copied value is no load on one task
    spread = found.groupBy("value", "repo", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(
        F.count_distinct("repo").alias("repositories"), F.count_distinct(F.coalesce("owner", F.lit("\x00"))).alias("owners")
    )
    # a plain join: adaptive execution splits the partition of a value that very many rows have
    joined = found.join(spread, "value")
    live = F.col("owners") <= most_owners
    joined = joined.filter((F.col("kind") != "owned") | live)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])[F.col("kind")]
    span = F.struct("start", order.alias("order"), "end", "kind", "value", "repositories", "owners", live.alias("live"))
    spans = joined.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = cut(spans.select("row", F.transform("spans", lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"].alias("value_hash"), s["repositories"], s["owners"], s["live"])).alias("spans")))
    spool.drop()
    out = rows.select("__row", "__id").join(small(spans, 400), F.col("__row") == F.col("row"), "left")
    empty = "cast(array() as array<struct<kind:string,start:int,end:int,value_hash:binary,repositories:bigint,owners:bigint,live:boolean>>)"
    return out.select(F.col("__id").alias(doc_id), F.coalesce("spans", F.expr(empty)).alias("spans"))
