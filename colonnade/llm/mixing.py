"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points, mapped through the cumulative weights, name a source for each slot; slots are ranked per
source; rank r takes block r of the source, whose documents are shuffled, laid end to end and cut into blocks of
equally many words. After the last block a source starts over. The schedule takes whole blocks up to a source's
target; what is left of the target then follows word by word, so every source meets it at any size of its blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed

GOLDEN = 0.6180339887498949
#: The schedule has about so many slots at any size of the corpus; what they leave of a source's target is settled exactly.
SLOTS = 1 << 17
#: Sources are a mixture's parameters: a list that the driver holds. More than this is refused.
MAX_SOURCES = 100_000
#: Documents of one source that one task puts in order.
BUCKET_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    text = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(text) > 0, F.size(F.split(text, r"[\x20\x09-\x0D]+", -1))).otherwise(0).cast("long")


def targets(sizes: list[int], weights: list[float], ratio: float, cap: float) -> list[float]:
    """ratio times all sizes, shared by weight; a share stops at cap times its size and the excess is shared again."""
    want, out = ratio * sum(sizes), [0.0] * len(sizes)
    left = set(range(len(sizes)))
    while left:
        unit = want / sum(weights[i] for i in left)
        over = [i for i in left if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in left:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
        want = max(0.0, want - sum(out[i] for i in over))
        left -= set(over)
    return out


def mix(docs: DataFrame, ratio: float = 1.5, weights: tuple = (3, 1, 2), cap: float = 2.0, seed: int = 4, slots: int = SLOTS, carry: tuple = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: __row, the carried columns, source, size, source_size, target, taken (words the mix takes).

    Sources by code point, null last, weigh ``weights`` in turn. Null and empty texts have size 0 and are never
    taken; repeated rows are documents of their own; an empty table gives no rows. No document is taken more
    than ``cap`` times over when cap is a whole number. The words taken of a source are its target to the nearest whole.
    """
    spark = docs.sparkSession
    carried = [c for c in carry if c not in ("source", "size")]
    base = keyed(docs, *carried, "source", "text")
    base = cut(base.select("__row", *carried, "source", n_words(F.col("text")).alias("size")))
    found = base.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["s"] for r in found]
    share = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], ratio, cap)
    total = sum(share)
    block = max(1, int(total) // slots)
    blocks = [-(-s // block) for s in sizes]
    buckets = [max(1, r["n"] // BUCKET_ROWS) for r in found]
    table = spark.createDataFrame([(i, r["source"], sizes[i], share[i], buckets[i]) for i, r in enumerate(found)], "sid int, src string, source_size long, target double, buckets int")

    # the schedule: slot -> source -> rank -> block
    edge = np.cumsum(np.array(share)) / max(total, 1e-300)
    goal = [round(t) for t in share]
    # the slots whose blocks are within the target
    most = [t // s * b + t % s // block if s else 0 for t, s, b in zip(goal, sizes, blocks)]

    def deal(batches):
        for x in batches:
            u = np.modf((x["id"].to_numpy() + 0.5) * GOLDEN)[0]
            x["sid"] = np.minimum(np.searchsorted(edge, u, side="right"), len(edge) - 1).astype("int32")
            yield x[["id", "sid"]]

    n_slots = -(-int(np.ceil(total)) // block) if found else 0
    limits = spark.createDataFrame([(i, b, m) for i, (b, m) in enumerate(zip(blocks, most)) if b], "sid int, n_blocks long, most long")
    uses = cut(
        spark.range(n_slots).mapInPandas(deal, "id long, sid int")
        .selectExpr("sid", "row_number() over (partition by sid order by id) - 1L as rank")  # at most `slots` rows in all
        .join(F.broadcast(limits), "sid").filter("rank < most")
        .groupBy("sid", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("uses"))
    )

    # the rest of each target: the words of the source's stream, over and over, from where its slots end
    dealt = {r["sid"]: r["n"] for r in uses.groupBy("sid").agg(F.sum("uses").alias("n")).collect()}
    ends = [dealt.get(i, 0) // b * s + dealt.get(i, 0) % b * block if b else 0 for i, (s, b) in enumerate(zip(sizes, blocks))]
    rest = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(zip(ends, goal)) if e < t], "sid int, start long, stop long")

    def before(at: str) -> str:
        """Words of the document among the first ``at`` words of the endless stream."""
        return f"({at} div source_size * size + greatest(0L, least(size, {at} % source_size - at)))"


    # the stream of each source: documents in hashed order, starts by sums of hash buckets, then within a bucket
    rows = base.join(F.broadcast(table), base["source"].eqNullSafe(table["src"])).drop("src")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("__row")))
    # the bucket is a monotone function of h: its place among 2**20 equal ranges, scaled down
    rows = rows.withColumn("bucket", F.expr("cast((shiftrightunsigned(h, 44) * buckets) div 1048576 as int)"))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("s")).selectExpr("sid", "bucket", "sum(s) over (partition by sid order by bucket) - s as base")
    placed = rows.join(sums, ["sid", "bucket"]).selectExpr("*", "base + sum(size) over (partition by sid, bucket order by shiftrightunsigned(h, 1), h, __row rows unbounded preceding) - size as at")
    placed = cut(placed.select("__row", *carried, "source", "sid", "size", "source_size", "target", "at"))
    pieces = placed.filter("size > 0").select("__row", "sid", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    pieces = pieces.selectExpr("__row", "sid", "block", f"least(at + size, (block + 1) * {block}) - greatest(at, block * {block}) as words")
    taken = pieces.join(uses, ["sid", "block"]).groupBy("__row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    placed = placed.join(F.broadcast(rest), "sid", "left").withColumn("left", F.when(F.col("stop").isNotNull(), F.expr(f"{before('stop')} - {before('start')}")).otherwise(0))
    whole = F.coalesce("taken", F.lit(0)) + F.col("left")
    return placed.join(taken, "__row", "left").select("__row", *carried, "source", "size", "source_size", "target", whole.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: each row as often as its taken words fill it, to the nearest whole.

    Only the document at which a source's last pass ends is taken in part, so at most one per source is rounded.
    """
    names = docs.columns
    copies = mix(docs, carry=(), **options).selectExpr("__row", "cast(floor(coalesce(try_divide(taken, size), 0) + 0.5) as int) as __copies").filter("__copies > 0")
    rows = keyed(docs, *[f"`{c}`" for c in names])
    rows = rows.join(copies, "__row").withColumn("__copy", F.explode(F.expr("sequence(1, __copies)")))
    return rows.select([f"`{c}`" for c in names])
