"""Sharding by a two-pass external shuffle.

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash; pass 2 loads one bucket at a time,
permutes it with a seeded Fisher-Yates shuffle and hands out consecutive global ranks. Ranks are cut into shards
of equal row counts, so the order inside the shards is a uniform shuffle of all records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, keyed, tune

#: Record bytes that one bucket holds on average; what one task of pass 2 keeps in memory.
BUCKET_BYTES = 24 << 20
ROW_BYTES = 16
#: Buckets whose sizes one task sums.
GROUP = 1024


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n), the same for the same seed and bucket."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def free(docs: DataFrame, *names: str) -> DataFrame:
    """Without columns of these names, in any case of letters."""
    taken = {x.lower() for x in names}
    return docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def shuffle_into_shards(docs: DataFrame, n_shards: int = 40, seed: int = 20, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``shard`` (0 to n_shards-1), ``slot`` (place in the shard, gapless from 0).

    Law ``rows``: row counts of shards differ by one at most. Null and empty texts are records like any other;
    repeated rows stay apart; an empty table gives no rows; a ``shard`` or ``slot`` column of the input is
    replaced; a record that is larger than a bucket is in one of its own size. Runs over the same files give the same
    shards, whatever the number of cores.
    """
    spark = docs.sparkSession
    tune(spark)
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    docs = free(docs, "shard", "slot", "__row", "__bucket", "__start", "__group")
    names = docs.columns
    rows = keyed(docs, *[f"`{c}`" for c in names])
    total, size = rows.agg(F.count("*"), F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + ROW_BYTES)).first()
    n_buckets = max(1, -(-int(size or 0) // bucket_bytes))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("__row")), F.lit(n_buckets)).cast("int"))

    counts = cut(rows.groupBy("__bucket").count().withColumn("__group", F.expr(f"__bucket div {GROUP}")))
    # running sums in two levels: the one window over all has a row for each GROUP buckets, some 4,000 at 100 TB
    groups = counts.groupBy("__group").agg(F.sum("count").alias("n")).selectExpr("__group", "sum(n) over (order by __group) - n as before")
    starts = counts.join(groups, "__group").selectExpr("__bucket", "before + sum(count) over (partition by __group order by __bucket) - count as __start")

    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def settle(key, bucket, start):
        bucket = bucket.sort_by("__row")
        bucket = bucket.take(pa.array(fisher_yates(bucket.num_rows, seed, key[0].as_py())))
        # Python's integers: rank times shards may pass 64 bits
        first = start["__start"][0].as_py()
        shard = [(first + i) * n_shards // total for i in range(bucket.num_rows)]
        slot = [first + i + (-s * total // n_shards) for i, s in enumerate(shard)]
        bucket = bucket.select(names)
        return bucket.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    return rows.groupBy("__bucket").cogroup(starts.groupBy("__bucket")).applyInArrow(settle, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder ``shard=N`` per shard, rows in slot order within each file."""
    n = sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sharded.repartition(int(n), "shard", F.col("slot") % 8).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
