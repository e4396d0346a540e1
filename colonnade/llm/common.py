"""What the pipeline operators share: row keys, shared storage, connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: ``[\x20\x09-\x0D]``; also what ``bytes.split()`` splits at.
SPACE = b" \t\n\x0b\x0c\r"

#: A list of files is broadcast up to so many paths, else joined.
BROADCAST_ROWS = 200_000

#: Bytes that a broadcast side may have, by its count and the width given for a row.
BROADCAST_BYTES = 16 << 20

#: Edges whose components one task finds at once; more are contracted in rounds. Changes costs only, no result.
FEW_EDGES = 250_000

#: A row's key is the rank of its file above so many bits of its place in it, as in Spark's own increasing ids.
PLACE_BITS = 33

#: Rows per Arrow batch: keeps a batch of very long texts small.
ARROW_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, because one text may hold megabytes. The setting holds until the result is read, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = sc._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="colonnade-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to the shared folder and reads them from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Frames made within lose their shuffle files as soon as an action on them ends, not when the driver collects garbage.

    Each task of a shuffle leaves three files, so many steps over few rows fill a disk by their number. Only for frames
    that are written or counted within: what is read later computes its shuffles anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def small(df: DataFrame, row_bytes: int = 40) -> DataFrame:
    """With a broadcast hint if it is counted to have at most BROADCAST_BYTES at that width of a row; for tables that are already written."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Spool:
    """A compressed Parquet table in the shared folder, deleted by ``drop()`` once everything read from it is written."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        """``by``: a column that gets a folder for each of its values."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/colonnade-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)

    def drop_at_exit(self) -> Spool:
        def drop() -> None:
            with contextlib.suppress(Exception):  # the session may be stopped already
                self.drop()

        atexit.register(drop)
        return self


def _file_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` stands for one row of a Parquet table, the same one whenever it is read: a scan below projections and filters that always give the same."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return node.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def keyed(docs: DataFrame, *columns: str | Column, key: str = "__row") -> DataFrame:
    """The columns and a key for each row, so that repeated rows and repeated or null ids stay apart.

    The key of a row of Parquet files is the rank of its file's path and its place in that file, so it does not depend
    on how a scan is cut into tasks, and runs over the same files agree. Other inputs are written to the shared folder
    first; there a key is a row's place among the files written. The bits above ``PLACE_BITS`` are the file.
    """
    if not _file_scan(docs):
        return cut(docs.select(*columns)).withColumn(key, F.monotonically_increasing_id())
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(*columns, meta["row_index"].alias("__place"), meta["file_path"].alias("__file"))
    names = rows.columns[:-2]
    files = sorted(docs.inputFiles())
    if len(files) > 1:
        # paths of local files come with one or three slashes
        paths = {p: i for i, f in enumerate(files) for p in (f, re.sub("^file:/+", "file:/", f))}
        table = docs.sparkSession.createDataFrame(pa.table({"__path": list(paths), "__rank": pa.array(paths.values(), pa.int64())}))
        # the driver holds the list of files anyway
        rows = rows.join(F.broadcast(table) if len(paths) <= BROADCAST_ROWS else table, F.col("__file") == F.col("__path"), "left")
        rank = F.coalesce("__rank", F.raise_error(F.lit("a file came after the list of files was made")).cast("long"))
    else:
        rank = F.lit(0).cast("long")
    return rows.select(*[F.col(f"`{c}`") for c in names], F.shiftleft(rank, PLACE_BITS).bitwiseOR(F.col("__place")).alias(key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components_at_once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of each node of the undirected edges that isn't the smallest of its component."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(node)))  # nodes ascend, so the least of a component is its root

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    least = node[np.fromiter((root(x) for x in range(len(node))), np.int64, len(node))]
    return node[node != least], least[node != least]


def components(edges: DataFrame, rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, component) of each node of the undirected edges (a, b) but the smallest of a component, which is the component.

    Up to ``few`` distinct edges of long nodes are gathered in one task. For more it alternates large-star and small-star
    steps; each is a grouped minimum and a join, and the edge table is cut after each round. Ends when a round changes nothing.

    Each node points at a smaller one at the end, so no step gathers a node's neighbours into one task: the
    minimum is pre-aggregated and the join may be split.
    """
    def settled(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def at_once(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(parts, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        found = components_at_once(held["a"].to_numpy(), held["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if few and edges.count() <= few:
        return edges.coalesce(1).mapInArrow(at_once, "node long, component long")
    last = settled(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select("a", "b", "m")
        edges = edges.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = cut(edges)
        now = settled(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
