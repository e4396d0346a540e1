"""Tables as folders of immutable segments. A segment is one write: Parquet files and a ``_segment.json``, which is
written last, so a segment without it was never finished and no reader sees it."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SerializationError, StorageError, translated
from ..functions.types import BOOL, TableSchema
from .files import Files

SCHEMA_FILE, CONFIG_FILE, SEGMENT_FILE, LOCK_FILE, JOURNAL_FILE = "schema.json", "table.config.json", "_segment.json", ".compaction.lock", ".replace.json"
#: A lock whose holder has not renewed it for so many seconds is taken to be left behind.
LEASE_SECONDS = 120
#: Leftovers of interrupted work.
STAGING, BACKUP = ".compacting_", ".compacted_old_"
#: What an insert has written so far; nothing but that insert removes it.
INSERTING = ".inserting_"
#: Rows that one task sorts and writes at least, if there are so many; a file of a segment that is written in order has as many.
TASK_ROWS = 250_000
#: Up to so many partitions (spark.shuffle.sort.bypassMergeThreshold) a shuffle's map tasks write without buffering all their rows.
LIGHT_PARTITIONS = 200
_SEGMENT = re.compile(r"segment_([0-9]+)")
_CODECS = {"none": "none", "lz4": "lz4_raw", "zstd": "zstd"}


def task_rows(rows: int) -> int:
    """Rows for each task when a number of rows is dealt out: at most eight times TASK_ROWS, if that makes the shuffle light."""
    return max(TASK_ROWS, min(8 * TASK_ROWS, -(-rows // LIGHT_PARTITIONS)))


@dataclass(frozen=True)
class TableConfig:
    compression: str = "lz4"
    row_group_size: int = 16384
    enable_bloom_filter: bool = True
    enable_dictionary_encoding: bool = True
    compaction_segment_threshold: int = 8
    compaction_row_group_threshold: int = 8
    enable_background_compaction: bool = True
    background_compaction_interval_seconds: int = 60

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> TableConfig:
        try:
            found = json.loads(text)
            return TableConfig(**{f.name: found[f.name] for f in fields(TableConfig) if f.name in found})
        except (ValueError, TypeError) as e:
            raise SerializationError(f"Table config error: {e}") from None


@dataclass(frozen=True)
class Segment:
    number: int
    path: str
    rows: int
    row_groups: int
    size_bytes: int
    created_at: int
    #: Whether any row group but the last of a file has room left, or a file's last one may be merged with another's.
    underfilled: bool


class Table:
    """A native table: its schema and options from the sidecars, its rows from the finished segments."""

    def __init__(self, spark: SparkSession, database: str, name: str, path: str):
        self.spark, self.database, self.name, self.path = spark, database, name, path
        self.files = Files(spark)
        self.schema = TableSchema.from_json(self.files.read(f"{path}/{SCHEMA_FILE}"))
        config = f"{path}/{CONFIG_FILE}"
        self.config = TableConfig.from_json(self.files.read(config)) if self.files.exists(config) else TableConfig()

    @property
    def fqn(self) -> str:
        return f"{self.database}.{self.name}"

    def struct(self) -> T.StructType:
        return self.schema.struct()

    # --- reading

    def segments(self) -> list[Segment]:
        """Finished segments in numeric order. While a replacement is on its way, or was cut off, those that it replaces."""
        journal = self._journal()
        folders = self.files.list(self.path)
        if journal:
            aside = {e.name: e for e in self.files.list(journal["backup"])} if self.files.exists(journal["backup"]) else {}
            folders = [e for e in folders if e.name in journal["old"] and e.name not in aside] + [e for e in aside.values() if e.name in journal["old"]]
        out = []
        for e in folders:
            m = _SEGMENT.fullmatch(e.name)
            if m and e.is_dir and self.files.exists(f"{e.path}/{SEGMENT_FILE}"):
                out.append(Segment(int(m[1]), e.path, **json.loads(self.files.read(f"{e.path}/{SEGMENT_FILE}"))))
        return sorted(out, key=lambda s: s.number)

    def _journal(self) -> dict | None:
        """What a replacement that isn't committed moves: the folder that live segments go to, and their names."""
        path = f"{self.path}/{JOURNAL_FILE}"
        return json.loads(self.files.read(path)) if self.files.exists(path) else None

    def _recover(self) -> None:
        """Undoes a replacement that was cut off. The lock must be held."""
        journal = self._journal()
        if not journal:
            return
        aside = {e.name: e.path for e in self.files.list(journal["backup"])} if self.files.exists(journal["backup"]) else {}
        for e in self.files.list(self.path):
            if _SEGMENT.fullmatch(e.name) and (e.name not in journal["old"] or e.name in aside):
                self.files.delete(e.path)
        for name, path in aside.items():
            self.files.rename(path, f"{self.path}/{name}")
        self.files.delete(f"{self.path}/{JOURNAL_FILE}")
        self.refresh()

    def swap(self, old: list[str], new: dict[str, str]) -> None:
        """Puts new segments (name: staged folder) in the place of old ones (names). The lock must be held.

        A journal, written whole under another name and renamed, makes readers see the old segments until it is deleted,
        which is the commit; what is aside by then is of no use any more. Until then any writer can undo the rest.
        """
        backup = f"{self.path}/{BACKUP}{uuid.uuid4().hex}"
        self.files.mkdirs(backup)
        draft = f"{self.path}/{STAGING}journal-{uuid.uuid4().hex}"
        live = [e.name for e in self.files.list(self.path) if _SEGMENT.fullmatch(e.name)]
        self.files.write(draft, json.dumps({"backup": backup, "old": live}))
        if not self.files.rename(draft, f"{self.path}/{JOURNAL_FILE}"):
            raise StorageError("Invalid segment path")
        try:
            for name in old:
                if not self.files.rename(f"{self.path}/{name}", f"{backup}/{name}"):
                    raise StorageError("Invalid segment path")
            for name, path in new.items():
                if not self.files.rename(path, f"{self.path}/{name}"):
                    raise StorageError("Invalid staged segment path")
        except Exception:
            self._recover()
            raise
        self.files.delete(f"{self.path}/{JOURNAL_FILE}")
        self.files.delete(backup)
        self.refresh()

    def scan(self, ordered: bool = False, enough: int | None = None) -> DataFrame:
        """All rows; with columns ``__at_`` for the rows' order if asked: segment, file, row. ``enough``: the first segments that have so many rows."""
        paths, rows = [], 0
        for s in self.segments():
            if enough is not None and rows >= enough:
                break
            paths.append(s.path)
            rows += s.rows
        if not paths:
            df = self.spark.createDataFrame([], self.struct())
            return df.select("*", F.lit(0).alias("__at_0")) if ordered else df
        df = self.spark.read.schema(self.struct()).parquet(*paths)
        if not ordered:
            return df
        file = F.col("_metadata.file_path")
        number = F.regexp_extract(file, r"segment_([0-9]+)/[^/]*$", 1).cast("long")
        return df.select("*", number.alias("__at_0"), file.alias("__at_1"), F.col("_metadata.row_index").alias("__at_2"))

    # --- writing

    @contextmanager
    def lock(self) -> Iterator[None]:
        """The table's writers' lock: a file that its holder renews. One that isn't renewed any more is taken over.

        What a replacement that was cut off left is undone first.
        """
        path = f"{self.path}/{LOCK_FILE}"
        if not self.files.create_new(path):
            age = self.files.age(path)
            if age is None or age < LEASE_SECONDS:
                raise StorageError("Compaction already in progress for table")
            # of several that find it only the one that moves it goes on
            stale = f"{self.path}/{STAGING}lock-{uuid.uuid4().hex}"
            if not self.files.rename(path, stale) or not self.files.create_new(path):
                raise StorageError("Compaction already in progress for table")
            self.files.delete(stale)
        done = threading.Event()

        def renew() -> None:
            while not done.wait(LEASE_SECONDS / 4):
                with suppress(Exception):
                    self.files.touch(path)

        threading.Thread(target=renew, daemon=True).start()
        try:
            self._recover()
            yield
        finally:
            done.set()
            self.files.delete(path)

    @contextmanager
    def _writing(self, seconds: float = 30) -> Iterator[None]:
        """Like lock(), but waits for whoever holds it."""
        end = time.time() + seconds
        while True:
            try:
                held = self.lock()
                held.__enter__()
                break
            except StorageError:
                if time.time() > end:
                    raise
                time.sleep(0.1)
        try:
            yield
        finally:
            held.__exit__(None, None, None)

    def _write(self, df: DataFrame, path: str, rows_per_file: int | None = None) -> int:
        """Writes one segment below a path; its number of rows. The sidecar comes last."""
        c = self.config
        writer = df.write.option("compression", _CODECS[c.compression]).option("parquet.block.row.count.limit", c.row_group_size)
        writer = writer.option("parquet.enable.dictionary", str(c.enable_dictionary_encoding).lower())
        if c.enable_bloom_filter:
            # 4096 bytes at most: Parquet's own default is a megabyte for each column of each row group
            writer = writer.option("parquet.bloom.filter.max.bytes", 4096)
            for column in self.schema.columns:
                if column.column_type != BOOL:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{column.name}", "true")
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        try:
            writer.parquet(path)
        except Exception as e:
            self.files.delete(path)
            if (known := translated(e)) is not e:
                raise known from None
            raise
        # counted from the footers, file by file
        counts = self.spark.read.schema(self.struct()).parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).count()
        size = c.row_group_size
        total = counts.agg(
            F.sum("count").alias("rows"), F.sum(F.ceil(F.col("count") / size)).alias("groups"), F.sum((F.col("count") % size > 0).cast("int")).alias("open")
        ).first()
        rows = total["rows"] or 0
        meta = {"rows": rows, "row_groups": int(total["groups"] or 0), "size_bytes": self.files.size(path), "created_at": int(time.time() * 1000), "underfilled": (total["open"] or 0) > 1}
        self.files.write(f"{path}/{SEGMENT_FILE}", json.dumps(meta))
        return rows

    def _write_ordered(self, df: DataFrame, path: str, order: list[str]) -> int:
        """Like _write(), with the rows in ascending order over all files, nulls first, and full row groups but for the last.

        Ranges are sorted and written first, then dealt by rank: tasks have some task_rows(), but for those of one value of the
        columns, which stay together while they are sorted.
        """
        total = df.count()
        tasks = -(-total // task_rows(total))
        if tasks <= 1:
            return self._write(df.repartition(1).sortWithinPartitions(*order), path)
        ranges = f"{path}_ranges"
        try:
            try:
                df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.parquet(ranges)
            except Exception as e:
                if (known := translated(e)) is not e:
                    raise known from None
                raise
            file = F.col("_metadata.file_path")
            marked = self.spark.read.schema(df.schema).parquet(ranges).select("*", file.alias("__at_0"), file.alias("__at_1"), F.col("_metadata.row_index").alias("__at_2"))
            size = self.config.row_group_size
            return self._write(self.dealt(marked, total, size), path)
        finally:
            self.files.delete(ranges)

    def dealt(self, marked: DataFrame, total: int, unit: int, most: int | None = None) -> DataFrame:
        """The rows of a scan with ``__at_`` columns in their order; each task but the last has full units of rows, ``most`` of them at most.

        A row's rank is its place in its file and the rows of the files before it, so rows are dealt without a sort of them all.
        """
        units = -(-task_rows(total) // unit)
        rows_per_task = unit * min(units, most or units)
        by = ["__at_0", "__at_1"]
        files = marked.groupBy(by).agg(F.count("*").alias("n"))
        before = files.selectExpr(*by, "sum(n) over (order by __at_0, __at_1) - n as __before")  # a row per file
        ranked = marked.join(F.broadcast(before), by).withColumn("__rank", F.col("__before") + F.col("__at_2")).drop(*by, "__at_2", "__before")
        dealt = ranked.withColumn("__task", F.expr(f"cast(__rank div {rows_per_task} as int)"))
        return dealt.repartitionById(max(1, -(-total // rows_per_task)), "__task").sortWithinPartitions("__rank").select([f"`{c.name}`" for c in self.schema.columns])

    def _next_number(self) -> int:
        return max((s.number for s in self.segments()), default=-1) + 1

    def append(self, df: DataFrame, order: list[str] | None = None) -> int:
        """Adds the rows as one segment, in an order if asked: all of them or, on any error, none. Nothing to write makes no segment."""
        staged = f"{self.path}/{INSERTING}{uuid.uuid4().hex}"
        rows = self._write_ordered(df, staged, order) if order else self._write(df, staged)
        try:
            if rows:
                with self._writing():
                    self.files.rename(staged, f"{self.path}/segment_{self._next_number()}")
        finally:
            if self.files.exists(staged):
                self.files.delete(staged)
        self.refresh()
        return rows

    def insert_rows(self, rows: list[list]) -> int:
        """Rows that the driver holds, coerced by the schema."""
        checked = [self.schema.coerce_row(r) for r in rows]
        if not checked:
            return 0
        return self.append(self.spark.createDataFrame(checked, self.struct()).coalesce(1))

    def replace(self, df: DataFrame, rows_per_segment: int | None = None) -> int:
        """Puts the rows in the place of all segments, by a swap with staged ones. The lock must be held.

        ``rows_per_segment`` writes files of so many rows, each of which becomes a segment of its own.
        """
        for e in self.files.list(self.path):
            if e.name.startswith((STAGING, BACKUP)):
                self.files.delete(e.path)
        staged = f"{self.path}/{STAGING}{uuid.uuid4().hex}"
        rows = self._write(df, staged, rows_per_segment)
        first = self._next_number()
        new = self._as_segments(staged, bool(rows_per_segment)) if rows else []
        live = [e.name for e in self.files.list(self.path) if _SEGMENT.fullmatch(e.name)]
        try:
            self.swap(live, {f"segment_{first + i}": path for i, path in enumerate(new)})
        finally:
            self.files.delete(staged)
        return rows

    def _as_segments(self, staged: str, split: bool) -> list[str]:
        if not split:
            self.files.mkdirs(f"{staged}_all")
            self.files.rename(staged, f"{staged}_all/segment")
            self.files.rename(f"{staged}_all", staged)
            return [f"{staged}/segment"]
        counts = self.spark.read.parquet(staged).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()  # one row per segment
        out = []
        for r in sorted(counts, key=lambda r: r["f"]):
            folder = f"{staged}/s_{len(out)}"
            self.files.mkdirs(folder)
            self.files.rename(f"{staged}/{r['f']}", f"{folder}/{r['f']}")
            groups = -(-r["count"] // self.config.row_group_size)
            meta = {"rows": r["count"], "row_groups": groups, "size_bytes": self.files.size(folder), "created_at": int(time.time() * 1000), "underfilled": False}
            self.files.write(f"{folder}/{SEGMENT_FILE}", json.dumps(meta))
            out.append(folder)
        return out

    def delete_where(self, condition) -> int:
        """Rewrites what survives; rows for which the condition is not true stay. None deletes all."""
        with self._writing():
            before = sum(s.rows for s in self.segments())
            if condition is None:
                self._clear()
                return before
            if not before:
                return 0
            kept = self.replace(self.scan().filter(~F.coalesce(condition, F.lit(False))))
            return before - kept

    def _clear(self) -> None:
        for e in self.files.list(self.path):
            if _SEGMENT.fullmatch(e.name):
                self.files.delete(e.path)
        self.refresh()

    def clear(self) -> None:
        with self._writing():
            self._clear()

    def refresh(self) -> None:
        self.spark.catalog.refreshByPath(self.path)


class ExternalTable:
    """Parquet files that the engine reads and never writes; their Spark types pass through."""

    def __init__(self, spark: SparkSession, database: str, name: str, path: str):
        self.spark, self.database, self.name, self.path = spark, database, name, path
        self._struct: T.StructType | None = None

    @property
    def fqn(self) -> str:
        return f"{self.database}.{self.name}"

    def struct(self) -> T.StructType:
        if self._struct is None:
            self._struct = self.spark.read.parquet(self.path).schema
        return self._struct

    def scan(self, ordered: bool = False, enough: int | None = None) -> DataFrame:
        df = self.spark.read.schema(self.struct()).parquet(self.path)
        if not ordered:
            return df
        return df.select("*", F.col("_metadata.file_path").alias("__at_0"), F.col("_metadata.row_index").alias("__at_1"))
