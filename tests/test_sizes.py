"""Registered queries over tables that are larger than the ones of sf0.01, and the steps that have to stay small then."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from colonnade.catalogue import ORACLE, QUERIES, TABLES
from colonnade.errors import StorageError
from colonnade.functions.types import U32, UTF8, ColumnSchema, TableSchema
from colonnade.native_catalogue import _filled
from colonnade.sources.maintenance import column_stats, maybe_compact, needs_compaction, optimize
from colonnade.sources.storage import TableConfig

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
ORDERS = 40_000


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """The tables of sf0.01 with more orders, whose keys are shuffled."""
    path = tmp_path_factory.mktemp("larger")
    for t in TABLES:
        if t != "orders":
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    key = F.col("id") * 7919 % ORDERS
    orders = spark.range(0, ORDERS, 1, 3).select(key.alias("o_orderkey"), (key % 1500).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (key % 3 + 1).cast("int")).alias("o_orderstatus"), (key * 17 % 300_000).cast("double").alias("o_totalprice"))
    orders.write.parquet(str(path / "orders.parquet"))
    return str(path)


def same(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet{'/*.parquet' * (t == 'orders')}'")
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLE[name]})").fetchall()
    key = lambda r: [(x is None, x if x is not None else 0) for x in r]
    assert sorted(map(tuple, df.select(names).collect()), key=key) == sorted(want, key=key)


def full_segments(session, n, rows, config):
    """A table of so many segments whose row groups are full."""
    session.execute("CREATE DATABASE t")
    made = session.catalog.create_table("t.c", TableSchema((ColumnSchema("id", U32),)), config)
    for i in range(n):
        made.insert_rows([[i * rows + j] for j in range(rows)])
    return made


def test_optimize_splits_segments_that_are_too_large(session):
    made = full_segments(session, 2, 8, TableConfig(row_group_size=2, compaction_row_group_threshold=2))
    report = optimize(made)
    assert (report.input_segments, report.output_segments, report.rows_rewritten, report.skipped) == (2, 4, 16, False)
    assert [r["id"] for r in session.query("FROM t.c\nLIMIT 99").collect()] == list(range(16)) and optimize(made).skipped


def test_a_compacted_table_needs_no_compaction_whatever_its_size(session):
    made = full_segments(session, 3, 5, TableConfig(row_group_size=2, compaction_row_group_threshold=2, compaction_segment_threshold=3))
    assert needs_compaction(made) and maybe_compact(made).output_segments == 4
    assert not needs_compaction(made) and maybe_compact(made) is None


@needs_tables
@pytest.mark.parametrize("name", ["compaction", "background_compaction"])
def test_compaction(spark, larger, name):
    same(spark, larger, name)


def test_rows_are_written_in_order_by_several_tasks(session, spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr("colonnade.sources.storage.TASK_ROWS", 100)
    session.execute("CREATE DATABASE t")
    made = session.catalog.create_table("t.o", TableSchema((ColumnSchema("name", UTF8, True), ColumnSchema("id", U32))), TableConfig(row_group_size=30))
    ids = spark.range(0, 1000, 1, 7).select((F.col("id") * 331 % 1000).alias("id"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("name"))
    assert made.append(ids, ["id"]) == 1000
    (segment,) = made.segments()
    assert (segment.rows, segment.row_groups, segment.underfilled) == (1000, 34, False)
    assert [r["id"] for r in session.query("FROM t.o\nSELECT id\nLIMIT 2000").collect()] == list(range(1000))
    assert session.query("FROM t.o\nFILTER name = \"x\"").count() == 666
    files = sorted((tmp_path / "data/t/o/segment_0").glob("*.parquet"))
    groups = [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in (pq.ParquetFile(f).metadata for f in files)]
    assert groups == [[30, 30, 30, 30]] * 8 + [[30, 10]]
    assert sorted(e.name for e in made.files.list(made.path)) == ["schema.json", "segment_0", "table.config.json"]
    with pytest.raises(StorageError, match="too large"):
        made.append(ids.select(F.raise_error(F.lit("<<S|too large>>")).cast("string").alias("name"), "id"), ["id"])
    assert sorted(e.name for e in made.files.list(made.path)) == ["schema.json", "segment_0", "table.config.json"]
    assert made.append(ids.filter("id > 5000"), ["id"]) == 0 and len(made.segments()) == 1


@needs_tables
def test_no_task_writes_all_orders(spark, larger, monkeypatch):
    monkeypatch.setattr("colonnade.sources.storage.TASK_ROWS", 5_000, raising=False)
    session = _filled(spark, larger, 2, TableConfig(row_group_size=500))
    rows = session.catalog.resolve_native("work.ord").scan().groupBy(F.col("_metadata.file_path")).count()
    assert sorted(r["count"] for r in rows.collect()) == [5_000] * 8
    for name in ("meta_segments", "pruned_scan", "mixed_keys", "null_order"):
        same(spark, larger, name)


def test_statistics_deal_out_distinct_values(session, spark, tmp_path, monkeypatch):
    monkeypatch.setattr("colonnade.sources.storage.TASK_ROWS", 100, raising=False)
    n = F.col("id")
    rows = spark.range(0, 1000, 1, 2).select(n.alias("a.b"), F.when(n < 900, n % 7).alias("few"), F.when(n % 2 == 0, F.concat(F.lit("t"), n)).alias("text"), F.array(n % 2).alias("list"), F.when(n % 3 > 0, (n % 5).cast("double")).alias("f"), F.lit(None).cast("string").alias("none"))
    rows.write.parquet(str(tmp_path / "in"))
    spark.sparkContext.setJobGroup("stats", "stats")
    try:
        got = [(c.name, c.least, c.most, c.null_count, c.distinct_sum) for c in column_stats(session.catalog.register_parquet("x.t", str(tmp_path / "in")))]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # two files of 500 rows, each of them one row group
    assert got == [("a.b", 0, 999, 0, 1000), ("few", 0, 6, 100, 14), ("text", "t0", "t998", 500, 500), ("list", None, None, 0, 4), ("f", 0.0, 4.0, 334, 10), ("none", None, None, 0, 0)]
    tracker = spark.sparkContext.statusTracker()
    stages = {i: tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("stats") for i in tracker.getJobInfo(j).stageIds}
    assert sum(s.numTasks == 10 for s in stages.values() if s) >= len(got)


@needs_tables
def test_meta_optimize(spark, larger):
    same(spark, larger, "meta_optimize")
