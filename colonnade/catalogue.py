"""Registered queries of the engine's own operators, and the SQL that gives the same rows.

The tables of a folder are external tables of the database ``tpch``. Queries are text or builders that go through
the parser, the binder and the compiler; those that write do so below a scratch folder of their own.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native_catalogue
from .functions.aggregates import avg, global_aggregate, group_by_multi_key, sum_
from .functions.types import I32, U32, UTF8, ColumnSchema, TableSchema
from .plans.expr import col
from .plans.logical import OrderBy, agg_ref, aql, scan
from .session import Session
from .sources.maintenance import column_stats, optimize, vacuum
from .sources.storage import TableConfig

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, or a temporary one where none is set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="colonnade-")
    return f"{shared.rstrip('/')}/colonnade-{uuid.uuid4().hex}"


def open_session(spark: SparkSession, sf_dir: str, root: str | None = None) -> Session:
    session = Session(spark, root or _scratch(spark))
    for t in TABLES:
        session.catalog.register_parquet(f"tpch.{t}", f"{sf_dir}/{t}.parquet")
    return session


#: Queries as text, and their SQL.
TEXT: dict[str, tuple[str, str]] = {
    "flagship": (
        """FROM tpch.lineitem
        FILTER l_linenumber > 2
        GROUP BY l_returnflag
        AGG SUM(l_linenumber)
        GROUP FILTER SUM(l_linenumber) > 100
        SELECT l_returnflag, sum_l_linenumber
        ORDER BY SUM(l_linenumber) DESC
        LIMIT 10""",
        "select l_returnflag, cast(coalesce(sum(l_linenumber), 0) as int) as sum_l_linenumber from lineitem where l_linenumber > 2 group by 1 having sum(l_linenumber) > 100 order by 2 desc limit 10",
    ),
    "scan_all": ("FROM tpch.region", "select * from region"),
    "scan_project": ("FROM tpch.nation\nSELECT n_nationkey, n_name", "select n_nationkey, n_name from nation"),
    "project_star": ("FROM tpch.supplier\nSELECT *", "select * from supplier"),
    "filter_eq": ("FROM tpch.lineitem\nFILTER l_linenumber = 3\nSELECT l_orderkey, l_linenumber, l_quantity", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_linenumber = 3"),
    "filter_unselected": ("FROM tpch.part\nSELECT p_partkey\nFILTER p_size < 3", "select p_partkey from part where p_size < 3"),
    "filter_gt_and_lt": ("FROM tpch.part\nSELECT p_partkey, p_size\nFILTER p_size > 10 AND p_size < 20", "select p_partkey, p_size from part where p_size > 10 and p_size < 20"),
    "filter_lines": ("FROM tpch.part\nSELECT p_partkey, p_size\nFILTER p_size > 10\nFILTER p_size < 20\nFILTER p_partkey < 900", "select p_partkey, p_size from part where p_size > 10 and p_size < 20 and p_partkey < 900"),
    "filter_or_paren": ("FROM tpch.part\nSELECT p_partkey, p_size\nFILTER (p_size = 1 OR p_size = 50) AND p_partkey > 100", "select p_partkey, p_size from part where (p_size = 1 or p_size = 50) and p_partkey > 100"),
    "filter_precedence": ("FROM tpch.part\nSELECT p_partkey, p_size\nFILTER p_size = 1 OR p_size = 50 AND p_partkey > 100", "select p_partkey, p_size from part where p_size = 1 or p_size = 50 and p_partkey > 100"),
    "filter_string_eq": ('FROM tpch.customer\nSELECT c_custkey, c_mktsegment\nFILTER c_mktsegment = "BUILDING"', "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'"),
    "filter_string_gt": ('FROM tpch.part\nSELECT p_partkey, p_brand\nFILTER p_brand > "Brand#3"', "select p_partkey, p_brand from part where p_brand > 'Brand#3'"),
    "filter_literal_first": ("FROM tpch.part\nSELECT p_partkey\nFILTER 45 < p_size", "select p_partkey from part where 45 < p_size"),
    "filter_columns": ("FROM tpch.lineitem\nSELECT l_orderkey, l_partkey, l_suppkey\nFILTER l_partkey < l_suppkey", "select l_orderkey, l_partkey, l_suppkey from lineitem where l_partkey < l_suppkey"),
    "group_sum": ("FROM tpch.lineitem\nGROUP BY l_returnflag\nAGG SUM(l_linenumber)", "select l_returnflag, cast(coalesce(sum(l_linenumber), 0) as int) as sum_l_linenumber from lineitem group by 1"),
    "group_sum_double": ("FROM tpch.lineitem\nGROUP BY l_linenumber\nAGG MAX(l_quantity)", "select l_linenumber, coalesce(max(l_quantity), 0) as max_l_quantity from lineitem group by 1"),
    "group_sum_long": ("FROM tpch.orders\nGROUP BY o_orderstatus\nAGG SUM(o_custkey)", "select o_orderstatus, cast(coalesce(sum(o_custkey), 0) as bigint) as sum_o_custkey from orders group by 1"),
    "group_count_multikey": ("FROM tpch.lineitem\nGROUP BY l_returnflag, l_linestatus\nAGG COUNT(l_linenumber)", "select l_returnflag, l_linestatus, cast(count(l_linenumber) as int) as count_l_linenumber from lineitem group by 1, 2"),
    "group_count_string": ("FROM tpch.customer\nGROUP BY c_nationkey\nAGG COUNT(c_name)", "select c_nationkey, cast(count(c_name) as int) as count_c_name from customer group by 1"),
    "group_avg_trunc": (
        "FROM tpch.lineitem\nGROUP BY l_returnflag\nAGG AVG(l_linenumber)",
        "select l_returnflag, cast(case when count(l_linenumber) = 0 then 0 else trunc(sum(l_linenumber) / count(l_linenumber)) end as int) as avg_l_linenumber from lineitem group by 1",
    ),
    "group_min": ("FROM tpch.part\nGROUP BY p_brand\nAGG MIN(p_size)", "select p_brand, cast(coalesce(min(p_size), 0) as int) as min_p_size from part group by 1"),
    "group_max": ("FROM tpch.part\nGROUP BY p_brand\nAGG MAX(p_size)", "select p_brand, cast(coalesce(max(p_size), 0) as int) as max_p_size from part group by 1"),
    "group_filter": ("FROM tpch.part\nGROUP BY p_brand\nAGG SUM(p_size)\nGROUP FILTER SUM(p_size) > 1000", "select p_brand, cast(coalesce(sum(p_size), 0) as int) as sum_p_size from part group by 1 having sum(p_size) > 1000"),
    "group_filter_lines": (
        "FROM tpch.part\nGROUP BY p_brand\nAGG SUM(p_size)\nGROUP FILTER sum_p_size > 1000\nGROUP FILTER SUM(p_size) < 2500",
        "select p_brand, cast(coalesce(sum(p_size), 0) as int) as sum_p_size from part group by 1 having sum(p_size) > 1000 and sum(p_size) < 2500",
    ),
    "group_hidden_sort": (
        "FROM tpch.part\nSELECT p_brand\nGROUP BY p_brand\nAGG SUM(p_size)\nORDER BY SUM(p_size) DESC, p_brand\nLIMIT 5",
        "select p_brand from part group by p_brand order by sum(p_size) desc, p_brand limit 5",
    ),
    "group_first_groups": ("FROM tpch.part\nGROUP BY p_brand\nAGG COUNT(p_size)\nLIMIT 4", "select p_brand, cast(count(p_size) as int) as count_p_size from part group by 1 order by p_brand nulls last limit 4"),
    "join_null_safe": (
        "FROM tpch.customer\nJOIN tpch.orders ON c_custkey = o_custkey\nSELECT c_custkey, o_orderkey, o_totalprice",
        "select c_custkey, o_orderkey, o_totalprice from customer join orders on c_custkey is not distinct from o_custkey",
    ),
    "join_all_columns": (
        "FROM tpch.nation\nJOIN tpch.region ON n_regionkey = r_regionkey",
        'select n_nationkey as "tpch.nation.n_nationkey", n_name as "tpch.nation.n_name", n_regionkey as "tpch.nation.n_regionkey", r_regionkey as "tpch.region.r_regionkey", r_name as "tpch.region.r_name" from nation join region on n_regionkey is not distinct from r_regionkey',
    ),
    "join_chain": (
        "FROM tpch.customer\nJOIN tpch.nation ON c_nationkey = n_nationkey\nJOIN tpch.region ON n_regionkey = r_regionkey\nSELECT c_custkey, n_name, r_name",
        "select c_custkey, n_name, r_name from customer join nation on c_nationkey is not distinct from n_nationkey join region on n_regionkey is not distinct from r_regionkey",
    ),
    "join_filter_sort": (
        'FROM tpch.orders\nJOIN tpch.customer ON tpch.orders.o_custkey = tpch.customer.c_custkey\nSELECT o_orderkey, c_name\nFILTER c_mktsegment = "BUILDING" AND o_orderkey < 2000\nORDER BY o_orderkey DESC\nLIMIT 20',
        "select o_orderkey, c_name from orders join customer on o_custkey is not distinct from c_custkey where c_mktsegment = 'BUILDING' and o_orderkey < 2000 order by o_orderkey desc nulls first limit 20",
    ),
    "join_group": (
        "FROM tpch.customer\nJOIN tpch.nation ON c_nationkey = n_nationkey\nGROUP BY n_name\nAGG COUNT(c_custkey)\nSELECT n_name, count_c_custkey",
        "select n_name, count(c_custkey) as count_c_custkey from customer join nation on c_nationkey is not distinct from n_nationkey group by 1",
    ),
    "join_group_filter": (
        "FROM tpch.lineitem\nJOIN tpch.part ON l_partkey = p_partkey\nGROUP BY p_brand\nAGG SUM(l_linenumber)\nGROUP FILTER SUM(l_linenumber) > 100\nSELECT p_brand, sum_l_linenumber",
        "select p_brand, cast(sum(l_linenumber) as int) as sum_l_linenumber from lineitem join part on l_partkey is not distinct from p_partkey group by 1 having sum(l_linenumber) > 100",
    ),
    "sort_limit_offset": (
        "FROM tpch.part\nSELECT p_partkey, p_size\nORDER BY p_size DESC, p_partkey\nLIMIT 10\nOFFSET 5",
        "select p_partkey, p_size from part order by p_size desc nulls first, p_partkey asc nulls last limit 10 offset 5",
    ),
    "sort_multi": ("FROM tpch.nation\nSELECT n_regionkey, n_name\nORDER BY n_regionkey ASC, n_name DESC", "select n_regionkey, n_name from nation order by n_regionkey nulls last, n_name desc nulls first"),
    "skip_only": ("FROM tpch.nation\nSELECT n_nationkey\nORDER BY n_nationkey\nSKIP 20", "select n_nationkey from nation order by n_nationkey offset 20"),
    "limit_zero": ("FROM tpch.nation\nLIMIT 0", "select * from nation limit 0"),
}


def _text_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: open_session(spark, sf_dir).query(text)


def builder_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = aql().from_("tpch.part").filter(col("p_size").gt(10)).group_by("p_brand").agg(sum_("p_size")).group_filter(agg_ref("sum", "p_size").gt(500))
    return open_session(spark, sf_dir).query(query.select("p_brand", "sum_p_size").order_by(OrderBy(col("sum_p_size"), True), "p_brand").limit(7).offset(1))


def plan_global_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan without keys, which text can't say: one row."""
    return open_session(spark, sf_dir).query(scan("tpch.lineitem").filter(col("l_linenumber").gt(3)).aggregate([], "l_linenumber", "AVG"))


def library_global_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.createDataFrame([(float(global_aggregate(df, "p_size", "AVG")), int(global_aggregate(df, "p_size", "SUM")), int(global_aggregate(df, "p_size", "MIN")))], "avg_p_size double, sum_p_size bigint, min_p_size bigint")


def library_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by_multi_key(spark.read.parquet(f"{sf_dir}/customer.parquet"), ["c_nationkey", "c_mktsegment"], "c_custkey", "COUNT")


PART = TableSchema((ColumnSchema("p_partkey", U32), ColumnSchema("p_brand", UTF8, True), ColumnSchema("p_size", I32, True)))


def _native_part(spark: SparkSession, sf_dir: str, parts: int = 1, config: TableConfig | None = None) -> Session:
    """A session with ``work.part``, filled from the external table in so many segments."""
    session = open_session(spark, sf_dir)
    session.execute("CREATE DATABASE work")
    table = session.catalog.create_table("work.part", PART, config)
    source = session.catalog.resolve("tpch.part").scan().select(F.col("p_partkey"), "p_brand", "p_size")
    for i in range(parts):
        table.append(source.filter(F.col("p_partkey") % parts == i).coalesce(1))
    return session


def native_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _native_part(spark, sf_dir, 3).query("FROM work.part\nSELECT p_partkey, p_brand\nFILTER p_size = 7")


def delete_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _native_part(spark, sf_dir)
    session.execute("DELETE FROM work.part FILTER p_size > 25")
    return session.query("FROM work.part")


def optimized_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after compaction of many small segments, and vacuum."""
    session = _native_part(spark, sf_dir, 9, TableConfig(row_group_size=256, compression="zstd"))
    table = session.catalog.resolve_native("work.part")
    optimize(table)
    vacuum(table)
    return session.query("FROM work.part\nGROUP BY p_brand\nAGG MAX(p_size)")


def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = open_session(spark, sf_dir)
    session.execute("CREATE DATABASE work")
    session.execute("CREATE TABLE work.t (id U32, name Utf8 NULL, ok Bool, n I32 NULLABLE) USING CONFIG (compression = \"none\", row_group_size = 2, bloom_filter = false)")
    session.execute('INSERT INTO work.t ROWS (4294967295, "a, (b)", "TRUE", "-12"), ("7", null, 0, null)')
    session.execute('INSERT INTO ROWS (8, true, 1, "+5")')
    return session.query("FROM work.t")


def ingested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a line of JSON each, ingested and read again."""
    session = open_session(spark, sf_dir)
    session.execute("CREATE DATABASE work")
    session.execute("CREATE TABLE work.nation (n_nationkey I32, n_name Utf8, big Bool)")
    path = f"{session.catalog.root}/nation.json"
    rows = session.catalog.resolve("tpch.nation").scan().select("n_nationkey", "n_name", (F.col("n_nationkey") > 12).alias("big"))
    rows.coalesce(1).write.json(path)
    session.execute(f'INGEST INTO work.nation FROM "{path}"')
    return session.query("FROM work.nation")


def ingested_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = open_session(spark, sf_dir)
    session.execute("CREATE DATABASE work")
    session.execute("CREATE TABLE work.t (id I32, label Utf8 NULL)")
    path = f"{session.catalog.root}/rows.json"
    session.catalog.files.write(path, json.dumps([{"id": "12", "label": 3}, [13, None], {"id": 14, "extra": 1}], indent=1))
    session.execute(f'INGEST INTO work.t FROM "{path}"')
    return session.query("FROM work.t")


def stats_min_max_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {c.name: c for c in column_stats(open_session(spark, sf_dir).catalog.resolve("tpch.part"))}["p_size"]
    return spark.createDataFrame([(found.least, found.most, found.null_count)], "least int, most int, null_count bigint")


def plan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical and the physical plan that EXPLAIN shows, a row each."""
    text = open_session(spark, sf_dir).meta("explain FROM tpch.part").content
    return spark.createDataFrame([(line,) for line in text.splitlines() if line.startswith("Scan(")], "step string")


_FUNCTIONS: dict[Callable[[SparkSession, str], DataFrame], str] = {
    builder_query: "select p_brand, cast(sum(p_size) as int) as sum_p_size from part where p_size > 10 group by 1 having sum(p_size) > 500 order by 2 desc, 1 limit 7 offset 1",
    plan_global_aggregate: "select cast(trunc(sum(l_linenumber) / count(*)) as int) as avg_l_linenumber from lineitem where l_linenumber > 3",
    library_global_aggregate: "select avg(p_size) as avg_p_size, cast(sum(p_size) as bigint) as sum_p_size, cast(min(p_size) as bigint) as min_p_size from part",
    library_group_by: "select coalesce(cast(c_nationkey as varchar), 'NULL') as c_nationkey, c_mktsegment, count(c_custkey) as result from customer group by 1, 2",
    native_scan: "select p_partkey, p_brand from part where p_size = 7",
    delete_survivors: "select p_partkey, p_brand, p_size from part where not coalesce(p_size > 25, false)",
    optimized_table: "select p_brand, cast(coalesce(max(p_size), 0) as int) as max_p_size from part group by 1",
    inserted_rows: "select * from (values (cast(4294967295 as bigint), 'a, (b)', true, -12), (7, null, false, null), (8, 'true', true, 5)) t(id, name, ok, n)",
    ingested_json: "select n_nationkey, n_name, n_nationkey > 12 as big from nation",
    ingested_array: "select * from (values (12, '3'), (13, null), (14, null)) t(id, label)",
    stats_min_max_null: "select min(p_size) as least, max(p_size) as most, count(*) - count(p_size) as null_count from part",
    plan_text: "select * from (values ('Scan(tpch.part)'), ('Scan(table=tpch.part)')) t(step)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _text_query(text) for name, (text, _) in TEXT.items()} | {f.__name__: f for f in _FUNCTIONS} | native_catalogue.QUERIES
ORACLE: dict[str, str] = {name: sql for name, (_, sql) in TEXT.items()} | {f.__name__: sql for f, sql in _FUNCTIONS.items()} | native_catalogue.ORACLE

__all__ = ["ORACLE", "QUERIES", "avg", "open_session"]
