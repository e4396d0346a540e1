"""Registered queries over native tables with nulls, over writes and maintenance, and over commands, messages, server and shell.

Each returns rows that SQL gives from the test tables, so that what a command or a client shows is compared, too.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import messages as M
from .errors import EngineError
from .functions.aggregates import group_by_multi_key
from .functions.types import BOOL, I32, U32, UTF8, ColumnSchema, TableSchema
from .plans.expr import col
from .plans.logical import scan
from .plans.parser import parse_aql
from .printer import Settings, result_set
from .server import Client, LocalClient, Server
from .session import Session
from .shell import Shell
from .sources.maintenance import compact_segment, maybe_compact, needs_compaction
from .sources.storage import TableConfig
from .streaming.background import BackgroundCompaction

#: Orders with nulls in three columns and numbers of both signs; customers of whom every fortieth has no key.
ORDERS = """select cast(o_orderkey as int) as k, cast(case when o_orderkey % 7 = 0 then null else o_custkey end as int) as cust,
  case when o_orderkey % 5 = 0 then null else o_orderstatus end as tag, case when o_orderkey % 3 = 0 then null else o_totalprice > 150000 end as big, cast(o_orderkey % 11 - 6 as int) as v from orders"""
CUSTOMERS = "select cast(case when c_custkey % 40 = 0 then null else c_custkey end as int) as id, c_mktsegment as seg from customer where c_custkey <= 200"
_ORD = TableSchema((ColumnSchema("k", I32, False), ColumnSchema("cust", I32, True), ColumnSchema("tag", UTF8, True), ColumnSchema("big", BOOL, True), ColumnSchema("v", I32, False)))
_CUST = TableSchema((ColumnSchema("id", I32, True), ColumnSchema("seg", UTF8, False)))


def _open(spark: SparkSession, sf_dir: str) -> Session:
    from .catalogue import open_session

    session = open_session(spark, sf_dir)
    session.execute("CREATE DATABASE work")
    return session


def _rows(session: Session, sql: str) -> DataFrame:
    """SQL over the external tables of a session, evaluated by Spark as the source of a native table."""
    name = re.search(r"from (\w+)", sql)[1]
    return session.spark.sql(sql.replace(f"from {name}", "from {source}"), source=session.catalog.resolve(f"tpch.{name}").scan())


def _filled(spark: SparkSession, sf_dir: str, parts: int = 1, config: TableConfig | None = None) -> Session:
    """A session with ``work.ord``, in so many segments, and ``work.cust``."""
    session = _open(spark, sf_dir)
    table = session.catalog.create_table("work.ord", _ORD, config)
    source = _rows(session, ORDERS)
    for i in range(parts):
        table.append(source.filter(F.col("k") % parts == i), ["k"])
    session.catalog.create_table("work.cust", _CUST).append(_rows(session, CUSTOMERS).coalesce(1))
    return session


def _shown(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _cells(text: str) -> list[list[str]]:
    """The rows of a text table, without its head."""
    return [[c.strip() for c in line.strip("|").split("|")] for line in text.splitlines() if line.startswith("|")][1:]


def _numbers(text: str, *names: str) -> tuple[int, ...]:
    return tuple(int(re.search(rf"^{n}: (\d+)", text, re.MULTILINE)[1]) for n in names)


def _ordered(sql: str) -> str:
    return f"with ord as ({ORDERS}), cust as ({CUSTOMERS}) {sql}"


#: Queries as text over the tables with nulls, and their SQL.
TEXT: dict[str, tuple[str, str]] = {
    "null_order": ("FROM work.ord\nSELECT k, cust, tag\nORDER BY cust DESC, tag, k\nLIMIT 2500", "select k, cust, tag from ord order by cust desc nulls first, tag asc nulls last, k limit 2500"),
    "null_order_ascending": ("FROM work.ord\nSELECT k, tag, big\nORDER BY tag, big DESC, k\nLIMIT 50\nOFFSET 11900", "select k, tag, big from ord order by tag nulls last, big desc nulls first, k limit 50 offset 11900"),
    "null_filter": ('FROM work.ord\nSELECT k\nFILTER cust > 700 OR tag = "O"', "select k from ord where cust > 700 or tag = 'O'"),
    "null_filter_columns": ("FROM work.ord\nSELECT k, cust, v\nFILTER cust < k AND v > 0", "select k, cust, v from ord where cust < k and v > 0"),
    "null_join_keys": ("FROM work.ord\nJOIN work.cust ON cust = id\nSELECT k, seg", "select k, seg from ord join cust on cust is not distinct from id"),
    "null_group_keys": ("FROM work.ord\nGROUP BY tag, big\nAGG COUNT(cust)", "select tag, big, cast(count(cust) as int) as count_cust from ord group by 1, 2"),
    "null_group_values": ("FROM work.ord\nGROUP BY cust\nAGG MIN(v)", "select cust, cast(min(v) as int) as min_v from ord group by 1"),
    "null_max": ("FROM work.ord\nFILTER k < 40\nGROUP BY k\nAGG MAX(cust)", "select k, cast(coalesce(max(cust), 0) as int) as max_cust from ord where k < 40 group by 1"),
    "negative_avg": ("FROM work.ord\nGROUP BY tag\nAGG AVG(v)", "select tag, cast(trunc(sum(v) / count(v)) as int) as avg_v from ord group by 1"),
    "negative_avg_keys": ("FROM work.ord\nGROUP BY cust\nAGG AVG(v)", "select cust, cast(trunc(sum(v) / count(v)) as int) as avg_v from ord group by 1"),
    "empty_groups": ("FROM work.ord\nFILTER k < 0\nGROUP BY tag\nAGG SUM(v)", "select tag, cast(sum(v) as int) as sum_v from ord where k < 0 group by 1"),
    "native_join_group": ("FROM work.ord\nJOIN work.cust ON id = cust\nGROUP BY seg\nAGG SUM(v)\nSELECT seg, sum_v", "select seg, cast(sum(v) as int) as sum_v from ord join cust on cust is not distinct from id group by 1"),
}


def empty_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).query(scan("work.ord").filter(col("k").lt(0)).aggregate([], "v", "SUM"))


def mixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of signed and of unsigned type match by value; a number and a text can't be joined."""
    session = _filled(spark, sf_dir)
    session.catalog.create_table("work.u", TableSchema((ColumnSchema("u", U32, False),))).append(_rows(session, "select o_orderkey as u from orders"), ["u"])
    found = session.query("FROM work.ord\nJOIN work.u ON k = u\nSELECT k").count()
    try:
        session.query("FROM work.ord\nJOIN work.cust ON k = seg\nSELECT k")
        refused = False
    except EngineError:
        refused = True
    return _shown(spark, [(found, refused)], "found bigint, refused boolean")


def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found by an equality, a range and a text, and whether the scan left out most of the row groups."""
    session = _filled(spark, sf_dir, 1, TableConfig(row_group_size=500))
    out = []
    for name, condition in (("equal", "k = 4321"), ("range", "k > 1000 AND k < 1500"), ("absent", "k = 1000000000"), ("text", 'tag = "no such"')):
        df = session.query(f"FROM work.ord\nSELECT k\nFILTER {condition}")
        n = len(df.collect())
        node = df._jdf.queryExecution().executedPlan()
        while not node.nodeName().startswith("Scan"):
            node = node.children().head()
        out.append((name, n, node.metrics().apply("numOutputRows").value() <= 2000))
    return _shown(spark, out, "name string, found bigint, pruned boolean")


def delete_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _filled(spark, sf_dir, 2)
    session.execute('DELETE FROM work.ord FILTER cust > 50 OR tag = "F"')
    return session.query("FROM work.ord")


def cleared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were added after all were deleted; the scan sees each change."""
    session = _filled(spark, sf_dir)
    session.query("FROM work.ord").count()
    session.execute("DELETE FROM work.ord")
    empty = session.query("FROM work.ord").count()
    session.catalog.resolve_native("work.ord").append(_rows(session, ORDERS).filter("k < 100"), ["k"])
    return session.query("FROM work.ord\nSELECT k, tag").withColumn("before", F.lit(empty))


def dropped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each region, some dropped again; and a database dropped with all that it has."""
    session = _open(spark, sf_dir)
    session.execute("CREATE DATABASE gone")
    regions = [(r["r_regionkey"], r["r_name"].replace(" ", "_").lower()) for r in session.catalog.resolve("tpch.region").scan().collect()]
    for key, name in regions:
        session.execute(f"CREATE TABLE work.{name} (x I32)")
        session.execute(f"CREATE TABLE gone.{name} (x I32)")
        if key > 2:
            session.execute(f"DROP TABLE work.{name}")
    removed = int(re.search(r"\((\d+)", session.execute("DROP DATABASE gone").message)[1])
    left = [t.name for t in session.catalog.list_tables() if t.database == "work" and session.catalog.table_exists(t.fqn)]
    known = "gone" in [d.name for d in session.catalog.list_databases()] or session.catalog.database_exists("gone")
    return _shown(spark, [(n, removed, known) for n in left], "name string, removed bigint, known boolean")


def vacuumed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What interrupted work left is removed, rows stay."""
    session = _filled(spark, sf_dir)
    table = session.catalog.resolve_native("work.ord")
    for name in (".compacting_left", "segment_99"):
        table.files.mkdirs(f"{table.path}/{name}")
        table.files.write(f"{table.path}/{name}/part-0.parquet", "cut off")
    removed = _numbers(session.meta("vacuum work.ord").content, "removed_entries")[0]
    again = _numbers(session.meta("vacuum work.ord").content, "removed_entries")[0]
    return _shown(spark, [(removed - 2 + again, session.query("FROM work.ord").count())], "left bigint, n bigint")


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many segments become one by the trigger; segments with small row groups become ones with full groups."""
    session = _filled(spark, sf_dir, 9, TableConfig(row_group_size=500, compaction_segment_threshold=8))
    table = session.catalog.resolve_native("work.ord")
    due = needs_compaction(table)
    report = maybe_compact(table)
    segment = table.segments()[0]
    compact_segment(table, segment)
    return _shown(spark, [(due, needs_compaction(table), report.rows_rewritten, len(table.segments()), session.query("FROM work.ord").count())], "due boolean, due_again boolean, rewritten bigint, segments bigint, n bigint")


def background_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows while the background task compacts what is due."""
    session = _filled(spark, sf_dir, 9, TableConfig(row_group_size=500, compaction_segment_threshold=4))
    compacted = "work.ord" in BackgroundCompaction(session.catalog).run_once() and not needs_compaction(session.catalog.resolve_native("work.ord"))
    return session.query("FROM work.ord\nGROUP BY tag\nAGG COUNT(k)").withColumn("compacted", F.lit(compacted))


def locked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """While one compaction holds the table another is refused; rows can be read."""
    session = _filled(spark, sf_dir)
    table = session.catalog.resolve_native("work.ord")
    with table.lock():
        answer = session.handle(M.MetaCommand("optimize work.ord"))
        n = session.query("FROM work.ord").count()
    return _shown(spark, [(isinstance(answer, M.Error), n)], "refused boolean, n bigint")


def overflowing_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of I32 that doesn't fit I32 is an error."""
    session = _open(spark, sf_dir)
    session.catalog.create_table("work.t", TableSchema((ColumnSchema("x", I32, False), ColumnSchema("g", I32, False)))).append(_rows(session, "select cast(2000000000 as int) as x, cast(r_regionkey as int) as g from region").coalesce(1))
    answers = [session.handle(M.QueryText(f"FROM work.t\nFILTER g < {n}\nGROUP BY x\nAGG SUM(x)")) for n in (1, 2)]
    return _shown(spark, [(n, isinstance(a, M.Error)) for n, a in zip((1, 2), answers)], "groups bigint, failed boolean")


def meta_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(_filled(spark, sf_dir).meta("databases").content)
    return _shown(spark, [(c[0], int(c[1]), int(c[2])) for c in cells if c[0] in ("tpch", "work")], "name string, n_tables bigint, n_rows bigint")


def meta_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(_filled(spark, sf_dir).meta("tables").content)
    return _shown(spark, [(c[0], c[1], int(c[3]), c[4] == "yes") for c in cells if c[0] in ("tpch", "work")], "base string, name string, n_rows bigint, has_data boolean")


def meta_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _open(spark, sf_dir).meta("schema tpch.lineitem").content
    return _shown(spark, [(m,) for m in re.findall(r"^  - (\w+):", text, re.MULTILINE)], "name string")


def meta_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _filled(spark, sf_dir, 3, TableConfig(row_group_size=500)).meta("segments work.ord").content
    return _shown(spark, [tuple(map(int, m)) for m in re.findall(r"segment_(\d+)\trows=(\d+)\trow_groups=(\d+)", text)], "segment bigint, n bigint, row_groups bigint")


def meta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _filled(spark, sf_dir).meta("stats work.ord").content
    found = re.findall(r"  - (\w+): min=(\S+) max=(\S+) null_count=(\d+)", text)
    return _shown(spark, [(n, a, b, int(c)) for n, a, b, c in found if n != "big"], "name string, least string, most string, nulls bigint")


def meta_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _filled(spark, sf_dir, 4, TableConfig(row_group_size=500)).meta("optimize work.ord").content
    return _shown(spark, [_numbers(text, "input_segments", "output_segments", "rows_rewritten")], "input bigint, output bigint, rewritten bigint")


def meta_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the smallest table's rows as a setting, as it is shown."""
    session = _open(spark, sf_dir)
    n = session.catalog.resolve("tpch.nation").scan().count()
    session.execute(f'CREATE TABLE work.t (x I32) USING CONFIG (row_group_size = {n}, compression = "zstd")')
    return _shown(spark, [_numbers(session.meta("storage work.t").content, "row_group_size")], "row_group_size bigint")


def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations inserted and read by messages, each encoded and decoded on its way."""
    session = _open(spark, sf_dir)
    nations = session.catalog.resolve("tpch.nation").scan().select("n_nationkey", "n_name").collect()

    def send(message):
        return M.decode_server(M.encode_server(session.handle(M.decode_client(M.encode_client(message)))))

    send(M.CreateTable("work.nation", [ColumnSchema("id", I32, False), ColumnSchema("name", UTF8, True)]))
    send(M.InsertRows("work.nation", [[r["n_nationkey"], None if r["n_nationkey"] % 4 == 0 else r["n_name"]] for r in nations]))
    found = send(M.QueryText("FROM work.nation\nFILTER id > 2"))
    rows = [(int(a), None if b == "NULL" else b, found.summary.rows, found.summary.columns) for a, b in found.result_set.rows]
    return _shown(spark, rows, "id bigint, name string, n_rows bigint, n_columns bigint")


def served_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's rows from the server, over a socket; its other answer is an error, and the connection goes on."""
    session = _filled(spark, sf_dir)
    with Server(session, "127.0.0.1", 0, compaction=False) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        client = Client("127.0.0.1", server.server_address[1], timeout=600)
        pong = isinstance(client.send(M.Ping()).message, M.Pong) and isinstance(client.send(M.QueryText("FROM work.none")).message, M.Error)
        found = client.send(M.QueryText("FROM work.ord\nGROUP BY tag\nAGG COUNT(k)")).message
        client.close()
        server.shutdown()
    return _shown(spark, [(None if a == "NULL" else a, int(b), pong) for a, b in found.result_set.rows], "tag string, n bigint, pong boolean")


def shell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the shell shows them, as separated values, after a statement over several lines."""
    out: list[str] = []
    shell = Shell(LocalClient(_filled(spark, sf_dir)), Settings(show_plan=False, output_format="csv"), out.append)
    for line in ("FROM work.ord", "GROUP BY tag", "AGG SUM(v);"):
        shell.line(line)
    lines = out[-1].split("=== Query Results ===\n")[1].splitlines()[1:-1]
    return _shown(spark, [(None if a == "NULL" else a, int(b)) for a, b in (x.split(",") for x in lines)], "tag string, sum_v bigint")


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result drawn as a table of text, and read from it again."""
    found = _open(spark, sf_dir).execute("FROM tpch.nation\nSELECT n_nationkey, n_name").result_set
    return _shown(spark, [(int(a), b) for a, b in _cells(result_set(found, "ascii"))], "n_nationkey bigint, n_name string")


def standalone_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).read("work.ord", col("cust").gt(500), ["k", "cust"])


def parsed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).query(parse_aql("FROM work.ord\nSELECT k, v\nFILTER v < 0"))


def grouped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's group-by over rows that come in several parts."""
    rows = _rows(_open(spark, sf_dir), ORDERS)
    parts = rows.filter("k % 2 = 0").union(rows.filter("k % 2 = 1")).select(F.coalesce("tag", F.lit("none")).alias("tag"), "v")
    return group_by_multi_key(parts, ["tag"], "v", "SUM")


_COUNTS = {t: f"select count(*) from {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
_EACH = " union all ".join(f"select 'tpch' as base, '{t}' as name, ({sql}) as n_rows" for t, sql in _COUNTS.items())
_EVERY = f"{_EACH} union all select 'work', 'ord', (select count(*) from ord) union all select 'work', 'cust', (select count(*) from cust)"
_STATS = " union all ".join(f"select '{c}' as name, cast(min({c}) as varchar) as least, cast(max({c}) as varchar) as most, count(*) - count({c}) as nulls from ord" for c in ("k", "cust", "tag", "v"))

_FUNCTIONS: dict[Callable[[SparkSession, str], DataFrame], str] = {
    empty_aggregate: "select cast(coalesce(sum(v), 0) as int) as sum_v from ord where k < 0",
    mixed_keys: "select count(*) as found, true as refused from ord join orders on k = o_orderkey",
    pruned_scan: """select 'equal' as name, count(*) as found, true as pruned from ord where k = 4321 union all select 'range', count(*), true from ord where k > 1000 and k < 1500
      union all select 'absent', count(*), true from ord where k = 1000000000 union all select 'text', count(*), true from ord where tag = 'no such'""",
    delete_with_nulls: "select * from ord where not coalesce(cust > 50 or tag = 'F', false)",
    cleared_table: "select k, tag, cast(0 as int) as before from ord where k < 100",
    dropped_tables: "select replace(lower(r_name), ' ', '_') as name, (select count(*) from region) as removed, false as known from region where r_regionkey <= 2",
    vacuumed_table: "select 0 as left, count(*) as n from ord",
    compaction: "select true as due, false as due_again, count(*) as rewritten, cast(ceil(count(*) / 4000) as bigint) as segments, count(*) as n from ord",
    background_compaction: "select tag, cast(count(k) as int) as count_k, true as compacted from ord group by 1",
    locked_table: "select true as refused, count(*) as n from ord",
    overflowing_sum: "select g as groups, (select sum(2000000000) from region where r_regionkey < g) > 2147483647 as failed from (values (1), (2)) t(g)",
    meta_databases: f"select base as name, count(*) as n_tables, cast(sum(n_rows) as bigint) as n_rows from ({_EVERY}) group by 1",
    meta_tables: f"select base, name, n_rows, n_rows > 0 as has_data from ({_EVERY})",
    meta_schema: "select column_name as name from (describe lineitem)",
    meta_segments: "select k % 3 as segment, count(*) as n, cast(ceil(count(*) / 500) as bigint) as row_groups from ord group by 1",
    meta_stats: _STATS,
    meta_optimize: "select 4 as input, cast(ceil(count(*) / 4000) as bigint) as output, count(*) as rewritten from ord",
    meta_storage: "select count(*) as row_group_size from nation",
    message_rows: "select n_nationkey as id, case when n_nationkey % 4 = 0 then null else n_name end as name, count(*) over () as n_rows, 2 as n_columns from nation where n_nationkey > 2",
    served_rows: "select tag, count(k) as n, true as pong from ord group by 1",
    shell_rows: "select tag, cast(sum(v) as bigint) as sum_v from ord group by 1",
    text_table: "select n_nationkey, n_name from nation",
    standalone_read: "select k, cust from ord where cust > 500",
    parsed_plan: "select k, v from ord where v < 0",
    grouped_batches: "select coalesce(tag, 'none') as tag, cast(sum(v) as double) as result from ord group by 1",
}


def _text_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _filled(spark, sf_dir).query(text)


QUERIES = {name: _text_query(text) for name, (text, _) in TEXT.items()} | {f.__name__: f for f in _FUNCTIONS}
ORACLE = {name: _ordered(sql) for name, (_, sql) in TEXT.items()} | {f.__name__: _ordered(sql) for f, sql in _FUNCTIONS.items()}
