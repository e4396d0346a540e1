"""Semantics, statements, messages and the shell, on small tables with nulls."""

import io
import json
import threading

import pytest

from colonnade import messages as M
from colonnade.errors import EngineError, ExecutionError, StorageError
from colonnade.functions.aggregates import count, global_aggregate, group_by_multi_key, max_
from colonnade.functions.types import BOOL, I32, U32, UTF8, ColumnSchema, TableSchema, coerce
from colonnade.plans import parser as P
from colonnade.plans.expr import col, lit
from colonnade.plans.logical import Filter, Limit, Project, Scan, Sort, aql
from colonnade.printer import Settings, box_table, result_set
from colonnade.server import Client, LocalClient, Server
from colonnade.shell import Shell
from colonnade.sources.catalog import normalize, split_reference
from colonnade.sources.maintenance import column_stats, compact_segment, maybe_compact, needs_compaction, optimize, vacuum
from colonnade.sources.storage import TableConfig
from colonnade.streaming.background import BackgroundCompaction

EVENTS = [(100, 1, "US", "mobile", 130, True), (101, 1, "US", "desktop", 75, True), (102, 2, "CA", "desktop", 0, False),
          (103, 2, "CA", "mobile", 20, False), (104, 3, "DE", "mobile", 90, True), (105, 3, "FR", "tablet", 15, False)]
USERS = '(1, "a@example.com", "pro", true), (2, "b@example.com", "free", true), (3, "c@example.com", "pro", false)'


def table(session, name, columns, rows):
    """A table of the database ``t`` with these columns ("k I32 NULL, ...") and rows."""
    session.execute("CREATE DATABASE t")
    session.execute(f"CREATE TABLE t.{name} ({columns})")
    if rows:
        session.execute(f"INSERT INTO t.{name} ROWS " + ", ".join(f"({json.dumps(list(r))[1:-1]})" for r in rows))


def rows(session, text):
    return [tuple(r) for r in session.query(text).collect()]


def fails(kind, message):
    return pytest.raises(kind, match=message.replace("(", r"\(").replace(")", r"\)").replace("*", r"\*").replace("+", r"\+"))


# --- golden scenario


def test_walkthrough(session, tmp_path):
    assert session.execute("CREATE DATABASE analytics").message == "database 'analytics' created"
    assert session.execute("CREATE TABLE analytics.events (\n event_id U32,\n user_id U32,\n country Utf8,\n device Utf8,\n revenue I32,\n is_paying Bool\n) USING CONFIG (row_group_size = 2)").message == "table 'analytics.events' created"
    session.execute("CREATE TABLE analytics.users (id U32, email Utf8, plan Utf8, active Bool)")
    names = ["event_id", "user_id", "country", "device", "revenue", "is_paying"]
    path = tmp_path / "events.ndjson"
    path.write_text("\n".join(json.dumps(dict(zip(names, e))) for e in EVENTS) + "\n\n")
    assert session.execute(f'INGEST INTO analytics.events FROM "{path}"').message == f"ingested 6 row(s) into analytics.events from {path}"
    assert session.execute(f"INSERT INTO analytics.users ROWS {USERS}").message == "inserted 3 row(s) into analytics.users"
    segment = session.catalog.resolve("analytics.events").segments()
    assert len(segment) == 1 and segment[0].row_groups == 3
    got = session.execute("FROM analytics.events\nSELECT country, device, revenue\nFILTER revenue > 50\nORDER BY revenue DESC").result_set
    assert got.columns == ["country", "device", "revenue"] and got.rows == [["US", "mobile", "130"], ["DE", "mobile", "90"], ["US", "desktop", "75"]]
    assert rows(session, "FROM analytics.events\nSELECT country\nGROUP BY country\nAGG SUM(revenue)\nGROUP FILTER SUM(revenue) > 50\nORDER BY SUM(revenue) DESC") == [("US",), ("DE",)]
    assert rows(session, "FROM analytics.events\nJOIN analytics.users ON user_id = id\nSELECT country, revenue, email, plan\nFILTER revenue > 10\nORDER BY revenue DESC") == [
        ("US", 130, "a@example.com", "pro"), ("DE", 90, "c@example.com", "pro"), ("US", 75, "a@example.com", "pro"), ("CA", 20, "b@example.com", "free"), ("FR", 15, "c@example.com", "pro")]
    assert session.execute("DELETE FROM analytics.events WHERE revenue < 20").message == "deleted 2 row(s) from analytics.events"
    assert session.execute("DELETE FROM analytics.events").message == "deleted 4 row(s) from analytics.events"
    assert rows(session, "FROM analytics.events") == []
    assert session.execute("DROP TABLE analytics.events").message == "table 'analytics.events' dropped"
    assert session.execute("DROP DATABASE analytics").message == "database 'analytics' dropped (1 table(s) removed)"


# --- nulls, order, aggregates


def test_null_order(session):
    table(session, "s", "n Utf8 NULL", [["a"], [None], ["c"]])
    assert rows(session, "FROM t.s\nORDER BY n") == [("a",), ("c",), (None,)]
    assert rows(session, "FROM t.s\nORDER BY n DESC") == [(None,), ("c",), ("a",)]


def test_null_join_keys_match(session):
    table(session, "l", "k I32 NULL, x Utf8", [[1, "p"], [None, "q"], [3, "z"]])
    session.execute("CREATE TABLE t.r (k I32 NULL, y Utf8)")
    session.execute('INSERT INTO t.r ROWS (1, "s"), (null, "t")')
    assert sorted(rows(session, "FROM t.l\nJOIN t.r ON t.l.k = t.r.k\nSELECT x, y")) == [("p", "s"), ("q", "t")]
    assert session.query("FROM t.l\nJOIN t.r ON t.l.k = t.r.k").columns == ["t.l.k", "t.l.x", "t.r.k", "t.r.y"]
    with fails(ExecutionError, "Ambiguous column: k"):
        session.query("FROM t.l\nJOIN t.r ON t.l.k = t.r.k\nSELECT k")
    with fails(ExecutionError, "Ambiguous column: x"):
        session.query("FROM t.l\nJOIN t.l ON k = k\nSELECT x")
    with fails(ExecutionError, "Type mismatch in JOIN"):
        session.query("FROM t.l\nJOIN t.r ON x = t.r.k")


def test_unsigned_and_signed_keys_match(session):
    table(session, "a", "k U32", [[1], [4294967295]])
    session.execute("CREATE TABLE t.b (j I32)")
    session.execute("INSERT INTO t.b ROWS (1), (2)")
    assert rows(session, "FROM t.a\nJOIN t.b ON k = j") == [(1, 1)]


def test_groups_never_give_null(session):
    table(session, "g", "k Utf8 NULL, v I32 NULL", [["a", 1], ["a", None], ["b", None], [None, 4], ["c", -3], ["c", -4]])
    got = lambda f: dict(rows(session, f"FROM t.g\nGROUP BY k\nAGG {f}(v)"))
    assert got("SUM") == {"a": 1, "b": 0, None: 4, "c": -7}
    assert got("COUNT") == {"a": 1, "b": 0, None: 1, "c": 2}
    assert got("AVG") == {"a": 1, "b": 0, None: 4, "c": -3}
    assert got("MIN") == {"a": 1, "b": 0, None: 4, "c": -4} and got("MAX") == {"a": 1, "b": 0, None: 4, "c": -3}
    assert rows(session, "FROM t.g\nGROUP BY k\nAGG SUM(v)\nLIMIT 2") == [("a", 1), ("b", 0)]
    assert rows(session, "FROM t.g\nGROUP BY k\nAGG COUNT(k)\nORDER BY k DESC\nLIMIT 1") == [(None, 0)]
    assert session.query("FROM t.g\nGROUP BY k\nAGG SUM(v)").schema["sum_v"].dataType.simpleString() == "int"
    assert rows(session, "FROM t.g\nFILTER v > 100\nGROUP BY k\nAGG SUM(v)") == []
    with fails(ExecutionError, "Grouped aggregation only supports I32 and U32 inputs"):
        session.query("FROM t.g\nGROUP BY v\nAGG SUM(k)")


def test_result_must_fit(session):
    table(session, "o", "k Utf8, v I32", [["a", 2147483647], ["a", 1]])
    with fails(ExecutionError, "Aggregate result does not fit in I32"):
        session.execute("FROM t.o\nGROUP BY k\nAGG SUM(v)")


def test_null_comparisons(session):
    table(session, "n", "id I32, v I32 NULL, ok Bool NULL", [[1, 5, True], [2, None, None], [3, 15, False]])
    assert rows(session, "FROM t.n\nFILTER v > 7 OR v = 5\nSELECT id") == [(1,), (3,)]
    assert session.execute("DELETE FROM t.n FILTER v > 7").message == "deleted 1 row(s) from t.n"
    assert sorted(rows(session, "FROM t.n\nSELECT id")) == [(1,), (2,)]
    with fails(ExecutionError, "Type mismatch in Eq"):
        session.query('FROM t.n\nFILTER v = "5"')
    with fails(ExecutionError, "Expression not supported as boolean predicate"):
        session.query("FROM t.n\nFILTER ok")


def test_limit_takes_first_rows(session):
    table(session, "f", "v I32", [])
    for i in range(12):
        session.execute(f"INSERT INTO t.f ROWS ({i}), ({i + 100})")
    assert rows(session, "FROM t.f\nLIMIT 3\nOFFSET 1") == [(100,), (1,), (101,)]
    assert rows(session, "FROM t.f\nFILTER v > 99\nSKIP 10") == [(110,), (111,)]
    assert rows(session, "FROM t.f\nSELECT v\nLIMIT 22\nLIMIT 1") == [(0,)]


def test_library_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "k string, v int")
    assert global_aggregate(df, "v", "SUM") == 3 and global_aggregate(df, "v", "AVG") == 1.5
    assert sorted(map(tuple, group_by_multi_key(df, ["k"], "v", "SUM").collect())) == [("NULL", 2), ("a", 1)]
    with fails(ExecutionError, "MIN on empty input"):
        global_aggregate(df.limit(0), "v", "MIN")
    assert count("x").output_name() == "count_x" and max_("x").output_name() == "max_x"


# --- parser and builder


def test_build_order():
    plan = P.parse_aql("SELECT a\nLIMIT 2\nORDER BY b DESC, a ASC\nFILTER a > 1\nFROM d.t\nOFFSET 3")
    assert isinstance(plan, Limit) and isinstance(plan.child, Sort) and isinstance(plan.child.child, Project)
    assert isinstance(plan.child.child.child, Filter) and plan.child.child.child.child == Scan("d.t")
    assert plan == aql().limit(2).select("a").from_("d.t").filter(col("a").gt(1)).offset(3).order_by(P._order_term("b DESC"), "a").build()


@pytest.mark.parametrize("text,message", [
    ("", "Empty AQL input"), ("HELLO x", "Unknown AQL clause: HELLO x"), ("JOIN a.b ON c = d", "JOIN requires a preceding FROM clause"),
    ("FROM d.t\nGROUP FILTER a > 1", "GROUP FILTER can only appear after GROUP BY"), ("FROM t", "FROM requires a fully qualified table name in the form <database_name>.<table_name>"),
    ("FROM d.t\nJOIN d.u ON a > b", "JOIN ON currently only supports equality predicates"), ("FROM d.t\nLIMIT -1", "LIMIT requires a non-negative integer: -1"),
    ("FROM d.t\nFROM d.t", "FROM clause already specified"), ("FROM d.t\nAGG SUM(x)", "AGG cannot be used without GROUP BY"), ("FROM d.t\nGROUP BY a", "AGG required after GROUP BY"),
    ("FROM d.t\nGROUP BY a\nGROUP BY b", "GROUP BY already specified"), ("SELECT a", "FROM clause is required"), ("FROM d.t\nFILTER a > 1 junk", "Unexpected token at end of predicate"),
    ("FROM d.t\nFILTER a != 1", "Unexpected character in expression: !"), ("FROM d.t\nFILTER (a > 1", "Expected closing ')'"), ("FROM d.t\nFILTER a >", "Unexpected end of expression"),
    ('FROM d.t\nFILTER a = "x', "Unterminated string literal"), ("FROM d.t\nFILTER a > 99999999999", "Invalid integer literal"), ("FROM d.t\nGROUP BY a\nAGG MEDIAN(x)", "Invalid AGG clause: MEDIAN(x)"),
    ("FROM d.t\nGROUP BY a\nAGG SUM(x)\nGROUP FILTER NOPE(x) > 1", "Unsupported aggregate function: NOPE"), ("CREATE DATABASE", "CREATE DATABASE requires a database name"),
    ("CREATE TABLE d.t (a F64)", "Unsupported column type: F64"), ("CREATE TABLE d.t (a I32) USING CONFIG (x = 1)", "Unsupported table config option: x"), ("CREATE TABLE d.t", "CREATE TABLE requires a column list"),
    ('CREATE TABLE d.t (a I32) USING CONFIG (compression = "gzip")', "Unsupported compression type: gzip"), ("INSERT INTO d.t VALUES (1)", "INSERT INTO must use the syntax"),
    ("INSERT INTO d.t ROWS 1", "INSERT rows must be wrapped in parentheses"), ("INSERT INTO d.t ROWS (1.5)", "Unsupported numeric literal: 1.5"), ("INSERT INTO d.t ROWS ([1])", "Unsupported row literal value: [1]".replace("[", r"\[").replace("]", r"\]")),
    ("INSERT INTO d.t ROWS (x)", "Invalid row literal"), ("INGEST INTO d.t FROM x", "INGEST INTO must use the syntax"), ("DELETE FROM d.t FILTER a > 1 junk", "Unexpected token at end of predicate"),
])
def test_parse_errors(text, message):
    with fails(ExecutionError, message):
        P.parse_statement(text)


def test_statements():
    t = P.parse_statement('create table d.t (a Utf8, b i32 NULL, c Bool NOT NULL, d uint nullable) using config (row_group_size = 9, compression = "zstd", enable_bloom_filter = false)')
    assert [(c.column_type, c.nullable) for c in t.columns] == [(UTF8, False), (I32, True), (BOOL, False), (U32, True)]
    assert t.options == {"row_group_size": 9, "compression": "zstd", "enable_bloom_filter": False}
    assert P.parse_statement('INSERT INTO ROWS ("a \\" (,", null), (1, true)') == P.InsertRows(None, [['a " (,', None], [1, True]])
    assert P.parse_statement("DELETE FROM t\nWHERE a = 1\nAND b < 2").table == "t"
    assert str(P.parse_predicate('a = 1 or b > 2 AND "x" < c')) == '(a = 1 OR (b > 2 AND "x" < c))'
    with fails(ExecutionError, "Expected a query statement"):
        P.parse_aql("DROP TABLE d.t")
    assert normalize("t") == "default.t" and split_reference("a.b") == ("a", "b")
    with fails(StorageError, "Invalid table name: a.b.c"):
        split_reference("a.b.c")


# --- binder errors


def test_binding_errors(session):
    table(session, "b", "k Utf8, v I32", [["a", 1]])
    for text, message in (
        ("FROM t.b\nSELECT nope", "Unknown column: nope"), ("FROM t.x", "Table 't.x' does not exist"), ("FROM t.b\nFILTER SUM(v) > 1", "Aggregate references are only valid in GROUP FILTER or grouped ORDER BY"),
        ("FROM t.b\nGROUP BY k\nAGG SUM(v)\nGROUP FILTER MAX(v) > 1", "Aggregate reference Max(v) does not match the active AGG clause"), ("FROM t.b\nGROUP BY k\nAGG COUNT(*)", "Unknown column: *"),
    ):
        with fails(ExecutionError, message):
            session.query(text)


# --- tables, writes


COERCE = [
    (UTF8, 5, "5"), (UTF8, True, "true"), (I32, "+12", 12), (I32, "-12", -12), (I32, " 12 ", None), (I32, "12.0", None), (I32, "t", None), (I32, True, None), (I32, 1 << 31, None), (I32, "2147483648", None),
    (U32, "4294967295", 4294967295), (U32, -1, None), (U32, "-1", None), (U32, 1 << 31, 1 << 31), (BOOL, "TRUE", True), (BOOL, "0", False), (BOOL, "yes", None), (BOOL, 1, True), (BOOL, 2, None),
]


@pytest.mark.parametrize("kind,value,want", COERCE)
def test_coercion(kind, value, want):
    if want is None:
        with pytest.raises(StorageError):
            coerce(value, ColumnSchema("c", kind))
    else:
        assert coerce(value, ColumnSchema("c", kind)) == want


def test_coercion_of_json_is_the_same(session, tmp_path):
    session.execute("CREATE DATABASE t")
    for i, (kind, value, want) in enumerate(COERCE):
        session.execute(f"CREATE TABLE t.c{i} (c {kind})")
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps([[value]]))
        if want is None:
            with pytest.raises(StorageError):
                session.execute(f'INGEST INTO t.c{i} FROM "{path}"')
            assert session.catalog.resolve(f"t.c{i}").segments() == []
        else:
            session.execute(f'INGEST INTO t.c{i} FROM "{path}"')
            assert rows(session, f"FROM t.c{i}") == [(want,)]


def test_not_null_and_arity(session):
    table(session, "w", "id U32, label Utf8 NULL", [])
    for text, message in (("(null, 1)", "Column id is not nullable"), ("(1)", "Row has 1 values but schema requires 2"), ('("x", 1)', "Value 'x' cannot be parsed as U32 for column id")):
        with fails(StorageError, message):
            session.execute(f"INSERT INTO t.w ROWS (1, null), {text}")
    assert rows(session, "FROM t.w") == []


def test_json_shapes(session, tmp_path):
    table(session, "j", "id U32, label Utf8 NULL", [])
    path = tmp_path / "f.json"

    def ingest(text):
        path.write_text(text)
        return session.execute(f'INGEST INTO t.j FROM "{path}"').message.split(" ")[1]

    assert ingest('[{"id": 1}, {"id": 2, "label": null, "x": []}, [3, "y"]]') == "3"
    assert ingest('{"id": 4}\n\n{"label": "a", "id": "5"}\n') == "2"
    assert ingest('{"id": 6}') == "1" and ingest('{\n "id": 7\n}') == "1"
    assert ingest('[8, "z"]\n[9, null]') == "2" and ingest("") == "0"
    assert sorted(rows(session, "FROM t.j")) == [(1, None), (2, None), (3, "y"), (4, None), (5, "a"), (6, None), (7, None), (8, "z"), (9, None)]
    for text, message in (
        ('[{"label": "hello"}]', "Missing required field 'id' in JSON row (column is NOT NULL)"), ('{"id": null, "label": "x"}\n{"id": 1}', "Column id is not nullable"), ("[[1]]", "JSON row has 1 values but schema requires 2"),
        ("[1]", "Unsupported JSON row format: 1"), ('[{"id": 1.5}]', "Unsupported numeric value in ingest file: 1.5"), ('[{"id": 1, "label": [1]}]', "Unsupported value in ingest file"), ('{"id": 1}\n{oops', "Invalid JSON line: {oops"), ("7", "Expected a JSON array for ingest, got 7"),
    ):
        before = len(session.catalog.resolve("t.j").segments())
        with fails(StorageError, message):
            ingest(text)
        assert len(session.catalog.resolve("t.j").segments()) == before


def test_catalog(session, tmp_path):
    assert session.catalog.list_databases() == [] and session.meta("databases").content == "No databases found"
    with fails(ExecutionError, "INSERT INTO ROWS requires a table name because no tables were found"):
        session.execute("INSERT INTO ROWS (1)")
    table(session, "a", "v I32", [[1]])
    assert session.execute("INSERT INTO ROWS (2)").message == "inserted 1 row(s) into t.a"
    session.execute("CREATE TABLE b (v I32)")
    assert [t.fqn for t in session.catalog.list_tables()] == ["default.b", "t.a"]
    with fails(ExecutionError, "INSERT INTO ROWS requires a table name when more than one table exists"):
        session.execute("INSERT INTO ROWS (1)")
    with fails(ExecutionError, "Table 't.a' already exists"):
        session.execute("CREATE TABLE t.a (v I32)")
    with fails(ExecutionError, "Database 'x' does not exist"):
        session.execute("DROP DATABASE x")
    # a table right below the root belongs to the default database
    old = tmp_path / "data/old"
    old.mkdir()
    (old / "schema.json").write_text(TableSchema((ColumnSchema("v", I32),)).to_json())
    assert session.catalog.table_exists("old") and rows(session, "FROM default.old") == []
    assert "old" not in [d.name for d in session.catalog.list_databases()]
    assert session.execute("DROP DATABASE default").message == "database 'default' dropped (2 table(s) removed)"
    with fails(StorageError, "Invalid database name: a-b"):
        session.execute("CREATE DATABASE a-b")


# --- maintenance


def compacting(session, n=5, config=TableConfig(row_group_size=2, compaction_segment_threshold=3)):
    session.execute("CREATE DATABASE t")
    made = session.catalog.create_table("t.c", TableSchema((ColumnSchema("id", U32), ColumnSchema("name", UTF8, True))), config)
    for i in range(n):
        made.insert_rows([[i, f"n{i}" if i else None]])
    return made


def test_compaction(session):
    made = compacting(session)
    assert needs_compaction(made) and len(made.segments()) == 5
    report = optimize(made)
    assert (report.input_segments, report.output_segments, report.input_row_groups, report.output_row_groups, report.rows_rewritten, report.skipped) == (5, 1, 5, 3, 5, False)
    assert not needs_compaction(made) and optimize(made).skipped and maybe_compact(made) is None
    assert rows(session, "FROM t.c\nSELECT id\nLIMIT 9") == [(i,) for i in range(5)]
    report = compact_segment(made, made.segments()[0])
    assert report.rows_rewritten == 5 and len(rows(session, "FROM t.c")) == 5


def test_compaction_into_many_segments(session):
    made = compacting(session, 0, TableConfig(row_group_size=2, compaction_row_group_threshold=2))
    for i in range(3):
        made.insert_rows([[i * 10 + j, None] for j in range(7)])
    report = optimize(made)
    assert report.output_segments == 6 and report.rows_rewritten == 21 and all(s.rows <= 4 for s in made.segments())
    assert sorted(rows(session, "FROM t.c\nSELECT id")) == [(i * 10 + j,) for i in range(3) for j in range(7)]


def test_vacuum_lock_and_unfinished_segments(session, tmp_path):
    made = compacting(session, 1)
    base = tmp_path / "data/t/c"
    for name in (".compacting_stale", ".compacted_old_stale", "segment_99"):
        (base / name).mkdir()
    assert rows(session, "FROM t.c\nSELECT id") == [(0,)]
    assert vacuum(made).removed_entries == 3
    with made.lock(), fails(StorageError, "Compaction already in progress for table"):
        optimize(made)
    assert "removed_paths: none" in session.meta("vacuum t.c").content


def test_background_compaction(session):
    made = compacting(session, 3, TableConfig(row_group_size=4, compaction_segment_threshold=2))
    job = BackgroundCompaction(session.catalog)
    assert job.run_once(0.0) == ["t.c"] and len(made.segments()) == 1
    made.insert_rows([[9, None]])
    assert job.run_once(10.0) == [] and job.run_once(61.0) == ["t.c"]


def test_statistics(session):
    made = compacting(session, 3)
    got = {c.name: c for c in column_stats(made)}
    assert (got["id"].least, got["id"].most, got["id"].null_count, got["id"].distinct_sum) == (0, 2, 0, 3)
    assert (got["name"].least, got["name"].most, got["name"].null_count) == ("n1", "n2", 0)
    text = session.meta("stats t.c").content
    assert "rows: 3" in text and "  - id: min=0 max=2 null_count=0 row_group_distinct_sum=3" in text
    assert column_stats(session.catalog.create_table("t.e", TableSchema((ColumnSchema("v", I32),))))[0].least is None


def test_parquet_options(session, tmp_path):
    import pyarrow.parquet as pq

    made = compacting(session, 1, TableConfig(compression="zstd", row_group_size=3))
    made.insert_rows([[i, "x"] for i in range(7)])
    file = next((tmp_path / "data/t/c/segment_1").glob("*.parquet"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups == 3 and meta.row_group(0).column(0).compression == "ZSTD"
    assert meta.row_group(0).column(0).statistics.has_min_max


# --- meta commands, plans, printing


def test_meta(session):
    table(session, "m", "id U32, name Utf8 NULL", [[1, None]])
    assert session.meta("tables t").content.splitlines()[3:] == ["| t        | m     | 2       | 1    | yes      |", "+----------+-------+---------+------+----------+", "(1 row)"]
    assert session.meta("schema t.m").content.splitlines()[2:] == ["columns:", "  - id: U32", "  - name: Utf8 nullable"]
    assert "segment_0\trows=1\trow_groups=1" in session.meta("segments t.m").content
    assert session.meta("storage t.m").content.splitlines()[1:3] == ["compression: Lz4", "row_group_size: 16384"]
    assert "skipped: true" in session.meta("optimize t.m").content
    for command, message in (("nope", "Unknown meta command: nope"), ("schema", "schema requires a table reference"), ("explain", "EXPLAIN requires an inline query"), ("explain DROP TABLE x", "EXPLAIN currently only supports query statements")):
        with fails(ExecutionError, message):
            session.meta(command)


def test_plan_text(session):
    table(session, "p", "k Utf8, v I32, w I32", [])
    session.execute("CREATE TABLE t.q (v I32, z I32)")
    text = session.meta("explain FROM t.p\nFILTER v > 1 AND k = \"x\"\nGROUP BY k\nAGG SUM(v)\nGROUP FILTER SUM(v) > 2\nSELECT k\nORDER BY SUM(v) DESC\nLIMIT 3".replace("explain ", "explain ", 1)).content
    assert 'Scan(t.p) -> Filter((v > 1 AND k = "x")) -> Aggregate(keys=[k], SUM(v)) -> GroupFilter(sum_v > 2) -> Project(k) -> Sort(sum_v DESC) -> Limit(limit=3, offset=0)' in text
    assert 'Scan(table=t.p, projection=[k, v], predicate=v > 1 AND k = "x") -> Filter' in text and "HashAggregate(keys=[k], SUM(v))" in text
    text = session.meta("explain FROM t.p\nJOIN t.q ON t.p.v = t.q.v\nFILTER z > 5\nSELECT k").content
    assert "HashJoin(on=t.p.v = t.q.v, left=[Scan(t.p)], right=[Scan(t.q)]) -> Filter(t.q.z > 5) -> Project(k)" in text
    assert "left=[Scan(table=t.p, projection=[k, v])], right=[Scan(table=t.q, predicate=z > 5)]" in text
    session.execute('INSERT INTO t.p ROWS ("x", 2, 3)')
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,1)]" in session.explain("FROM t.p\nFILTER v > 1\nSELECT k")
    assert "ReadSchema: struct<k:string,v:int>" in session.explain("FROM t.p\nFILTER v > 1\nSELECT k")


def test_printing():
    r = M.ResultSet(["id", "näme"], [["1", "NULL"], ["2", "日本"]])
    assert box_table(["a"], [["1"]]) == "+---+\n| a |\n+---+\n| 1 |\n+---+\n(1 row)"
    assert result_set(r, "unicode").splitlines()[:2] == ["┌────┬──────┐", "│ id │ näme │"]
    assert result_set(r, "csv") == "id,näme\n1,NULL\n2,日本\n(2 rows)" and result_set(r, "tsv").startswith("id\tnäme")


def test_a_replacement_that_is_cut_off_loses_nothing(session, monkeypatch):
    """Cut off at each of its steps, a delete leaves the rows from before it or those after it, for readers and for the next writer."""
    from colonnade.sources.files import Files

    real = {n: getattr(Files, n) for n in ("rename", "delete", "write")}
    seen = set()
    for step in range(12):
        session.execute(f"CREATE DATABASE c{step}")
        session.execute(f"CREATE TABLE c{step}.t (k I32)")
        for part in ("(1), (2)", "(3), (4)", "(5)"):
            session.execute(f"INSERT INTO c{step}.t ROWS {part}")
        left = [step]

        def cut(name):
            def call(self, *args):
                if left[0] == 0:
                    raise KeyboardInterrupt
                left[0] -= 1
                return real[name](self, *args)

            return call

        for n in real:
            monkeypatch.setattr(Files, n, cut(n))
        try:
            session.execute(f"DELETE FROM c{step}.t FILTER k > 3")
        except KeyboardInterrupt:
            pass
        for n, f in real.items():
            monkeypatch.setattr(Files, n, f)
        t = session.catalog.resolve_native(f"c{step}.t")
        t.files.delete(f"{t.path}/.compaction.lock")
        found = tuple(sorted(r[0] for r in session.query(f"FROM c{step}.t").collect()))
        assert found in ((1, 2, 3, 4, 5), (1, 2, 3))
        session.execute(f"INSERT INTO c{step}.t ROWS (9)")
        session.meta(f"vacuum c{step}.t")
        assert tuple(sorted(r[0] for r in session.query(f"FROM c{step}.t").collect())) == (*found, 9)
        seen.add(found)
    assert len(seen) == 2 or (1, 2, 3, 4, 5) in seen


def test_a_lock_that_is_left_behind_is_taken_over(session, monkeypatch):
    from colonnade.sources import storage

    table(session, "locked", "k I32", [[1], [2]])
    t = session.catalog.resolve_native("t.locked")
    t.files.create_new(f"{t.path}/.compaction.lock")
    with fails(StorageError, "Compaction already in progress"), t.lock():
        pass
    monkeypatch.setattr(storage, "LEASE_SECONDS", 0)
    session.execute("INSERT INTO t.locked ROWS (3)")
    assert session.query("FROM t.locked").count() == 3 and not t.files.exists(f"{t.path}/.compaction.lock")


def test_limit_reads_the_segments_that_it_needs(session):
    table(session, "seg", "k I32", [[1], [2]])
    for k in range(3, 9):
        session.execute(f"INSERT INTO t.seg ROWS ({k})")
    first = session.query("FROM t.seg\nSELECT k\nLIMIT 3\nOFFSET 1")
    assert [r[0] for r in first.collect()] == [2, 3, 4] and len(first.inputFiles()) == 3
    assert [r[0] for r in session.query("FROM t.seg\nFILTER k > 6\nLIMIT 3").collect()] == [7, 8]
    assert session.query("FROM t.seg\nLIMIT 0").count() == 0


# --- messages, server, shell


MESSAGES = [M.QueryText("é"), M.Ping(), M.CreateDatabase("d"), M.CreateTable("d.t", (ColumnSchema("a", U32, True), ColumnSchema("b", BOOL))), M.InsertRows(None, [[1, None, "x", True, 4294967295, -5]]), M.InsertRows("d.t", []), M.IngestInto("d.t", "f"), M.MetaCommand("tables")]
ANSWERS = [M.QueryResult(M.ResultSet(["a"], [["1"], ["NULL"]]), "l", "p", M.QuerySummary(2, 1, 1, 0.5)), M.Error("e"), M.Pong(), M.Ok("ok"), M.MetaResult("t", "c")]


def test_messages():
    for m in MESSAGES:
        assert M.decode_client(M.encode_client(m)) == m
    for m in ANSWERS:
        assert M.decode_server(M.encode_server(m)) == m
    assert M.encode_client(M.Ping()) == b"\x00\x01\x02"
    for data, message in ((b"\x00\x02\x01", "Unsupported protocol version: 2"), (b"\x00\x01\x63", "Unknown client message type: 99"), (b"\x00\x01\x01\x00\x00\x00\x09a", "Unexpected end of message")):
        with fails(ExecutionError, message):
            M.decode_client(data)
    stream = io.BytesIO()
    M.write_frame(stream, b"abc")
    stream.seek(0)
    assert M.read_frame(stream) == b"abc" and M.read_frame(stream) is None


def test_server(session):
    with Server(session, "127.0.0.1", 0, compaction=False) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        client = Client("127.0.0.1", server.server_address[1], timeout=120)
        assert client.send(M.Ping()).message == M.Pong()
        assert client.send(M.CreateDatabase("d")).message == M.Ok("database 'd' created")
        assert client.send(M.CreateTable("d.t", (ColumnSchema("a", I32, True),))).message == M.Ok("table 'd.t' created")
        assert client.send(M.InsertRows("d.t", [[3], [None]])).message == M.Ok("inserted 2 row(s) into d.t")
        answer = client.send(M.QueryText("FROM d.t\nORDER BY a")).message
        assert answer.result_set == M.ResultSet(["a"], [["3"], ["NULL"]]) and answer.summary.rows == 2
        assert client.send(M.QueryText("FROM d.x")).message == M.Error("Execution error: Table 'd.x' does not exist")
        assert client.send(M.MetaCommand("tables")).message.title == "Tables"
        client.close()
        server.shutdown()


def test_shell(session):
    out: list[str] = []
    shell = Shell(LocalClient(session), Settings(show_plan=False, output_format="csv"), out.append)
    for line in ("CREATE DATABASE d;", "CREATE TABLE d.t (a I32);", "INSERT INTO d.t ROWS", "  (1), (2);", "FROM d.t", "FILTER a > 1", ";", "FROM d.nope;", "\\nope", "\\format", "\\format ascii", "\\timing on", "\\plan", "\\d d.t", "\\dt", "\\help", "\\version", "\\memory", "\\explain FROM d.t", "\\d", "\\profile maybe"):
        assert shell.line(line)
    assert out[:3] == ["database 'd' created", "table 'd.t' created", "inserted 2 row(s) into d.t"]
    assert out[3].startswith("=== Query Summary ===\nrows: 1\ncolumns: 1\nbatches: 1\nserver_execution_ms: ") and out[3].endswith("=== Query Results ===\na\n2\n(1 row)")
    assert out[4].startswith("Error: Execution error: Table 'd.nope'") and out[5] == "Error: CLI error: Unknown meta command: \\nope (use \\help)"
    assert out[6:10] == ["format csv", "format ascii", "timing on", "plan off"] and out[10].startswith("Schema\ntable: d.t")
    assert "time: " in out[10] and "\\stats" in out[12] and "=== Physical Plan ===" in out[15]
    assert out[16] == "Error: CLI error: \\d requires a table reference" and "Expected 'on' or 'off'" in out[17]
    assert not shell.line("\\q")
    shell.line("FROM d.t")
    shell.interrupt()
    assert shell.buffer == []


def test_literals_and_operators():
    assert str((col("a") > 1) & (lit(True).eq(col("b")) | (col("c") < "x"))) == '(a > 1 AND (true = b OR c < "x"))'
    assert issubclass(StorageError, EngineError)
