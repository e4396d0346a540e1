"""One engine over a SparkSession and a data root: text, builders and messages in, DataFrames and answers out."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, SparkSession

from . import inspect
from . import messages as M
from .errors import EngineError, ExecutionError, translated
from .functions.types import TableSchema
from .operators.relational import project
from .plans import parser as P
from .plans.binder import Bound, bind, bind_predicate, resolve
from .plans.compiler import compile_plan, predicate
from .plans.expr import Expr
from .plans.formatter import format_logical, format_physical
from .plans.logical import Builder, Plan
from .sources.catalog import Catalog, normalize
from .sources.ingest import json_rows, table_rows
from .sources.storage import TableConfig


class Session:
    def __init__(self, spark: SparkSession, data_root: str = "data"):
        self.spark = spark
        self.catalog = Catalog(spark, data_root)

    # --- queries

    def bind(self, query: str | Builder | Plan) -> Bound:
        plan = P.parse_aql(query) if isinstance(query, str) else query.build() if isinstance(query, Builder) else query
        return bind(plan, self.catalog)

    def query(self, query: str | Builder | Plan) -> DataFrame:
        """The query as a DataFrame; nothing runs until Spark is asked for its rows."""
        return compile_plan(self.bind(query))

    def read(self, table: str, condition: Expr | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of one table without a plan: a predicate and a projection, if any."""
        found = self.catalog.resolve(table)
        df = found.scan()
        if condition is not None:
            df = df.filter(predicate(bind_predicate(condition, found.struct().fields)))
        return df if columns is None else project(df, [(resolve(c, df.columns), c) for c in columns])

    # --- statements

    def execute(self, text: str) -> M.QueryResult | M.Ok:
        """Runs one statement. A query's rows come to the driver as text."""
        s = P.parse_statement(text)
        try:
            return self._run(s)
        except EngineError:
            raise
        except Exception as e:
            if (known := translated(e)) is not e:
                raise known from None
            raise

    def _run(self, s: P.Statement) -> M.QueryResult | M.Ok:
        match s:
            case P.Query(plan):
                return self.run_query(plan)
            case P.CreateDatabase(name):
                self.catalog.create_database(name)
                return M.Ok(f"database '{name}' created")
            case P.DropDatabase(name):
                n = self.catalog.drop_database(name)
                return M.Ok(f"database '{name}' dropped ({n} table(s) removed)")
            case P.CreateTable(table, columns, options):
                self.catalog.create_table(table, TableSchema(columns), TableConfig(**options))
                return M.Ok(f"table '{normalize(table)}' created")
            case P.DropTable(table):
                self.catalog.drop_table(table)
                return M.Ok(f"table '{normalize(table)}' dropped")
            case P.InsertRows(table, rows):
                target = self.catalog.resolve_insert_target(table)
                return M.Ok(f"inserted {target.insert_rows(rows)} row(s) into {target.fqn}")
            case P.IngestInto(table, path):
                target = self.catalog.resolve_native(table)
                n = target.append(table_rows(json_rows(self.spark, path), target.schema))
                return M.Ok(f"ingested {n} row(s) into {target.fqn} from {path}")
            case P.DeleteRows(table, condition):
                target = self.catalog.resolve_native(table)
                bound = None if condition is None else predicate(bind_predicate(condition, target.struct().fields))
                return M.Ok(f"deleted {target.delete_where(bound)} row(s) from {target.fqn}")
        raise ExecutionError("Unsupported statement")

    def run_query(self, plan: Plan) -> M.QueryResult:
        started = time.perf_counter()
        bound = bind(plan, self.catalog)
        df = compile_plan(bound)
        names = df.columns
        rows = [[_text(v) for v in r] for r in df.collect()]
        ms = (time.perf_counter() - started) * 1000
        summary = M.QuerySummary(len(rows), len(names), int(bool(rows)), ms)
        return M.QueryResult(M.ResultSet(names, rows), format_logical(bound), format_physical(bound), summary)

    def explain(self, query: str | Builder | Plan) -> str:
        """Both plans of the engine and Spark's own."""
        bound = self.bind(query)
        df = compile_plan(bound)
        spark_plan = self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return f"{format_logical(bound)}\n{format_physical(bound)}\n{spark_plan}"

    def meta(self, command: str) -> M.MetaResult:
        return inspect.run(self.catalog, command)

    # --- messages

    def handle(self, message):
        """The answer to a client's message. Errors are answers, too: they don't end the connection."""
        try:
            match message:
                case M.Ping():
                    return M.Pong()
                case M.QueryText(text):
                    return self.execute(text)
                case M.MetaCommand(command):
                    return self.meta(command)
                case M.CreateDatabase(name):
                    return self._run(P.CreateDatabase(name))
                case M.CreateTable(table, columns):
                    if not columns:
                        raise ExecutionError("CREATE TABLE requires at least one column")
                    return self._run(P.CreateTable(table, tuple(columns), {}))
                case M.InsertRows(table, rows):
                    return self._run(P.InsertRows(table, rows))
                case M.IngestInto(table, path):
                    return self._run(P.IngestInto(table, path))
            raise ExecutionError("Unsupported message")
        except Exception as e:
            return M.Error(str(translated(e)))


def _text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return str(value)
