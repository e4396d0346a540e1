"""Databases and tables below a data root: ``root/database/table``; ``root/table`` is a table of ``default``, too."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import ExecutionError, StorageError
from ..functions.types import TableSchema
from .files import Files
from .storage import CONFIG_FILE, SCHEMA_FILE, ExternalTable, Table, TableConfig

DEFAULT = "default"


@dataclass(frozen=True)
class Database:
    name: str
    path: str


def _identifier(name: str, what: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise StorageError(f"Invalid {what} name: {name}")
    return name


def split_reference(reference: str) -> tuple[str, str]:
    """(database, table) of ``t`` or ``db.t``."""
    reference = reference.strip()
    if not reference:
        raise ExecutionError("Table reference cannot be empty")
    parts = reference.split(".")
    if len(parts) > 2:
        raise StorageError(f"Invalid table name: {reference}")
    database, table = parts if len(parts) == 2 else (DEFAULT, parts[0])
    return _identifier(database, "database"), _identifier(table, "table")


def normalize(reference: str) -> str:
    return ".".join(split_reference(reference))


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._external: dict[str, ExternalTable] = {}

    # --- external Parquet

    def register_parquet(self, reference: str, path: str) -> ExternalTable:
        """Makes a Parquet file or folder readable as ``database.table``; native tables of that name come first."""
        database, name = split_reference(reference)
        table = ExternalTable(self.spark, database, name, path)
        self._external[table.fqn] = table
        return table

    # --- listing

    def _is_table(self, path: str) -> bool:
        return self.files.exists(f"{path}/{SCHEMA_FILE}")

    def _legacy(self) -> dict[str, str]:
        return {e.name: e.path for e in self.files.list(self.root) if e.is_dir and self._is_table(e.path)}

    def list_databases(self) -> list[Database]:
        """By name. ``default`` is there if tables stand right below the root; a missing root has none."""
        found = {e.name: Database(e.name, e.path) for e in self.files.list(self.root) if e.is_dir and not e.name.startswith(".") and not self._is_table(e.path)}
        if self._legacy():
            found.setdefault(DEFAULT, Database(DEFAULT, f"{self.root}/{DEFAULT}"))
        for t in self._external.values():
            found.setdefault(t.database, Database(t.database, f"{self.root}/{t.database}"))
        return [found[n] for n in sorted(found)]

    def list_tables(self) -> list[Table | ExternalTable]:
        """By full name; where both layouts have a table, the one below its database counts."""
        found: dict[str, Table | ExternalTable] = dict(self._external)
        for name, path in self._legacy().items():
            found[f"{DEFAULT}.{name}"] = Table(self.spark, DEFAULT, name, path)
        for e in self.files.list(self.root):
            if e.is_dir and not e.name.startswith(".") and not self._is_table(e.path):
                for t in self.files.list(e.path):
                    if t.is_dir and self._is_table(t.path):
                        found[f"{e.name}.{t.name}"] = Table(self.spark, e.name, t.name, t.path)
        return [found[n] for n in sorted(found)]

    def database_exists(self, name: str) -> bool:
        path = f"{self.root}/{name}"
        here = self.files.is_dir(path) and not self._is_table(path)
        return here or (name == DEFAULT and bool(self._legacy())) or any(t.database == name for t in self._external.values())

    def table_exists(self, reference: str) -> bool:
        return self._path(reference) is not None or normalize(reference) in self._external

    # --- resolving

    def _path(self, reference: str) -> str | None:
        database, name = split_reference(reference)
        paths = [f"{self.root}/{database}/{name}"] + [f"{self.root}/{name}"] * (database == DEFAULT)
        return next((p for p in paths if self._is_table(p)), None)

    def resolve(self, reference: str) -> Table | ExternalTable:
        database, name = split_reference(reference)
        if path := self._path(reference):
            return Table(self.spark, database, name, path)
        if external := self._external.get(f"{database}.{name}"):
            return external
        raise ExecutionError(f"Table '{database}.{name}' does not exist")

    def resolve_native(self, reference: str) -> Table:
        table = self.resolve(reference)
        if not isinstance(table, Table):
            raise ExecutionError(f"Table '{table.fqn}' is external and read-only")
        return table

    def resolve_insert_target(self, reference: str | None) -> Table:
        """The named table or, without a name, the only one there is."""
        if reference is not None:
            return self.resolve_native(reference)
        tables = [t for t in self.list_tables() if isinstance(t, Table)]
        if not tables:
            raise ExecutionError("INSERT INTO ROWS requires a table name because no tables were found")
        if len(tables) > 1:
            raise ExecutionError("INSERT INTO ROWS requires a table name when more than one table exists")
        return tables[0]

    # --- DDL

    def create_database(self, name: str) -> Database:
        path = f"{self.root}/{_identifier(name, 'database')}"
        self.files.mkdirs(path)
        return Database(name, path)

    def drop_database(self, name: str) -> int:
        """Removes the database and its tables; how many there were."""
        _identifier(name, "database")
        if not self.database_exists(name):
            raise ExecutionError(f"Database '{name}' does not exist")
        tables = [t for t in self.list_tables() if t.database == name and isinstance(t, Table)]
        for t in tables:
            self.files.delete(t.path)
        self.files.delete(f"{self.root}/{name}")
        for fqn in [k for k, t in self._external.items() if t.database == name]:
            del self._external[fqn]
        return len(tables)

    def create_table(self, reference: str, schema: TableSchema, config: TableConfig | None = None) -> Table:
        database, name = split_reference(reference)
        if self._path(reference):
            raise ExecutionError(f"Table '{database}.{name}' already exists")
        for c in schema.columns:
            _identifier(c.name, "column")
        path = f"{self.root}/{database}/{name}"
        self.files.mkdirs(path)
        self.files.write(f"{path}/{CONFIG_FILE}", (config or TableConfig()).to_json())
        # the schema makes the folder a table, so it comes last
        self.files.write(f"{path}/{SCHEMA_FILE}", schema.to_json())
        return Table(self.spark, database, name, path)

    def drop_table(self, reference: str) -> None:
        table = self.resolve_native(reference)
        self.files.delete(table.path)
        table.refresh()
