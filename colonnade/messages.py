"""What clients and the engine say to each other, and its binary form.

A frame is its length (u32) and a message; a message is the version (u16), a tag (u8) and fields. Numbers are
big-endian, strings have their length in bytes (u32) in front. Versions, tags and field orders are fixed values.
"""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass, field

from .errors import ExecutionError
from .functions.types import BOOL, I32, U32, UTF8, ColumnSchema

VERSION = 1


@dataclass(frozen=True)
class QueryText:
    text: str


@dataclass(frozen=True)
class Ping:
    pass


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnSchema, ...]


@dataclass(frozen=True)
class InsertRows:
    table: str | None
    rows: list[list]


@dataclass(frozen=True)
class IngestInto:
    table: str
    path: str


@dataclass(frozen=True)
class MetaCommand:
    command: str


@dataclass(frozen=True)
class ResultSet:
    """Values are text; NULL is the text ``NULL``."""

    columns: list[str]
    rows: list[list[str]]


@dataclass(frozen=True)
class QuerySummary:
    rows: int
    columns: int
    batches: int
    execution_time_ms: float


@dataclass(frozen=True)
class QueryResult:
    result_set: ResultSet
    logical_plan: str
    physical_plan: str
    summary: QuerySummary


@dataclass(frozen=True)
class Error:
    message: str


@dataclass(frozen=True)
class Pong:
    pass


@dataclass(frozen=True)
class Ok:
    message: str


@dataclass(frozen=True)
class MetaResult:
    title: str
    content: str


class _Writer:
    def __init__(self):
        self.out = bytearray()

    def number(self, form: str, value) -> None:
        self.out += struct.pack(">" + form, value)

    def string(self, text: str) -> None:
        data = text.encode()
        self.number("I", len(data))
        self.out += data

    def many(self, values, write) -> None:
        self.number("I", len(values))
        for v in values:
            write(v)

    def optional(self, text: str | None) -> None:
        self.number("B", text is not None)
        if text is not None:
            self.string(text)

    def column(self, c: ColumnSchema) -> None:
        self.string(c.name)
        self.number("B", _TYPE_TAGS[c.column_type])
        self.number("B", c.nullable)

    def scalar(self, v) -> None:
        if v is None:
            self.number("B", 0)
        elif isinstance(v, bool):
            self.number("B", 4)
            self.number("B", v)
        elif isinstance(v, str):
            self.number("B", 1)
            self.string(v)
        elif v < 1 << 31:
            self.number("B", 2)
            self.number("i", v)
        else:
            self.number("B", 3)
            self.number("I", v)

    def row(self, row: list) -> None:
        self.many(row, self.scalar)

    def result(self, q: QueryResult) -> None:
        self.many(q.result_set.columns, self.string)
        self.many(q.result_set.rows, lambda r: self.many(r, self.string))
        self.string(q.logical_plan)
        self.string(q.physical_plan)
        for n in (q.summary.rows, q.summary.columns, q.summary.batches):
            self.number("I", n)
        self.number("d", q.summary.execution_time_ms)


class _Reader:
    def __init__(self, data: bytes):
        self.data = io.BytesIO(data)

    def number(self, form: str):
        size = struct.calcsize(">" + form)
        raw = self.data.read(size)
        if len(raw) < size:
            raise ExecutionError("Unexpected end of message")
        return struct.unpack(">" + form, raw)[0]

    def string(self) -> str:
        n = self.number("I")
        raw = self.data.read(n)
        if len(raw) < n:
            raise ExecutionError("Unexpected end of message")
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise ExecutionError(f"Invalid UTF-8 string: {e}") from None

    def many(self, read) -> list:
        return [read() for _ in range(self.number("I"))]

    def flag(self) -> bool:
        if (tag := self.number("B")) > 1:
            raise ExecutionError(f"Invalid bool tag: {tag}")
        return bool(tag)

    def optional(self) -> str | None:
        return self.string() if self.flag() else None

    def column(self) -> ColumnSchema:
        name, tag = self.string(), self.number("B")
        if tag not in _TYPES:
            raise ExecutionError(f"Unknown column type tag: {tag}")
        return ColumnSchema(name, _TYPES[tag], self.flag())

    def scalar(self):
        tag = self.number("B")
        readers = {0: lambda: None, 1: self.string, 2: lambda: self.number("i"), 3: lambda: self.number("I"), 4: self.flag}
        if tag not in readers:
            raise ExecutionError(f"Unknown scalar value tag: {tag}")
        return readers[tag]()

    def row(self) -> list:
        return self.many(self.scalar)

    def result(self) -> QueryResult:
        rows = ResultSet(self.many(self.string), self.many(lambda: self.many(self.string)))
        plans = self.string(), self.string()
        return QueryResult(rows, *plans, QuerySummary(self.number("I"), self.number("I"), self.number("I"), self.number("d")))


_TYPE_TAGS = {UTF8: 1, I32: 2, U32: 3, BOOL: 4}
_TYPES = {v: k for k, v in _TYPE_TAGS.items()}


@dataclass(frozen=True)
class _Form:
    """How the fields of a message are written and read, in order."""

    kind: type
    fields: tuple[tuple[str, str], ...] = field(default=())


#: Tag to message: fields and their forms.
_CLIENT = {
    1: _Form(QueryText, (("text", "string"),)), 2: _Form(Ping), 3: _Form(CreateDatabase, (("name", "string"),)),
    4: _Form(CreateTable, (("table", "string"), ("columns", "column*"))), 5: _Form(InsertRows, (("table", "optional"), ("rows", "row*"))),
    6: _Form(IngestInto, (("table", "string"), ("path", "string"))), 7: _Form(MetaCommand, (("command", "string"),)),
}
_SERVER = {
    1: _Form(QueryResult), 2: _Form(Error, (("message", "string"),)), 3: _Form(Pong), 4: _Form(Ok, (("message", "string"),)),
    5: _Form(MetaResult, (("title", "string"), ("content", "string"))),
}


def _encode(message, forms: dict[int, _Form]) -> bytes:
    tag, form = next((t, f) for t, f in forms.items() if f.kind is type(message))
    w = _Writer()
    w.number("H", VERSION)
    w.number("B", tag)
    if form.kind is QueryResult:
        w.result(message)
    for name, how in form.fields:
        value = getattr(message, name)
        w.many(value, getattr(w, how[:-1])) if how.endswith("*") else getattr(w, how)(value)
    return bytes(w.out)


def _decode(data: bytes, forms: dict[int, _Form], side: str):
    r = _Reader(data)
    if (version := r.number("H")) != VERSION:
        raise ExecutionError(f"Unsupported protocol version: {version}")
    tag = r.number("B")
    if tag not in forms:
        raise ExecutionError(f"Unknown {side} message type: {tag}")
    form = forms[tag]
    if form.kind is QueryResult:
        return r.result()
    values = [r.many(getattr(r, how[:-1])) if how.endswith("*") else getattr(r, how)() for _, how in form.fields]
    return form.kind(*[tuple(v) if name == "columns" else v for (name, _), v in zip(form.fields, values)])


def encode_client(message) -> bytes:
    return _encode(message, _CLIENT)


def decode_client(data: bytes):
    return _decode(data, _CLIENT, "client")


def encode_server(message) -> bytes:
    return _encode(message, _SERVER)


def decode_server(data: bytes):
    return _decode(data, _SERVER, "server")


def write_frame(stream, data: bytes) -> None:
    stream.write(struct.pack(">I", len(data)) + data)
    stream.flush()


def read_frame(stream) -> bytes | None:
    """The next message's bytes, None at the end of the stream."""
    head = stream.read(4)
    if len(head) < 4:
        return None
    n = struct.unpack(">I", head)[0]
    data = stream.read(n)
    return data if len(data) == n else None
