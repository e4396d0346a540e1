"""Errors of the engine. The text of an error is its kind and its message."""

from __future__ import annotations

import re


class EngineError(Exception):
    kind = "Unknown error"

    def __init__(self, message: str):
        super().__init__(f"{self.kind}: {message}")
        self.message = message


class StorageError(EngineError):
    kind = "Storage error"


class ExecutionError(EngineError):
    kind = "Execution error"


class ProtocolError(EngineError):
    kind = "Protocol error"


class ServerError(EngineError):
    kind = "Server error"


class ShellError(EngineError):
    kind = "CLI error"


class SerializationError(EngineError):
    kind = "Serialization error"


#: Marks messages that expressions raise inside Spark, with the kind of error they stand for.
_RAISED = re.compile(r"<<(S|E)\|(.*?)>>", re.DOTALL)


def raised(kind: type[EngineError], message: str) -> str:
    """Text for raise_error() that ``translated`` turns back into an error of this kind."""
    return f"<<{'S' if kind is StorageError else 'E'}|{message}>>"


def translated(error: Exception) -> Exception:
    """The engine's error behind a Spark exception, or the exception itself."""
    if found := _RAISED.search(str(error)):
        return (StorageError if found[1] == "S" else ExecutionError)(found[2])
    return error
