r"""The interactive shell: statements end with ``;``, commands begin with ``\``.

``python -m colonnade.shell [--root DIR]`` runs its own engine, ``--connect HOST:PORT`` uses a server's, ``--serve``
is that server.
"""

from __future__ import annotations

import argparse
import contextlib
import sys
from pathlib import Path

from . import __version__
from . import messages as M
from .errors import EngineError, ShellError
from .inspect import resident_bytes
from .printer import FORMATS, Settings, response

#: Commands and what they do, in the order of the help text.
COMMANDS = (
    (r"\q, \quit", "End the session"),
    (r"\l, \databases", "List databases"),
    (r"\dt, \tables [database]", "List tables, of one database if it is named"),
    (r"\d, \schema <db.table>", "Columns of a table"),
    (r"\segments <db.table>", "Segments of a table"),
    (r"\storage <db.table>", "Storage options of a table"),
    (r"\stats <db.table>", "Statistics of a table and its columns"),
    (r"\optimize <db.table>", "Compact a table"),
    (r"\vacuum <db.table>", "Remove what interrupted work left in a table"),
    (r"\explain <query>", "Plans of a query that isn't run"),
    (r"\plan [on|off]", "Show plans with results"),
    (r"\profile [on|off]", "Show time and size of answers"),
    (r"\timing [on|off]", "Show the time of answers"),
    (r"\format [unicode|ascii|csv|tsv]", "Form of results"),
    (r"\memory", "Memory of the shell"),
    (r"\version", "Version of the shell"),
    (r"\about", "What this is"),
    (r"\help, \?, \commands", "This list"),
)
_REMOTE = {"l": "databases", "databases": "databases", "dt": "tables", "tables": "tables", "d": "schema", "schema": "schema", "segments": "segments", "storage": "storage", "stats": "stats", "optimize": "optimize", "vacuum": "vacuum"}
_SWITCHES = ("timing", "plan", "profile")


def help_text() -> str:
    return "\n".join(["Shell commands", *(f"{name:<34}{what}" for name, what in COMMANDS)])


class Shell:
    def __init__(self, client, settings: Settings | None = None, out=print):
        self.client, self.settings, self.out = client, settings or Settings(), out
        self.buffer: list[str] = []

    def line(self, text: str) -> bool:
        """Takes one line; False when the session ends. Errors are shown, and the session goes on."""
        try:
            stripped = text.strip()
            if stripped.startswith("\\") and not self.buffer:
                return self.command(stripped[1:].strip())
            if stripped or self.buffer:
                self.buffer.append(text)
            if stripped.endswith(";"):
                statement = "\n".join(self.buffer).strip().removesuffix(";").strip()
                self.buffer.clear()
                if statement:
                    self.show(M.QueryText(statement))
        except EngineError as e:
            self.buffer.clear()
            self.out(f"Error: {e}")
        return True

    def interrupt(self) -> None:
        """Ctrl-C drops what was typed so far."""
        self.buffer.clear()

    def show(self, message) -> None:
        r = self.client.send(message)
        self.out(response(r.message, r.elapsed_ms, r.response_bytes, self.settings))

    def command(self, body: str) -> bool:
        name, _, rest = body.partition(" ")
        name, rest = name.lower(), rest.strip()
        if name in ("q", "quit"):
            return False
        if name in ("", "?", "help", "commands"):
            self.out(help_text())
        elif name == "version":
            self.out(f"colonnade shell {__version__}")
        elif name == "about":
            self.out(f"colonnade shell {__version__}\nStatements over several lines, commands and plans of an analytics engine on Spark.")
        elif name in _SWITCHES:
            self.out(self.switch(name, rest))
        elif name == "format":
            if rest and rest.lower() not in FORMATS:
                raise ShellError(f"Unknown output format: {rest.lower()}")
            self.settings.output_format = rest.lower() or self.settings.output_format
            self.out(f"format {self.settings.output_format}")
        elif name == "memory":
            self.out(f"CLI memory usage\n  rss_bytes: {resident_bytes()}\n  virtual_bytes: {_virtual_bytes()}")
        elif name == "explain":
            if not rest:
                raise ShellError("\\explain requires an inline query")
            self.show(M.MetaCommand(f"explain {rest}"))
        elif name in _REMOTE:
            if not rest and _REMOTE[name] not in ("databases", "tables"):
                raise ShellError(f"\\{name} requires a table reference")
            self.show(M.MetaCommand(f"{_REMOTE[name]} {rest}".strip()))
        else:
            raise ShellError(f"Unknown meta command: \\{name} (use \\help)")
        return True

    def switch(self, name: str, value: str) -> str:
        if value:
            if value.lower() not in ("on", "off"):
                raise ShellError(f"Expected 'on' or 'off', got '{value.lower()}'")
            setattr(self.settings, f"show_{name}", value.lower() == "on")
        return f"{name} {'on' if getattr(self.settings, f'show_{name}') else 'off'}"


def _virtual_bytes() -> int:
    status = Path("/proc/self/status")
    return next((int(line.split()[1]) * 1024 for line in status.read_text().splitlines() if line.startswith("VmSize:")), 0) if status.exists() else 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="colonnade")
    p.add_argument("--root", default="data")
    p.add_argument("--connect", metavar="HOST:PORT")
    p.add_argument("--serve", action="store_true")
    p.add_argument("--port", type=int, default=5999)
    given = p.parse_args(args)
    from .server import Client, LocalClient, Server

    if given.connect:
        host, _, port = given.connect.partition(":")
        client = Client(host, int(port or given.port))
    else:
        from pyspark.sql import SparkSession

        from .session import Session

        session = Session(SparkSession.builder.appName("colonnade").getOrCreate(), given.root)
        if given.serve:
            with Server(session, port=given.port) as server:
                server.serve_forever()
            return 0
        client = LocalClient(session)
    with contextlib.suppress(ImportError):
        import readline  # noqa: F401  history
    shell = Shell(client)
    while True:
        try:
            if not shell.line(input("... " if shell.buffer else "aql> ")):
                return 0
        except KeyboardInterrupt:
            shell.interrupt()
            print()
        except EOFError:
            return 0


if __name__ == "__main__":
    sys.exit(main())
