"""The engine behind a TCP port, and its client."""

from __future__ import annotations

import socket
import socketserver
import threading
import time
from dataclasses import dataclass

from . import messages as M
from .errors import EngineError, ProtocolError
from .session import Session
from .streaming.background import BackgroundCompaction

HOST, PORT, MAX_CONNECTIONS = "0.0.0.0", 5999, 256


class Server(socketserver.ThreadingTCPServer):
    """A thread for each connection, up to a number of them; more wait to be accepted."""

    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, session: Session, host: str = HOST, port: int = PORT, connections: int = MAX_CONNECTIONS, compaction: bool = True):
        self.session = session
        self._free = threading.BoundedSemaphore(connections)
        self.compaction = BackgroundCompaction(session.catalog) if compaction else None
        super().__init__((host, port), _Connection)

    def process_request(self, request, client_address):
        self._free.acquire()
        super().process_request(request, client_address)

    def process_request_thread(self, request, client_address):
        try:
            super().process_request_thread(request, client_address)
        finally:
            self._free.release()

    def serve_forever(self, poll_interval: float = 0.5):
        if self.compaction:
            self.compaction.start()
        try:
            super().serve_forever(poll_interval)
        finally:
            if self.compaction:
                self.compaction.stop()


class _Connection(socketserver.StreamRequestHandler):
    def handle(self):
        while (data := M.read_frame(self.rfile)) is not None:
            try:
                answer = self.server.session.handle(M.decode_client(data))
            except EngineError as e:
                answer = M.Error(str(e))
            M.write_frame(self.wfile, M.encode_server(answer))


@dataclass(frozen=True)
class Response:
    message: object
    elapsed_ms: float
    response_bytes: int


class Client:
    def __init__(self, host: str = "127.0.0.1", port: int = PORT, timeout: float | None = None):
        self._socket = socket.create_connection((host, port), timeout)
        self._stream = self._socket.makefile("rwb")

    def send(self, message) -> Response:
        started = time.perf_counter()
        M.write_frame(self._stream, M.encode_client(message))
        data = M.read_frame(self._stream)
        if data is None:
            raise ProtocolError("connection closed")
        return Response(M.decode_server(data), (time.perf_counter() - started) * 1000, len(data))

    def close(self) -> None:
        self._stream.close()
        self._socket.close()


class LocalClient:
    """A client of a session in the same process; answers are measured as they would travel."""

    def __init__(self, session: Session):
        self.session = session

    def send(self, message) -> Response:
        started = time.perf_counter()
        answer = self.session.handle(message)
        return Response(answer, (time.perf_counter() - started) * 1000, len(M.encode_server(answer)))
