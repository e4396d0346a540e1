"""Which fingerprints a corpus has more than once, by an exchange of Golomb-coded lists.

Each task sends, to the owner of each hash range, the sorted distinct hashes of each file that it reads as a Golomb (Rice)
code of their gaps, with a mark at those that it has more than once. An owner answers each message with bitmaps: which
of its hashes another message has too, or this one twice, and which of those the corpus has very often. The answers
stand by file in the shared folder, where tasks that read the file again, however cut, look them up.

No list grows with the number of copies: a hash is in a message once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame

from .common import PLACE_BITS, Spool, partitions

HASH_BITS = 48
#: Hash ranges: as many as shuffle partitions, or one for so many expected hashes, so that an owner's part stays small.
OWNER_HASHES = 4_000_000


def golomb_encode(sorted_hashes: np.ndarray, low: int, high: int) -> tuple[int, int, bytes, bytes]:
    """Count, Rice parameter, unary quotients and binary remainders of the gaps of distinct sorted values in [low, high)."""
    n = len(sorted_hashes)
    if not n:
        return 0, 0, b"", b""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(low)).astype(np.uint64)
    k = max(0, int((high - low) // n).bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return n, k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes, low: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k)
        # whole bytes of each remainder, highest first
        whole = np.packbits(np.pad(bits, ((0, 0), (-k % 64, 0))), axis=1)
        gaps += np.ascontiguousarray(whole).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _low(owner: int, owners: int) -> int:
    return -(-(owner << HASH_BITS) // owners)


def _by_owner(hashes: np.ndarray, owners: int):
    """(owner, from, to) of the slices of sorted hashes."""
    cuts = np.searchsorted(hashes, np.array([_low(o, owners) for o in range(owners + 1)], np.uint64)).tolist()
    for o in range(owners):
        if cuts[o] < cuts[o + 1]:
            yield o, cuts[o], cuts[o + 1]


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n) == 1


_MESSAGE = {"owner": pa.int32(), "file": pa.int64(), "n": pa.int32(), "k": pa.int32(), "unary": pa.binary(), "rest": pa.binary(), "twice": pa.binary(), "times": pa.binary()}
_ANSWER = {"file": pa.int64(), "owner": pa.int32(), "n": pa.int32(), "k": pa.int32(), "unary": pa.binary(), "rest": pa.binary(), "shared": pa.binary(), "often": pa.binary()}


def _sql(kinds: dict) -> str:
    return ", ".join(f"{name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'})[t]}" for name, t in kinds.items())


def _arrays(rows: list[tuple], kinds: dict) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())]


class ByFile:
    """A table in the shared folder that tasks read by input file. Small enough to be sent with a task's code."""

    def __init__(self, folder: str):
        self.folder = folder

    def table(self, file: int) -> pa.Table | None:
        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
        # a file of which nothing is known has no folder
        if store.get_file_info(f"{root}/file={file}").type == fs.FileType.NotFound:
            return None
        return ds.dataset(f"{root}/file={file}", filesystem=store, format="parquet").to_table()


class Answers(ByFile):
    def __init__(self, folder: str, owners: int):
        super().__init__(folder)
        self.owners = owners
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, file: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the file that the corpus has more than once, and those of them that it has very often."""
        if file not in self.known:
            shared, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            table = self.table(file)
            for m in table.to_pylist() if table is not None else ():
                own = golomb_decode(m["n"], m["k"], m["unary"], m["rest"], _low(m["owner"], self.owners))
                shared.append(own[_bits(m["shared"], m["n"])])
                often.append(own[_bits(m["often"], m["n"])])
            # a task reads its files one after another
            self.known = {**dict(list(self.known.items())[-3:]), file: (np.unique(np.concatenate(shared)), np.unique(np.concatenate(often)))}
        return self.known[file]


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def exchange(rows: DataFrame, hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], expected: int, often: int = 1 << 62) -> tuple[Spool, Answers]:
    """The answers about the hashes that ``hashes`` gives for a batch of ``rows``: row keys and, for each, a value below 2**48.

    ``expected``: about how many hashes there are in all; it sets the number of owners, not the result. ``often``: hashes
    that occur more often than that are told apart. Drop the spool once what reads the answers is written.
    """
    spark = rows.sparkSession
    owners = max(partitions(spark), -(-expected // OWNER_HASHES))

    def send(parts):
        held: dict[int, list[np.ndarray]] = {}
        for b in parts:
            keys, own = hashes(b)
            file = keys >> PLACE_BITS
            for f in np.unique(file).tolist():
                held.setdefault(f, []).append(own[file == f])
        for f, own in held.items():
            values, times = np.unique(np.concatenate(own), return_counts=True)
            sent = []
            for o, a, z in _by_owner(values, owners):
                n = times[a:z]
                sent.append((o, f, *golomb_encode(values[a:z], _low(o, owners), _low(o + 1, owners)), np.packbits(n > 1).tobytes(), n[n > 1].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(_arrays(sent, _MESSAGE), list(_MESSAGE))

    def answer(key, messages):
        owner = key[0].as_py()
        got, lists, counts = messages.to_pylist(), [], []
        for m in got:
            lists.append(golomb_decode(m["n"], m["k"], m["unary"], m["rest"], _low(owner, owners)))
            n = np.ones(m["n"], np.int64)
            n[_bits(m["twice"], m["n"])] = np.frombuffer(m["times"], "<u4")
            counts.append(n)
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) > 0]))
        total = np.add.reduceat(np.concatenate(counts)[order], first)
        times = np.empty(len(every), np.int64)
        times[order] = np.repeat(total, np.diff(first, append=len(every)))
        out, at = [], 0
        for m in got:
            mine = times[at : at + m["n"]]
            at += m["n"]
            if (mine > 1).any():
                out.append((m["file"], owner, m["n"], m["k"], m["unary"], m["rest"], np.packbits(mine > 1).tobytes(), np.packbits(mine > often).tobytes()))
        return pa.Table.from_arrays(_arrays(out, _ANSWER), list(_ANSWER))

    sent = rows.mapInArrow(send, _sql(_MESSAGE))
    spool = Spool(sent.groupBy("owner").applyInArrow(answer, _sql(_ANSWER)).repartition(partitions(spark), "file"), "answers", by="file")
    return spool, Answers(spool.path, owners)
