"""Small file operations on whatever store a path names, through the file systems that Spark itself uses."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_dir: bool
    size: int
    modified: int


class Files:
    def __init__(self, spark: SparkSession):
        # looked up once: each step of a class's name is a call to the JVM
        self._hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._hadoop_path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def list(self, path: str) -> list[Entry]:
        """What a folder holds, by name; nothing if it isn't there."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found = [Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
        return sorted(found, key=lambda e: e.name)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def rename(self, old: str, new: str) -> bool:
        fs, p = self._at(old)
        return fs.rename(p, self._hadoop_path(new))

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create_new(self, path: str) -> bool:
        """Makes an empty file; False if there is one already."""
        fs, p = self._at(path)
        try:
            return fs.createNewFile(p)
        except Exception as e:  # some stores raise instead
            if "AlreadyExists" in str(e):
                return False
            raise

    def age(self, path: str) -> float | None:
        """Seconds since a file was written or touched; None if it isn't there."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None

    def touch(self, path: str) -> None:
        fs, p = self._at(path)
        fs.setTimes(p, int(time.time() * 1000), -1)
