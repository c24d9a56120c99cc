"""Which chunks of a long job are done, kept beside its output so that a rerun goes on where it stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


class ChunkLedger:
    """A JSON file of completed chunk names; a torn or foreign file is an error.

    The file lies on any file system that Hadoop knows, so a driver on another machine
    finds it.  A new state is written beside the old one and takes its place by a rename; of a
    driver that dies in between the newer of the two files is read.
    """

    def __init__(self, path: str, job: str, *, spark: SparkSession | None = None):
        spark = spark or SparkSession.active()
        self.job, self.done = job, []
        self._jvm = spark.sparkContext._jvm
        at = self._jvm.org.apache.hadoop.fs.Path
        self._path, self._next = at(path), at(path + ".next")
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        text = self._read(self._path) if self._fs.exists(self._path) else self._read(self._next) if self._fs.exists(self._next) else None
        if text is not None:
            kept = json.loads(text)
            if kept.get("job") != job:
                raise ValueError(f"{path} belongs to {kept.get('job')}, not to {job}")
            self.done = kept["done"]

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def finish(self, chunk: str) -> None:
        if chunk in self.done:
            return
        self.done.append(chunk)
        out = self._fs.create(self._next, True)
        try:
            out.write(bytearray(json.dumps({"job": self.job, "done": self.done}).encode()))
        finally:
            out.close()
        self._fs.delete(self._path, False)
        if not self._fs.rename(self._next, self._path):
            raise OSError(f"cannot replace {self._path}")

    def run(self, chunks: Iterable[str], work: Callable[[str], None]) -> list[str]:
        """Do what is not done yet, in order; returns the chunks worked on now."""
        worked = []
        for chunk in chunks:
            if chunk not in self.done:
                work(chunk)
                self.finish(chunk)
                worked.append(chunk)
        return worked
