"""Versions of a table as files that are never written again, and one pointer that moves from version to version in one step."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """Numbered records under ``path``; the greatest number is what holds.

    A record is written aside and renamed to its number, which fails if that stands already: a reader sees the old version or the new one, never a part, and of two
    writers one has to begin again. What a version names must be in place before it is committed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def latest(self) -> tuple[int, dict]:
        """(number, record) of what holds now; (0, {}) where nothing was committed yet."""
        if not self._files.exists(self._at("")):
            return 0, {}
        names = (s.getPath().getName() for s in self._files.listStatus(self._at("")))
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return (max(numbers), self.at(max(numbers))) if numbers else (0, {})

    def at(self, number: int) -> dict:
        """The record of a version; it stays readable after later ones."""
        stream = self._files.open(self._at(f"{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, record: dict) -> None:
        """Make ``record`` version ``number``; an error if that was committed meanwhile."""
        aside, place = self._at(f".{number:012d}-{self._jvm.java.util.UUID.randomUUID()}"), self._at(f"{number:012d}.json")
        stream = self._files.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        if self._files.exists(place) or not self._files.rename(aside, place):
            self._files.delete(aside, False)
            raise RuntimeError(f"version {number} of {self.path} was committed by another writer")

    def forget(self, names: list[str]) -> None:
        """Delete folders beside the manifest that no version in use names any more."""
        for name in names:
            self._files.delete(self._at(name), True)
