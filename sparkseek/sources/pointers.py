"""Numbered pointers: which version of something under a folder is the current one."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

KEPT = 3


class Pointers:
    """Files ``pointer-<number>`` in a folder, each written whole before it gets its name; the highest number counts.

    A pointer is never replaced, so at any time a reader finds one that is whole.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._Path(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._Path(path), True)

    def numbers(self) -> list[int]:
        if not self.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(self.folder))]
        return sorted(int(n[8:]) for n in names if n.startswith("pointer-") and n[8:].isdigit())

    def at(self, number: int) -> dict:
        stream = self._fs.open(self._Path(f"{self.folder}/pointer-{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> dict:
        """The current pointer, empty if there is none."""
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else {}

    def write(self, value: dict) -> list[dict]:
        """Makes value the current pointer. Gives the pointers that this has dropped, of which the newest few are kept."""
        numbers = self.numbers()
        number = numbers[-1] + 1 if numbers else 1
        draft = self._Path(f"{self.folder}/draft-{number}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(value).encode())
        out.close()
        if not self._fs.rename(draft, self._Path(f"{self.folder}/pointer-{number}")):
            raise RuntimeError(f"another writer has taken pointer {number} of {self.folder}")
        old = numbers[: max(0, len(numbers) + 1 - KEPT)]
        dropped = [self.at(n) for n in old]
        for n in old:
            self.remove(f"{self.folder}/pointer-{n}")
        return dropped
